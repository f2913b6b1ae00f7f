"""Run registered queries against their SQL checks: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows), [names[i] for i in order]


SAME_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, name, function, check, sf_dir) -> list[str]:
    df = function(spark, sf_dir)
    types = dict(df.dtypes)
    mine, my_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if check is None:
        return [] if mine else ["no rows"]
    result = con.execute(check)
    described = result.description
    theirs, their_names = rows_of([d[0] for d in described], result.fetchall())
    problems = []
    if my_names != their_names:
        return [f"columns differ: {my_names} != {their_names}"]
    for column in described:
        wanted = SAME_TYPES.get(types[column[0]], types[column[0]])
        if str(column[1]) != wanted:
            problems.append(f"type of {column[0]}: {types[column[0]]} != {column[1]}")
    if mine != theirs:
        left, right = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        problems.append(f"rows {len(mine)} vs {len(theirs)}; columns {my_names}; spark only {left}; sql only {right}")
    if not mine:
        problems.append("no rows")
    return problems


def main() -> int:
    from pulsegrid.plans.catalog import CHECKS, QUERIES
    from pulsegrid.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, function in sorted(QUERIES.items()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            problems = compare(spark, con, name, function, CHECKS.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        state = "FAIL" if problems else ("ok" if name in CHECKS else "rows")
        print(f"{state:5s}{name:36s}{time.time() - started:7.2f}s", *problems, flush=True)
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
