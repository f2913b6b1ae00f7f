"""Exact quantiles and median imputation without sorting or collecting the data.

Each pass counts rows in value buckets (at most ``BUCKETS`` per column, combined
in the map tasks), picks the bucket that holds the wanted rank and looks inside
it in the next pass. A bucket whose smallest and largest values agree ends the
search, so repeated values cost nothing extra.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import contract

C = F.col
BUCKETS = 8192


@dataclass
class _Search:
    """A wanted rank of a column, known to lie between two values."""

    column: str
    rank: int
    low: float
    high: float
    inner_rank: int
    value: float | None = None

    def settle(self, low: float, high: float, rows: int, inner_rank: int) -> None:
        self.low, self.high, self.inner_rank = low, high, inner_rank
        if low == high or inner_rank == 0:
            self.value = low
        elif inner_rank == rows - 1:
            self.value = high


def _number(name: str) -> Column:
    value = C(name).cast("double")
    return F.when(~F.isnan(value), value)


def _bucket_pass(df: DataFrame, open_searches: list[_Search]) -> None:
    spans = sorted({(s.column, s.low, s.high) for s in open_searches})
    entries = []
    for number, (name, low, high) in enumerate(spans):
        value = _number(name)
        share = (value - F.lit(low)) / F.lit(high - low)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        inside = value.between(low, high)
        entries.append(F.when(inside, F.struct(
            F.lit(number).alias("span"), bucket.alias("bucket"), value.alias("value"))))
    running = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        df.select(F.explode(F.array(*entries)).alias("e")).filter(C("e").isNotNull()).select("e.*")
        .groupBy("span", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    )
    wanted = F.lit(False)
    for search in open_searches:
        number = spans.index((search.column, search.low, search.high))
        holds = (C("before") <= search.inner_rank) & (search.inner_rank < C("before") + C("rows"))
        wanted = wanted | ((C("span") == number) & holds)
    found = counted.filter(wanted).collect()
    for search in open_searches:
        number = spans.index((search.column, search.low, search.high))
        for row in found:
            if row.span == number and row.before <= search.inner_rank < row.before + row.rows:
                search.settle(row.low, row.high, row.rows, search.inner_rank - row.before)
                break


def values_at_ranks(df: DataFrame, ranks: dict[str, list[int]], bounds: dict | None = None) -> dict[str, dict[int, float]]:
    """The values at zero-based ranks of each column, nulls left out."""
    if bounds is None:
        bounds = column_bounds(df, list(ranks))
    searches = []
    for name, wanted in ranks.items():
        low, high, rows = bounds[name]
        if rows and math.isinf(high - low):
            raise ValueError(f"{name} spans an infinite range")
        for rank in sorted(set(wanted)):
            search = _Search(name, rank, low, high, rank)
            search.settle(low, high, rows, rank)
            searches.append(search)
    while open_searches := [s for s in searches if s.value is None]:
        _bucket_pass(df, open_searches)
    result: dict[str, dict[int, float]] = {name: {} for name in ranks}
    for search in searches:
        result[search.column][search.rank] = search.value
    return result


def column_bounds(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float, int]]:
    """Smallest value, largest value and number of values of each column, in one pass."""
    aggregates = []
    for name in names:
        value = _number(name)
        aggregates += [
            F.min(value).alias(f"low_{name}"), F.max(value).alias(f"high_{name}"), F.count(value).alias(f"rows_{name}")]
    row = df.agg(*aggregates).first()
    return {name: (row[f"low_{name}"], row[f"high_{name}"], row[f"rows_{name}"]) for name in names}


def exact_quantiles(df: DataFrame, wanted: dict[str, float], interpolate: bool = False) -> dict[str, float | None]:
    """One quantile per column: an element of the data, or interpolated between two neighbours."""
    bounds = column_bounds(df, list(wanted))
    places = {}
    for name, share in wanted.items():
        rows = bounds[name][2]
        if rows == 0:
            continue
        if interpolate:
            exact = (rows - 1) * share
            lower = math.floor(exact)
            places[name] = (lower, min(lower + 1, rows - 1), exact - lower)
        else:
            lower = max(math.ceil(share * rows) - 1, 0)
            places[name] = (lower, lower, 0.0)
    found = values_at_ranks(df, {name: [a, b] for name, (a, b, _) in places.items()}, bounds)
    result: dict[str, float | None] = dict.fromkeys(wanted)
    for name, (lower, upper, part) in places.items():
        low, high = found[name][lower], found[name][upper]
        result[name] = low + (high - low) * part
    return result


def impute_medians(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Fill nulls of the given columns with the column's median element."""
    names = names or contract.FEATURES
    medians = exact_quantiles(df, dict.fromkeys(names, 0.5))
    kinds = dict(df.dtypes)
    filled = {
        name: F.coalesce(C(name), F.lit(medians[name]).cast(kinds[name]))
        for name in names if medians[name] is not None
    }
    return df.withColumns(filled)


def flag_by_prevalence(df: DataFrame, score: str, prevalence: float, flag: str) -> DataFrame:
    """Mark rows whose score reaches the cut-off that leaves the given share above it.

    The cut-off is one number, found exactly and compared as a literal.
    """
    cutoff = exact_quantiles(df, {score: 1.0 - prevalence}, interpolate=True)[score]
    return df.withColumn(flag, (C(score) >= F.lit(cutoff)).cast("int"))
