"""Stratified splits, minority oversampling and positional splits with exact sizes.

Rows are ordered by a hash of their id. The hash is hexadecimal text, spread
evenly, so rows can be counted by its first digits: the wanted rank is located
in a small table of counts, and rows are then compared with one cut-off value
instead of being numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.session import durable

C = F.col
DIGITS = 4
SORTED_ROWS = 100_000


def hash_key(key: str, seed: int) -> Column:
    """Evenly spread order of rows: MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), C(key).cast("string")))


def keys_at_ranks(df: DataFrame, group: str, key: str, ranks: dict[int, list[int]]) -> dict[int, dict[int, str]]:
    """For each group value, the keys at the given one-based ranks (rank 0 gives the empty text)."""
    result: dict[int, dict[int, str]] = {value: {0: ""} for value in ranks}
    searches = [(value, rank, "", rank) for value, wanted in ranks.items() for rank in sorted(set(wanted)) if rank > 0]
    while searches:
        spans = sorted({(value, prefix) for value, _, prefix, _ in searches})
        depth = len(spans[0][1])
        number = F.lit(None).cast("int")
        for position, (value, prefix) in enumerate(spans):
            number = F.when((C(group) == value) & C(key).startswith(prefix), position).otherwise(number)
        counts = (
            df.withColumn("span", number).filter(C("span").isNotNull())
            .groupBy("span", F.substring(key, depth + 1, DIGITS).alias("digits"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        running = Window.partitionBy("span").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
        wanted = F.lit(False)
        for value, _, prefix, rest in searches:
            wanted = wanted | (
                (C("span") == spans.index((value, prefix))) & (C("before") < rest) & (rest <= C("before") + C("rows")))
        found = placed.filter(wanted).collect()
        narrowed, ready = [], []
        for value, rank, prefix, rest in searches:
            span = spans.index((value, prefix))
            row = next(r for r in found if r.span == span and r.before < rest <= r.before + r.rows)
            step = (value, rank, prefix + row.digits, rest - row.before)
            (ready if row.rows <= SORTED_ROWS or depth + DIGITS >= 32 else narrowed).append(step)
        for value, rank, key_value in _sorted_lookup(df, group, key, ready):
            result[value][rank] = key_value
        searches = narrowed
    return result


def _sorted_lookup(df: DataFrame, group: str, key: str, steps: list[tuple]) -> list[tuple]:
    """Number the few rows of each found span and read the wanted ones."""
    if not steps:
        return []
    spans = sorted({(value, prefix) for value, _, prefix, _ in steps})
    number = F.lit(None).cast("int")
    for position, (value, prefix) in enumerate(spans):
        number = F.when((C(group) == value) & C(key).startswith(prefix), position).otherwise(number)
    order = Window.partitionBy("span").orderBy(key)
    numbered = df.select(number.alias("span"), key).filter(C("span").isNotNull()).withColumn(
        "n", F.row_number().over(order))
    wanted = F.lit(False)
    for value, _, prefix, rest in steps:
        wanted = wanted | ((C("span") == spans.index((value, prefix))) & (C("n") == rest))
    found = {(row.span, row.n): row[key] for row in numbered.filter(wanted).collect()}
    return [(value, rank, found[spans.index((value, prefix)), rest]) for value, rank, prefix, rest in steps]


def class_sizes(counts: dict[int, int], ratio: float) -> dict[int, int]:
    """Held-out rows per class: the total is rounded up, classes share it proportionally.

    The kept part is shared out first, by whole numbers and then largest remainders.
    """
    total = sum(counts.values())
    kept_total = total - math.ceil(total * ratio)
    shares = {value: n * kept_total / total for value, n in counts.items()}
    kept = {value: math.floor(share) for value, share in shares.items()}
    left = kept_total - sum(kept.values())
    for value in sorted(shares, key=lambda v: (kept[v] - shares[v], v))[:left]:
        kept[value] += 1
    return {value: counts[value] - kept[value] for value in counts}


def label_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {row[label]: row["count"] for row in df.groupBy(label).count().collect()}


def stratified_split(
    df: DataFrame, label: str, key: str, ratio: float = contract.TEST_RATIO, seed: int = contract.SEED,
) -> DataFrame:
    """Add ``split``: test, calibrate or fit, with the same class mix in each.

    A fifth of the rows is held out for testing and a fifth of the rest for
    calibration. ``key`` must be unique.
    """
    keyed = df.withColumn("split_key", hash_key(key, seed))
    counts = label_counts(df, label)
    test = class_sizes(counts, ratio)
    calibrate = class_sizes({value: counts[value] - test[value] for value in counts}, ratio)
    ranks = {value: [test[value], test[value] + calibrate[value]] for value in counts}
    cutoffs = keys_at_ranks(keyed, label, "split_key", ranks)
    split = F.lit(None).cast("string")
    for value, (first, second) in ranks.items():
        part = (
            F.when(C("split_key") <= cutoffs[value][first], "test")
            .when(C("split_key") <= cutoffs[value][second], "calibrate").otherwise("fit")
        )
        split = F.when(C(label) == value, part).otherwise(split)
    return keyed.withColumn("split", split)


def split_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", label).agg(F.count(F.lit(1)).alias("rows"))


def extra_rows(positives: int, negatives: int) -> int:
    """How many positives to add: a share of the negatives, at most three times the positives."""
    desired = min(
        int(negatives * contract.OVERSAMPLE_RATIO), int(positives * contract.OVERSAMPLE_MAX_MULTIPLE))
    return max(desired - positives, 0)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number rows 0, 1, 2, … by a hash key, without one sort over all rows.

    Rows are counted by the first digits of the key; each group of digits then
    numbers its own few rows and adds the count of the groups before it.
    """
    digits = df.withColumn("digits", F.substring(key, 1, DIGITS))
    running = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    offsets = digits.groupBy("digits").agg(F.count(F.lit(1)).alias("rows")).select(
        "digits", F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("before"))
    own = Window.partitionBy("digits").orderBy(key)
    return (
        digits.withColumn("n", F.row_number().over(own))
        .join(F.broadcast(offsets), "digits")
        .withColumn(name, (C("before") + C("n") - 1).cast("bigint"))
        .drop("digits", "n", "before")
    )


def draw(position: Column, size: int, seed: int) -> Column:
    """A pseudo-random number below ``size`` for each draw."""
    text = F.md5(F.concat(F.lit(f"{seed}:draw:"), position.cast("string")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint") % F.lit(size)


def oversample(df: DataFrame, label: str, seed: int = contract.SEED) -> tuple[DataFrame, int]:
    """Append positives drawn with replacement; returns the rows and how many were added.

    ``df`` needs the ``split_key`` of the split.
    """
    counts = label_counts(df, label)
    positives, negatives = counts.get(1, 0), counts.get(0, 0)
    added = extra_rows(positives, negatives)
    if added == 0:
        return df, 0
    pool = numbered(df.filter(C(label) == 1), "split_key", "position")
    draws = df.sparkSession.range(added).select(draw(C("id"), positives, seed).alias("position"))
    return df.unionByName(draws.join(pool, "position").drop("position")), added


def positional_split(df: DataFrame, key: str, ratio: float = contract.TEST_RATIO) -> DataFrame:
    """First part of the rows by key is ``train``, the rest ``test``.

    The key may be of any type that can be ordered and is compared as it is.
    Rows without a key come last; rows that share the key at the cut stay
    together in ``train``.
    """
    counts = durable(
        df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).repartitionByRange(C(key).asc_nulls_last())
        .withColumn("part", F.spark_partition_id()), "key-counts")
    parts = [(r.part, r.known, r.rows) for r in counts.groupBy("part").agg(
        F.sum(F.when(C(key).isNotNull(), C("rows")).otherwise(0)).alias("known"), F.sum("rows").alias("rows"),
    ).orderBy("part").collect()]
    first = min(int(sum(rows for _, _, rows in parts) * (1 - ratio)), sum(known for _, known, _ in parts))
    if first == 0:
        return df.withColumn("split", F.lit("test"))
    before = 0
    for part, known, _ in parts:  # as many entries as the table has ranges
        if before + known >= first:
            break
        before += known
    upto = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    held = counts.filter((C("part") == part) & C(key).isNotNull()).withColumn("upto", F.sum("rows").over(upto))
    cutoff = held.filter(C("upto") >= first - before).agg(F.min(key).alias(key)).first()[key]
    at_most = F.coalesce(C(key) <= F.lit(cutoff), F.lit(False))
    return df.withColumn("split", F.when(at_most, "train").otherwise("test"))


def table_summary(df: DataFrame, key: str) -> DataFrame:
    """Shape of the table and of its two positional parts."""
    return positional_split(df, key).agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.lit(len(df.columns)).alias("processed_columns"),
        F.count(F.when(C("split") == "train", 1)).alias("train_rows"),
        F.count(F.when(C("split") == "test", 1)).alias("test_rows"),
    )
