"""Small helpers of the language-model operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes between words, as a Java character class: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"
#: At most this many keys are broadcast after they have been counted; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def semi_join(rows: DataFrame, keys: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows whose key is (or is not) among ``keys``, a stored table of one column.

    The keys are counted first and broadcast only up to BROADCAST_KEYS; beyond that both sides are shuffled.
    """
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, key, "left_anti" if anti else "left_semi")


def first_by_hash(rows: DataFrame, group: str, count: int, parts: int = 64) -> DataFrame:
    """The ``count`` rows of each group that come first by a hash of doc_id; ties by doc_id.

    Ranked in ``parts`` parts of the group first, so that no task gets a whole group.
    """
    for keys in ([group, F.pmod(F.xxhash64("doc_id"), F.lit(parts))], [group]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
        rows = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= count).drop("_rank")
    return rows
