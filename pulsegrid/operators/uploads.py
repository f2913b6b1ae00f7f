"""Completeness of chunked uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
PART_KEY = ["task_id", "chunk_index"]


def first_parts(parts: DataFrame) -> DataFrame:
    """Insert-or-ignore: the first arrival of each part stays.

    The rank filter drops re-sent copies in the map tasks already, so one part
    sent over and over does not pile up in one reducer.
    """
    arrival = Window.partitionBy(*PART_KEY).orderBy("created_at", "chunk_path", "chunk_size")
    return parts.withColumn("arrival", F.row_number().over(arrival)).filter(C("arrival") == 1).drop("arrival")


def expected_parts(tasks: DataFrame) -> DataFrame:
    return tasks.filter(C("total_chunks") > 0).select(
        "task_id", F.explode(F.sequence(F.lit(0), C("total_chunks") - 1)).alias("chunk_index"))


def missing_parts(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Expected part numbers that never arrived."""
    return expected_parts(tasks).join(parts.select(*PART_KEY).distinct(), PART_KEY, "left_anti")


def task_completeness(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct valid parts per task and whether all of 0 .. n-1 are there.

    Copies are removed on (task, part) first; what is left per task is at most
    its number of distinct parts.
    """
    arrived = parts.select(*PART_KEY).distinct()
    joined = tasks.select("task_id", "total_chunks").join(arrived, "task_id", "left")
    inside = F.when(C("chunk_index").between(0, C("total_chunks") - 1), C("chunk_index"))
    counted = joined.groupBy("task_id", "total_chunks").agg(
        F.count(inside).alias("received"), F.min(inside).alias("first_part"), F.max(inside).alias("last_part"))
    return counted.withColumn("complete", (C("total_chunks") > 0) & (C("received") == C("total_chunks")))
