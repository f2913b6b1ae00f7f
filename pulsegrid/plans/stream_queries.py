"""Incremental ingest, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.plans.checks import with_residents
from pulsegrid.plans.population_queries import suppressed_sql
from pulsegrid.plans.registry import query
from pulsegrid.session import shared_path
from pulsegrid.sources.tables import residents
from pulsegrid.streaming import ingest

COLUMNS = ["resident_id", "data_period", "district", "community_id", "age", "label_heart", "label_stroke"]


def landed_files(spark, sf_dir, copies: int):
    """Resident rows as several landed files; with copies, repeats fall into different files."""
    path = shared_path(spark, "landing")
    rows = residents(spark, sf_dir).select(*COLUMNS)
    for _ in range(copies):
        rows.write.mode("append").parquet(path)
    return path, rows.schema


@query("st1_unique_ingest", with_residents(f"SELECT {', '.join(COLUMNS)} FROM residents"))
def unique_ingest(spark, sf_dir):
    path, schema = landed_files(spark, sf_dir, 2)
    target = shared_path(spark, "ingested")
    stream = ingest.read_stream(spark, path, schema, bytes_per_batch=ingest.batch_bytes(spark))
    ingest.ingest_unique(
        stream, ["resident_id", "data_period"], "data_period", target, shared_path(spark, "progress"))
    return ingest.read_unique(spark, target, schema)


@query("st1_compacted_ingest", with_residents(f"SELECT {', '.join(COLUMNS)} FROM residents"))
def compacted_ingest(spark, sf_dir):
    """The same after a compaction, with the first copy of the files and the second one landing before and after it."""
    path, schema = landed_files(spark, sf_dir, 1)
    target, key = shared_path(spark, "ingested"), ["resident_id", "data_period"]
    progress = shared_path(spark, "progress")
    ingest.ingest_unique(ingest.read_stream(spark, path, schema, bytes_per_batch=ingest.batch_bytes(spark)), key, "data_period", target, progress)
    ingest.compact(spark, target, schema, "data_period")
    residents(spark, sf_dir).select(*COLUMNS).write.mode("append").parquet(path)
    ingest.ingest_unique(ingest.read_stream(spark, path, schema, bytes_per_batch=ingest.batch_bytes(spark)), key, "data_period", target, progress)
    return ingest.read_unique(spark, target, schema)


TIMED = [*COLUMNS, "snapshot_date"]


def _timed_ingest(spark, sf_dir, lateness):
    """Residents landing twice, in the order of months within each of four files, with their dates as event times."""
    path, target, rejected = (shared_path(spark, name) for name in ("landing", "accepted", "rejected"))
    rows = residents(spark, sf_dir).select(*TIMED).withColumn("event_time", F.col("snapshot_date").cast("timestamp"))
    for part in (0, 1, 2, 3, 0, 1):
        rows.filter(F.col("resident_id") % 4 == part).write.mode("append").parquet(path)
    ingest.ingest_within_watermark(spark, path, rows.schema, ["resident_id"], "event_time", lateness, target, rejected, shared_path(spark, "progress"),
                                   bytes_per_batch=ingest.batch_bytes(spark))
    return ingest.read_accepted(spark, target, rows.schema), ingest.read_rejected(spark, rejected, rows.schema)


@query("st1_watermark_ingest", with_residents(f"SELECT {', '.join(COLUMNS)} FROM residents"))
def watermark_ingest(spark, sf_dir):
    """Deduplicated by streaming state; the bound on lateness is longer than the dates reach, so nothing is late."""
    accepted, rejected = _timed_ingest(spark, sf_dir, "20000 days")
    return accepted.unionByName(rejected).select(*COLUMNS)


@query("st1_late_rows", with_residents("SELECT resident_id, CAST(1 AS BIGINT) AS places FROM residents"))
def late_rows(spark, sf_dir):
    """With a short bound, every landed resident is either accepted once or among the rejected ones."""
    accepted, rejected = _timed_ingest(spark, sf_dir, "30 days")
    both = accepted.select("resident_id").unionByName(rejected.select("resident_id").distinct())
    return both.groupBy("resident_id").agg(F.count("*").alias("places"))


@query("st2_running_report", with_residents(suppressed_sql("residents", "data_period, district")))
def running_report(spark, sf_dir):
    path, schema = landed_files(spark, sf_dir, 1)
    target = shared_path(spark, "counters")
    stream = ingest.read_stream(spark, path, schema, bytes_per_batch=ingest.batch_bytes(spark))
    keys = ["data_period", "district"]
    ingest.ingest_counters(stream, keys, target, shared_path(spark, "progress"))
    return ingest.current_report(spark, keys, target)
