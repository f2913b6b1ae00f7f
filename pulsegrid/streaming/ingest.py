"""Incremental ingest: rows and counters kept up to date as files land.

Three ways in, all restartable at any point:

* ``ingest_unique``: insert-or-ignore without a bound on lateness. What is stored is a table split by period and by a
  hash bucket of the key; a micro-batch is compared only with the buckets its own keys fall into. ``compact`` rewrites
  many small batches as one generation.
* ``ingest_within_watermark``: insert-or-ignore with Spark's state store and a bound on lateness. Rows that come later
  than that are not lost: they go to a rejected set.
* ``ingest_counters``: grouped counters as streaming state in update mode; every batch stores the groups it changed,
  and the latest batch of a group holds its counters.

A micro-batch writes one folder named by its number and replaces it when it is run again, so a retry changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import regions
from pulsegrid.session import durable

C = F.col
BATCH, BUCKET = "batch_id", "bucket"
#: Session setting with the bytes a micro-batch may take from the landed files, and its default: what a cluster reads in a short pass.
BATCH_BYTES_SETTING, BATCH_BYTES = "spark.pulsegrid.ingest.maxBytesPerBatch", 64 << 30
BUCKETS = 64


def batch_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BATCH_BYTES_SETTING, str(BATCH_BYTES)))


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, bytes_per_batch: int | None = None,
) -> DataFrame:
    """New files as they land; a micro-batch is bounded by files, by bytes, or by what has landed."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that has landed, batch by batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, path: str, schema: T.StructType, extra: list[T.StructField]) -> DataFrame | None:
    """A stored table with its partition columns, or None before anything was written."""
    if not _exists(spark, path):
        return None
    names = set(schema.names)
    return spark.read.schema(T.StructType([*schema.fields, *[f for f in extra if f.name not in names]])).parquet(path)


# -- insert or ignore, any lateness ------------------------------------------------------

_GENERATIONS = "generation long, upto long"
_PARTITIONS = [T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _generation(spark: SparkSession, target: str) -> tuple[int, int]:
    """Number of the last generation, and the last batch it holds; (0, -1) without one."""
    if not _exists(spark, f"{target}/generations"):
        return 0, -1
    last = spark.read.schema(_GENERATIONS).parquet(f"{target}/generations").agg(F.max(F.struct("generation", "upto")).alias("last")).first()["last"]
    return (last["generation"], last["upto"]) if last else (0, -1)


def stored_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame | None:
    """Rows with batch_id and bucket: the last generation and the batches after it; None before the first batch."""
    generation, upto = _generation(spark, target)
    batches = _stored(spark, f"{target}/batches", schema, _PARTITIONS)
    if batches is not None:
        batches = batches.filter(C(BATCH) > upto)
    if not generation:
        return batches
    # compacted rows are older than any batch
    compacted = _stored(spark, f"{target}/generation-{generation}", schema, _PARTITIONS[1:]).withColumn(BATCH, F.lit(-1).cast("long"))
    return compacted if batches is None else compacted.unionByName(batches)


def known_keys(stored: DataFrame, key: list[str], period: str, cells: list[tuple], number: int) -> DataFrame:
    """Stored keys of the buckets that a batch falls into. Partition filters: other buckets' files aren't opened."""
    periods, buckets = sorted({p for p, _ in cells if p is not None}), sorted({b for _, b in cells})
    same = C(period).isin(periods)
    if any(p is None for p, _ in cells):
        same = same | C(period).isNull()
    return stored.filter((C(BATCH) < number) & C(BUCKET).isin(buckets) & same).select(*key)


def _write_buckets(rows: DataFrame, period: str, path: str) -> None:
    """One file per period and bucket, however many tasks read the rows: a bucket is a hash's share of its period.

    Opening files is most of the work, so all cores write.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows.repartition(tasks, period, BUCKET).write.mode("overwrite").partitionBy(period, BUCKET).parquet(path)


def ingest_unique(stream: DataFrame, key: list[str], period: str, target: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Insert-or-ignore into a table split by period and key bucket; order and repeats do not matter, however late.

    ``period`` must be part of ``key``. Copies inside a batch are reduced by a grouped aggregate, which combines in the
    map tasks; of several copies the one that comes first by its values stays, so a retry stores the same row.
    ``buckets`` must stay the same for a target.
    """
    if period not in key:
        raise ValueError("the period column must be part of the key")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*key).agg(F.min(F.struct(*schema.names)).alias("_row")).select("_row.*")
        fresh = durable(fresh.withColumn(BUCKET, bucket_of(key, buckets)), "landed")  # the batch is read once
        stored = stored_rows(spark, target, schema)
        if stored is not None:
            cells = [(r[0], r[1]) for r in fresh.select(period, BUCKET).distinct().collect()]  # at most periods x buckets
            known = known_keys(stored, key, period, cells, number).withColumnsRenamed({k: f"_{k}" for k in key})
            same = [C(k).eqNullSafe(C(f"_{k}")) for k in key]
            fresh = fresh.join(known, same, "left_anti")
        _write_buckets(fresh, period, f"{target}/batches/{BATCH}={number}")

    _run(stream, write, checkpoint)


def read_unique(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All stored rows; none before the first batch."""
    stored = stored_rows(spark, target, schema)
    return spark.createDataFrame([], schema) if stored is None else stored.select(*schema.names)


def compact(spark: SparkSession, target: str, schema: T.StructType, period: str) -> None:
    """Rewrite all stored rows as one generation, a file or so per bucket; called while no ingest runs.

    The generation counts once its row is committed; a stop before that leaves the batches as they are.
    """
    batches = _stored(spark, f"{target}/batches", schema, _PARTITIONS)
    last = batches.agg(F.max(BATCH).alias("last")).first()["last"] if batches is not None else None
    generation, upto = _generation(spark, target)
    if last is None or last <= upto:
        return
    rows = stored_rows(spark, target, schema).select(*schema.names, BUCKET)
    _write_buckets(rows, period, f"{target}/generation-{generation + 1}")
    spark.createDataFrame([(generation + 1, last)], _GENERATIONS).coalesce(1).write.mode("append").parquet(f"{target}/generations")


# -- insert or ignore within a bound on lateness ----------------------------------------------

def ingest_within_watermark(
    spark: SparkSession, path: str, schema: T.StructType, key: list[str], event_time: str, lateness: str, target: str, rejected: str, checkpoint: str,
    bytes_per_batch: int | None = None, files_per_batch: int | None = None,
) -> None:
    """First row of every key, as streaming state that ends ``lateness`` after its event time.

    Spark drops what is later than the watermark without a trace. So after the stream has taken all files, the rows of the
    files that are new since the last call and whose key isn't in the target are stored below ``rejected``: every landed key
    is in one of the two. Rows without event time never expire state and are kept like others of the current watermark.
    """
    landed = _files(spark, path)
    stream = read_stream(spark, path, schema, files_per_batch, bytes_per_batch)
    unique = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(key)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    _run(unique, write, checkpoint)
    _reject_late(spark, landed, schema, key, target, rejected)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files that have landed, as a stored table."""
    return durable(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path"), "landed-files")


def _reject_late(spark: SparkSession, landed: DataFrame, schema: T.StructType, key: list[str], target: str, rejected: str) -> None:
    examined = spark.read.schema("path string, run long").parquet(f"{rejected}/examined") if _exists(spark, f"{rejected}/examined") else None
    run = 0 if examined is None else (examined.agg(F.max("run").alias("run")).first()["run"] or 0) + 1
    fresh = landed if examined is None else landed.join(examined, "path", "left_anti")
    paths = [row.path for row in fresh.collect()]  # a name per new file, as the file source's own log holds them
    if not paths:
        return
    known = read_accepted(spark, target, schema).select(*[C(k).alias(f"_{k}") for k in key])
    late = spark.read.schema(schema).parquet(*paths).join(known, [C(k).eqNullSafe(C(f"_{k}")) for k in key], "left_anti")
    late.write.mode("overwrite").parquet(f"{rejected}/rows/run={run}")
    fresh.withColumn("run", F.lit(run).cast("long")).coalesce(1).write.mode("append").parquet(f"{rejected}/examined")


def read_accepted(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    stored = _stored(spark, target, schema, _PARTITIONS[:1])
    return spark.createDataFrame([], schema) if stored is None else stored.select(*schema.names)


def read_rejected(spark: SparkSession, rejected: str, schema: T.StructType) -> DataFrame:
    """Rows of keys that came too late, repeats included."""
    stored = _stored(spark, f"{rejected}/rows", schema, [T.StructField("run", T.LongType())])
    return spark.createDataFrame([], schema) if stored is None else stored.select(*schema.names)


# -- counters -----------------------------------------------------------------------------

def ingest_counters(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> None:
    """Additive counters of each group as streaming state; a batch stores the counters of the groups it changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    _run(regions.region_counters(stream, keys), write, checkpoint, "update")


def read_counters(spark: SparkSession, keys: list[str], target: str) -> DataFrame:
    """Counters of every group: those of the last batch that changed it."""
    stored = spark.read.parquet(target)
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*regions.COUNTERS), BATCH).alias("now"))
    return latest.select(*keys, *[C(f"now.{name}").alias(name) for name in regions.COUNTERS])


def current_report(spark: SparkSession, keys: list[str], target: str) -> DataFrame:
    """Region report of all batches so far; small groups are hidden on reading."""
    rates = regions.label_rates(read_counters(spark, keys, target)).select(*keys, *regions.HIDDEN)
    return regions.suppress_small(rates, parents=keys[:-1] or None, keys=keys).drop("parent_exposed")
