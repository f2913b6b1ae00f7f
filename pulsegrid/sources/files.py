"""File sources and sinks of the layered tables."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import contract
from pulsegrid.functions.numeric import count_if, round_exact

C = F.col
BAD_ROW = "_bad_row"
#: Bytes of a file that are in memory while it is hashed.
HASHED_BYTES = 4 << 20
#: Bytes in which a CSV file's header ends.
HEADER_BYTES = 1 << 16


def csv_headers(spark: SparkSession, path: str | list[str], separator: str = ",", encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """Files by their header. Tasks read the first HEADER_BYTES of every file, nothing else; files without a line are left out."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").filter(C("length") > 0)
    first = listed.first()
    if first is None:
        return {}
    try:
        _opened(first.path)
    except (pa.ArrowException, ValueError, OSError):  # only Spark opens this store: its reader compares every header with the first one
        columns = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).csv(path).columns
        return {tuple(columns): [path] if isinstance(path, str) else list(path)}

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for place in batch["path"].to_pylist():
                system, name = _opened(place)
                with system.open_input_stream(name) as stream:
                    text = stream.read(HEADER_BYTES).decode(encoding, "replace").lstrip("\ufeff")
                found.append(next(csv.reader(text.splitlines()[:1], delimiter=separator), []))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, pa.list_(pa.string()))], names=["path", "header"])

    rows = listed.mapInArrow(headers, "path string, header array<string>").filter(F.size("header") > 0)
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in rows.orderBy("path").collect():  # a name a file, as the reader's own listing holds them
        groups.setdefault(tuple(row.header), []).append(row.path)
    return groups


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType,
    separator: str = ",", encoding: str = "UTF-8", keep_bad_rows: bool = False,
) -> DataFrame:
    """Header CSV with an explicit schema, so no pass over the data is spent on inference.

    Columns are bound by name: files are grouped by their header and each group is read in its own order; columns beyond the
    schema are passed over, a file that lacks one is refused. With ``keep_bad_rows`` unreadable lines are kept in ``_bad_row``.
    """
    names, frame = schema.names, None
    for header, paths in csv_headers(spark, path, separator, encoding).items():
        missing = sorted(set(names) - set(header))
        if missing or len(set(header)) < len(header):
            raise ValueError(f"{paths[0]} lacks columns {missing}" if missing else f"{paths[0]} repeats a column")
        fields = [schema[name] if name in names else T.StructField(name, T.StringType()) for name in header]
        reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("enforceSchema", False)
        if keep_bad_rows:
            fields.append(T.StructField(BAD_ROW, T.StringType(), True))
            reader = reader.option("columnNameOfCorruptRecord", BAD_ROW)
        part = reader.schema(T.StructType(fields)).csv(paths).select(*names, *([BAD_ROW] if keep_bad_rows else []))
        frame = part if frame is None else frame.unionByName(part)
    if frame is None:
        extra = [T.StructField(BAD_ROW, T.StringType(), True)] if keep_bad_rows else []
        return spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
    return frame


def write_csv(df: DataFrame, path: str, separator: str = ",", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).option(
        "encoding", encoding).csv(path)


def write_layer(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Overwrite a Parquet layer, split by the given low-cardinality columns.

    Rows are written where they are: no shuffle by the partition column, so one
    large district cannot end up in a single task.
    """
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


def read_layer(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def register_layers(spark: SparkSession, database: str, location: str, ods: str, dws: str, ads: str) -> None:
    """External tables over the three layers: CSV source, Parquet features, CSV report."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    tables = [
        ("ods_resident_health", contract.ODS_SCHEMA, "CSV", "OPTIONS (header 'true', sep ',', enforceSchema 'false')", ods),
        ("dws_cardio_features", contract.DWS_SCHEMA, "PARQUET", "", dws),
        ("ads_region_risk_summary", contract.ADS_SCHEMA, "CSV", "OPTIONS (header 'true', sep ',', enforceSchema 'false')", ads),
    ]
    for name, schema, kind, options, path in tables:
        columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING {kind} {options} LOCATION '{path}'")


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path as Spark names it."""
    scheme, _, rest = path.partition(":")
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}")


def file_hashes(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Path, name, length and SHA-256 of each file, of any size.

    Spark lists the files; a task streams each of its files through the hash in blocks of HASHED_BYTES, so its memory does
    not depend on their length. Stores that only Spark can open are read by Spark, whose binary reader takes files up to 2 GiB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    listed = files.select("path", "length")
    first = listed.first()
    if first is None:
        return files.select("path", name, "length", F.lit(None).cast("string").alias("sha256"))
    try:
        _opened(first.path)
    except (pa.ArrowException, ValueError, OSError):
        return files.select("path", name, "length", F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                system, place = _opened(batch["path"][row].as_py())
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while block := stream.read(HASHED_BYTES):
                        digest.update(block)
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([one["path"], one["length"], pa.array([digest.hexdigest()])], names=["path", "length", "sha256"])

    # a reader's split may hold many files: they are dealt out anew, a file each
    dealt = listed.repartition("path").mapInArrow(hashed, "path string, length long, sha256 string")
    return dealt.select("path", name, "length", "sha256")


def merge_files(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Concatenate chunks by column name."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """First rows by key with the shape of the whole table beside them."""
    shape = {"table_rows": F.lit(df.count()).cast("bigint"), "table_columns": F.lit(len(df.columns))}
    return df.orderBy(key).limit(rows).withColumns(shape)


def profile(df: DataFrame) -> DataFrame:
    """Observed rates with six decimals, one row per rate, with the table's size beside them."""
    rates = {
        "hypertension": C("hypertension") == 1,
        "diabetes": C("diabetes") == 1,
        "cholesterol_abnormal": C("cholesterol") >= 2,
        "current_smoker": C("smoker") == 2,
        "overweight": C("bmi") >= 25,
        "obesity": C("bmi") >= 30,
        "exercise": C("exercise") == 1,
        "alcohol": C("alcohol") == 1,
        "target_disease_0": C("target_disease") == 0,
        "target_disease_1": C("target_disease") == 1,
        "target_disease_2": C("target_disease") == 2,
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), count_if(test).alias("hits")) for name, test in rates.items()
    ])
    counted = df.agg(F.count(F.lit(1)).alias("rows"), rows.alias("rates"))
    return counted.select("rows", F.inline("rates")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), "metric",
        round_exact(C("hits").cast("double") / C("rows").cast("double"), 6).alias("rate"),
    )
