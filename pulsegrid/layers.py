"""The layered batch chain: source CSV, cleaned rows, feature layer, reports.

Each step reads one folder and writes another; layers are Parquet, reports are
header CSV. Run them one after the other in one session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.operators import population
from pulsegrid.operators.quantiles import impute_medians
from pulsegrid.session import durable
from pulsegrid.sources import files

C = F.col
NUMERIC = [*contract.FEATURES, *contract.LABELS, "target_disease"]
WHOLE = [name for name in NUMERIC if name != "bmi"]


def read_source(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Source CSV by its header: health fields as numbers, everything else as text.

    Only headers are looked at before the scan; files may order their columns
    differently. Health fields are read as doubles, so that a code written as
    ``2.0`` is kept.
    """
    header = list(next(iter(files.csv_headers(spark, path, separator, encoding)), ()))
    schema = T.StructType([
        T.StructField(name, contract.DOUBLE if name in NUMERIC else contract.STRING, True) for name in header])
    return files.read_csv(spark, path, schema, separator, encoding)


def clean_layer(spark: SparkSession, source: str, target: str, separator: str = ",", encoding: str = "UTF-8") -> None:
    """Source CSV to cleaned rows; codes become integers after the domain checks."""
    cleaned = cleaning.clean(read_source(spark, source, separator, encoding))
    whole = {name: C(name).cast("int") for name in WHOLE if name in cleaned.columns}
    files.write_layer(cleaned.withColumns(whole), target)


def feature_layer(spark: SparkSession, source: str, target: str) -> None:
    """Cleaned rows to features without gaps (median element), with a weight column."""
    files.write_layer(cleaning.feature_layer(impute_medians(files.read_layer(spark, source))), target)


def population_layer(spark: SparkSession, source: str, target: str) -> None:
    """Mean rates by district, written below ``target/district``."""
    files.write_csv(population.district_means(files.read_layer(spark, source)), f"{target}/district")


def screening_layer(spark: SparkSession, source: str, target: str) -> None:
    """All residents to follow up, most urgent first."""
    files.write_csv(population.ranked_follow_ups(files.read_layer(spark, source)), target)


def training_input(spark: SparkSession, source: str) -> DataFrame:
    """Training table from the cleaned layer, stored once for both models."""
    return durable(cleaning.training_table(files.read_layer(spark, source)), "training")
