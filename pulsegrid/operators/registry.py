"""Registered models: immutable versions, a manifest with hashes, and the switch of the active version.

    versions/<version>/<target>/...   artifacts, written once
    versions/<version>/manifest       one row per target, written after all artifacts
    activations                       one row per switch, appended

A version is active once its row in ``activations`` is committed, and that is the last thing registration does. Spark
makes an appended file visible as a whole, so a stop at any earlier point leaves the version that was active before.
Loading checks the feature contract and the SHA-256 of every artifact against the manifest.
"""

from __future__ import annotations

import platform
import uuid
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.operators import training
from pulsegrid.sources.files import file_hashes

MANIFEST = (
    "version string, created_at timestamp, strategy string, target string, estimator string, features array<string>, threshold double, "
    "added_rows long, metrics map<string,double>, runtime map<string,string>, artifacts array<struct<file:string, length:bigint, sha256:string>>"
)
ACTIVATIONS = "sequence long, version string, activated_at timestamp"
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def _runtime() -> dict[str, str]:
    return {"python": platform.python_version(), **{name: metadata.version(name) for name in PACKAGES}}


def artifacts(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    """(path below the folder, length, SHA-256) of all files of a saved model."""
    found = file_hashes(spark, folder, recursive=True).select("path", "length", "sha256").collect()
    mark = f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/"
    return sorted((row.path.split(mark, 1)[1], row.length, row.sha256) for row in found)


def register(spark: SparkSession, models: dict[str, training.RiskModel], root: str, strategy: str) -> str:
    """Store the models as a new version with its manifest; it isn't active yet. Returns the version."""
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    folder = f"{root}/versions/{version}"
    rows = []
    for target, model in models.items():
        training.save_model(spark, model, f"{folder}/{target}")
        rows.append((
            version, now, strategy, target, type(model.estimator).__name__, list(contract.FEATURES), model.threshold, model.added_rows,
            {name: float(value) for name, value in (model.metrics or {}).items()}, _runtime(), artifacts(spark, f"{folder}/{target}"),
        ))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return version


def _activations(spark: SparkSession, root: str) -> DataFrame | None:
    """None before the first switch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/activations")
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(ACTIVATIONS).parquet(f"{root}/activations") if exists else None


def active_version(spark: SparkSession, root: str) -> str | None:
    """The version of the last switch; of switches that ran at once, the later version."""
    switches = _activations(spark, root)
    last = switches.agg(F.max(F.struct("sequence", "version")).alias("last")).first() if switches is not None else None
    return last["last"]["version"] if last is not None and last["last"] is not None else None


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Switch to a registered version; its artifacts are checked first."""
    verify(spark, root, version)
    switches = _activations(spark, root)
    sequence = (switches.agg(F.max("sequence").alias("s")).first()["s"] or 0) + 1 if switches is not None else 1
    spark.createDataFrame([(sequence, version, datetime.now(timezone.utc))], ACTIVATIONS).coalesce(1).write.mode("append").parquet(f"{root}/activations")


def manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/versions/{version}/manifest")


def verify(spark: SparkSession, root: str, version: str) -> list:
    """Manifest rows of a version whose files are all there and unchanged."""
    rows = manifest(spark, root, version).collect()
    if {row.target for row in rows} != set(training.TARGETS):
        raise ValueError(f"version {version} does not have one model per target")
    for row in rows:
        if list(row.features) != contract.FEATURES:
            raise ValueError("saved models do not fit the feature contract")
        known = sorted((a.file, a.length, a.sha256) for a in row.artifacts)
        if artifacts(spark, f"{root}/versions/{version}/{row.target}") != known:
            raise ValueError(f"files of the {row.target} model of version {version} differ from its manifest")
    return rows


def load_active(spark: SparkSession, root: str) -> tuple[dict[str, training.RiskModel], DataFrame]:
    """The active models, checked, and their manifest."""
    version = active_version(spark, root)
    if version is None:
        raise FileNotFoundError("no model version is active")
    rows = verify(spark, root, version)
    models = {
        row.target: training.load_model(
            spark, f"{root}/versions/{version}/{row.target}", row.target, row.estimator, row.threshold, row.added_rows, dict(row.metrics))
        for row in rows
    }
    return models, manifest(spark, root, version)


def best_rounds(runs: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The run log's best round of every target by a measure; of equal ones the first."""
    order = F.struct(F.col(metric), -F.col("round"))
    return runs.groupBy("target").agg(F.max_by(F.struct("run_label", "round", metric), order).alias("best")).select(
        "target", F.col("best.run_label").alias("run_label"), F.col("best.round").alias("best_round"), F.col(f"best.{metric}").alias(metric))

