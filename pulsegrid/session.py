"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; extra settings win.

    For large data pass ``spark.sql.shuffle.partitions`` of about shuffled bytes
    / 128 MiB; adaptive execution merges what turns out small.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # generated methods beyond this size are not compiled by the JVM; such stages run operator by operator
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # no Python call-site capture on every column operation
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # lets the CSV reader take national character sets such as GBK
        "spark.sql.legacy.javaCharsets": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def package_archive(folder: str) -> str:
    """A zip of this package's modules in ``folder``; the same modules make the same bytes."""
    root = Path(__file__).resolve().parent
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            entry = zipfile.ZipInfo(f"{root.name}/{module.relative_to(root).as_posix()}", (1980, 1, 1, 0, 0, 0))
            archive.writestr(entry, module.read_bytes(), zipfile.ZIP_DEFLATED)
    return str(path)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application: functions sent to them name its modules.

    The archive is made beside the driver; Spark copies it to every executor, also to ones that start later.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        context.addPyFile(package_archive(tempfile.mkdtemp(prefix="pulsegrid-package-")))
        _SHIPPED.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an
    unset folder is an error, because executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several jobs: the copy survives lost executors,
    cuts the lineage, and its size is known to the planner.
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
