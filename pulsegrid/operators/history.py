"""Assessment history and dataset registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import grading
from pulsegrid.functions.privacy import is_client_id, keyed_pseudonym

C = F.col

SUMMARY_COLUMNS = [
    "assessment_id", "model_version", "knowledge_version", "heart_probability", "stroke_probability",
    "risk_level_code", "risk_level_name", "final_category", "created_at",
]


def new_records(df: DataFrame, key: bytes, knowledge_version: str) -> DataFrame:
    """History rows from scored input: the client id is replaced by its keyed pseudonym.

    Rows whose client id is malformed are not accepted.
    """
    level = grading.level_code(grading.overall_probability(C("heart_probability"), C("stroke_probability")))
    return (
        df.filter(is_client_id(C("client_id")))
        .withColumns({
            "client_hash": keyed_pseudonym(C("client_id"), key),
            "knowledge_version": F.lit(knowledge_version),
            "risk_level_code": level,
            "final_category": grading.final_category(C("heart_probability"), C("stroke_probability")),
        })
        .withColumn("risk_level_name", grading.level_name(C("risk_level_code")))
        .drop("client_id")
    )


def record_summary(records: DataFrame) -> DataFrame:
    """What a client may see: no hash, no input."""
    level = F.coalesce("risk_level_code", F.lit(1))
    return records.withColumns({
        "heart_probability": F.coalesce("heart_probability", F.lit(0.0)),
        "stroke_probability": F.coalesce("stroke_probability", F.lit(0.0)),
        "risk_level_code": level,
        "risk_level_name": F.coalesce("risk_level_name", grading.level_name(level)),
        "final_category": F.coalesce("final_category", F.lit(0)),
    }).select(*SUMMARY_COLUMNS)


def latest_records(records: DataFrame, limit: int = 10) -> DataFrame:
    """Newest records of every client, limit held within 1 to 50.

    The rank filter lets Spark keep at most ``limit`` rows per client in each
    map task before the shuffle, so a client owning a third of all records sends
    only a few rows per task.
    """
    kept = max(1, min(int(limit), contract.HISTORY_LIMIT))
    newest = Window.partitionBy("client_hash").orderBy(C("created_at").desc(), "assessment_id")
    return records.withColumn("position", F.row_number().over(newest)).filter(C("position") <= kept)


def owned_records(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records asked for by their owner; unknown and foreign records are both simply absent."""
    wanted = requests.select("assessment_id", "client_hash").distinct()
    return records.join(wanted, ["assessment_id", "client_hash"], "left_semi")


def newest_datasets(datasets: DataFrame, limit: int = 50) -> DataFrame:
    return datasets.orderBy(C("upload_time").desc(), "dataset_id").limit(int(limit))


def analysed_datasets(datasets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Registered datasets whose task succeeded."""
    succeeded = tasks.filter(C("status") == "success").select("task_id", "status", "data_period")
    return datasets.join(succeeded, "task_id")
