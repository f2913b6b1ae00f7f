"""The given star-schema tables, and the health tables derived from them.

The given tables hold no health data, so residents, uploads, datasets and
assessment history are derived row by row with plain arithmetic. The rules are
deterministic and also written as SQL in ``plans/checks.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Schemas of the given tables, so that opening one costs no look into its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


PLACE = [
    "o_orderkey + 510100000001 AS resident_id", "region", "district",
    "CAST(c_nationkey * 1000 + c_custkey % 100 AS BIGINT) AS community_id",
    "o_orderdate AS snapshot_date", "c_name AS name",
    "(o_orderkey * 7919 + 13) % 10007 AS h1", "(o_orderkey * 104729 + 31) % 10009 AS h2",
    "(o_orderkey * 1299709 + 97) % 10037 AS h3", "(o_orderkey * 15485863 + 7) % 10039 AS h4",
]
BODY = [
    "*",
    "int(if(h2 % 97 = 0, -1, 18 + h1 % 78)) AS age",
    "int(h2 % 2) AS gender",
    "if(h4 % 53 = 0, NULL, double(1600 + h3 % 2900) / 100) AS bmi",
    "int(if(h1 % 101 = 0, 9, 1 + h4 % 3)) AS cholesterol",
    "int(h1 % 100 < 16) AS diabetes",
    "int(h2 % 100 < 34) AS hypertension",
    "int(if(h4 % 211 = 0, 5, h3 % 3)) AS smoker",
    "int(h4 % 100 < 43) AS alcohol",
    "int((h1 + h2) % 100 < 25) AS exercise",
]
RESIDENT = [
    "resident_id", "region", "district", "community_id", "snapshot_date", "name",
    "concat('138', lpad(string((h1 * 9973 + h2) % 100000000), 8, '0')) AS phone",
    "age", "gender", "bmi", "cholesterol", "diabetes", "hypertension", "smoker", "alcohol", "exercise",
    "CASE WHEN age BETWEEN 18 AND 39 THEN '18-39' WHEN age BETWEEN 40 AND 59 THEN '40-59' "
    "WHEN age BETWEEN 60 AND 74 THEN '60-74' WHEN age BETWEEN 75 AND 90 THEN '75-90' END AS age_group",
    "int(age + 20 * hypertension + 12 * diabetes + h3 % 40 >= 95) AS label_heart",
    "int(age + 25 * hypertension + h4 % 50 >= 110) AS label_stroke",
    "double(90 + h3 % 100) AS systolic_bp", "double(50 + h2 % 70) AS diastolic_bp",
    "double(350 + h4 % 600) / 100 AS fasting_glucose",
    "int((h1 + h3) % 7 = 0) AS family_history",
    "double(1450 + h2 % 500) / 10 AS height_cm",
    "date_format(snapshot_date, 'yyyy-MM') AS data_period",
]


def residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resident per order, placed by the customer's nation and region.

    ``nation`` and ``region`` are fixed at 25 and 5 rows, so they are broadcast;
    ``customer`` grows with the data and is left to the optimizer.
    """
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), C("n_regionkey") == C("r_regionkey"))
        .select("n_nationkey", C("n_name").alias("district"), C("r_name").alias("region"))
    )
    placed = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"),
            C("o_custkey") == C("c_custkey"),
        )
        .join(F.broadcast(places), C("c_nationkey") == C("n_nationkey"))
    )
    return placed.selectExpr(*PLACE).selectExpr(*BODY).selectExpr(*RESIDENT)


def upload_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload task per order; the number of expected parts comes from the customer key."""
    return table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("task_id"),
        (1 + C("o_custkey") % 7).cast("int").alias("total_chunks"),
        F.when(C("o_orderstatus") == "F", "success").when(C("o_orderstatus") == "O", "running")
        .otherwise("failed").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM").alias("data_period"),
        C("o_orderdate").alias("created_at"),
    )


def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received parts, one per line item; re-sent parts occur."""
    return table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("task_id"),
        (C("l_linenumber") - 1).cast("int").alias("chunk_index"),
        (C("l_quantity") * 1024).cast("bigint").alias("chunk_size"),
        F.concat_ws("/", C("l_partkey").cast("string"), C("l_suppkey").cast("string")).alias("chunk_path"),
        C("l_shipdate").alias("created_at"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset registration for every upload task that has a total price."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ds-"), C("o_orderkey").cast("string")).alias("dataset_id"),
        C("o_orderkey").alias("task_id"),
        C("o_orderdate").alias("upload_time"),
        (C("o_totalprice") / 10).cast("bigint").alias("row_count"),
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessment history, one record per event."""
    value = C("value")
    heart = F.floor(value * 7) % 1000 / 1000
    stroke = F.floor(value * 13) % 1000 / 1000
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("asm_"), C("event_id").cast("string")).alias("assessment_id"),
        F.concat(F.lit("client-"), F.lpad(C("user_id").cast("string"), 8, "0")).alias("client_id"),
        C("ts").alias("created_at"),
        C("event_type").alias("model_version"),
        heart.alias("heart_probability"),
        stroke.alias("stroke_probability"),
        C("props").alias("input_json"),
    )
