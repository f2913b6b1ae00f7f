"""History, uploads, trends, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.grading import DEMO_WEIGHTS, demo_probability
from pulsegrid import contract
from pulsegrid.operators import history, trends, uploads
from pulsegrid.plans.checks import pct, scored_sql, with_parts, with_residents
from pulsegrid.plans.grading_queries import CATEGORY, DEMO_KEY, HASH_SQL, LEVEL, case_text
from pulsegrid.plans.registry import query
from pulsegrid.plans.scoring_base import SCORED_PARTS, complete_residents
from pulsegrid.functions import fixed_values as V
from pulsegrid.sources import tables

C = F.col

RECORDS = f"""
WITH raw AS (
  SELECT 'asm_' || CAST(event_id AS VARCHAR) AS assessment_id,
    'client-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS client, ts AS created_at, event_type AS model_version,
    (CAST(floor(value * 7) AS BIGINT) % 1000) / 1000.0::DOUBLE AS heart_probability,
    (CAST(floor(value * 13) AS BIGINT) % 1000) / 1000.0::DOUBLE AS stroke_probability
  FROM events
), records AS (
  SELECT *, {HASH_SQL} AS client_hash, {LEVEL} AS risk_level_code, {CATEGORY} AS final_category FROM raw
)
"""


def records(spark, sf_dir):
    return history.new_records(tables.assessments(spark, sf_dir), DEMO_KEY, "demo-rules-1")


@query("p30_record_summary", RECORDS + f"""
SELECT assessment_id, model_version, 'demo-rules-1' AS knowledge_version, heart_probability, stroke_probability,
  risk_level_code, {case_text('risk_level_code', {c: n for c, n, _ in V.RISK_LEVELS})} AS risk_level_name,
  final_category, created_at FROM records""")
def record_summary(spark, sf_dir):
    return history.record_summary(records(spark, sf_dir))


@query("w01_latest_records", RECORDS + """
SELECT client_hash, assessment_id, created_at, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY client_hash ORDER BY created_at DESC, assessment_id) AS position
  FROM records) q WHERE position <= 10""")
def latest_records(spark, sf_dir):
    return history.latest_records(records(spark, sf_dir), 10).select(
        "client_hash", "assessment_id", "created_at", "position")


@query("j05_owned_records", RECORDS + """
SELECT r.assessment_id, r.heart_probability FROM records r
JOIN events e ON r.assessment_id = 'asm_' || CAST(e.event_id AS VARCHAR)
WHERE r.client = 'client-' || lpad(CAST(e.user_id - e.event_id % 2 AS VARCHAR), 8, '0')""")
def owned_records(spark, sf_dir):
    """Every record is asked for once, half of the times by the wrong client."""
    asked = tables.table(spark, sf_dir, "events").select(
        F.concat(F.lit("asm_"), C("event_id").cast("string")).alias("assessment_id"),
        F.concat(F.lit("client-"), F.lpad((C("user_id") - C("event_id") % 2).cast("string"), 8, "0")).alias("client_id"),
    )
    requests = asked.select(
        "assessment_id", history.keyed_pseudonym(C("client_id"), DEMO_KEY).alias("client_hash"))
    return history.owned_records(records(spark, sf_dir), requests).select("assessment_id", "heart_probability")


@query("j06_analysed_datasets", """
SELECT 'ds-' || CAST(o_orderkey AS VARCHAR) AS dataset_id, strftime(o_orderdate, '%Y-%m') AS data_period
FROM orders WHERE o_orderstatus = 'F'""")
def analysed_datasets(spark, sf_dir):
    return history.analysed_datasets(tables.datasets(spark, sf_dir), tables.upload_tasks(spark, sf_dir)).select(
        "dataset_id", "data_period")


@query("t04_newest_datasets", """
SELECT 'ds-' || CAST(o_orderkey AS VARCHAR) AS dataset_id, o_orderdate AS upload_time
FROM orders ORDER BY o_orderdate DESC, dataset_id LIMIT 50""")
def newest_datasets(spark, sf_dir):
    return history.newest_datasets(tables.datasets(spark, sf_dir)).select("dataset_id", "upload_time")


TASKS = """
WITH tasks AS (SELECT o_orderkey AS task_id, CAST(1 + o_custkey % 7 AS INTEGER) AS total_chunks FROM orders),
parts AS (SELECT l_orderkey AS task_id, l_linenumber - 1 AS chunk_index, CAST(l_quantity * 1024 AS BIGINT) AS chunk_size,
  CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS chunk_path, l_shipdate AS created_at FROM lineitem)
"""


@query("j03_missing_parts", TASKS + """
SELECT task_id, chunk_index FROM (
  SELECT task_id, unnest(range(total_chunks)) AS n FROM tasks) e, LATERAL (SELECT CAST(e.n AS INTEGER) AS chunk_index) c
WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.task_id = e.task_id AND p.chunk_index = e.n)""")
def missing_parts(spark, sf_dir):
    return uploads.missing_parts(tables.upload_tasks(spark, sf_dir), tables.upload_parts(spark, sf_dir))


@query("a17_task_completeness", TASKS + """
SELECT t.task_id, t.total_chunks, count(DISTINCT p.chunk_index) AS received,
  CAST(min(p.chunk_index) AS INTEGER) AS first_part, CAST(max(p.chunk_index) AS INTEGER) AS last_part,
  count(DISTINCT p.chunk_index) = t.total_chunks AS complete
FROM tasks t LEFT JOIN parts p ON t.task_id = p.task_id AND p.chunk_index >= 0 AND p.chunk_index < t.total_chunks
GROUP BY t.task_id, t.total_chunks""")
def task_completeness(spark, sf_dir):
    return uploads.task_completeness(tables.upload_tasks(spark, sf_dir), tables.upload_parts(spark, sf_dir))


@query("u04_first_parts", TASKS + """
SELECT task_id, chunk_index, chunk_size, chunk_path FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, chunk_index ORDER BY created_at, chunk_path, chunk_size) AS n
  FROM parts) q WHERE n = 1""")
def first_parts(spark, sf_dir):
    return uploads.first_parts(tables.upload_parts(spark, sf_dir)).select(
        "task_id", "chunk_index", "chunk_size", "chunk_path")


_BOTH = "sum(CASE WHEN label_heart = 1 AND label_stroke = 1 THEN 1 ELSE 0 END)"


@query("w08_trend_series", with_residents(f"""
SELECT *, count(*) OVER (PARTITION BY coverage_name, model_version) AS points,
  CAST(row_number() OVER (PARTITION BY coverage_name, model_version ORDER BY data_period) AS INTEGER) AS position,
  count(*) OVER (PARTITION BY coverage_name, model_version) >= 2 AS available
FROM (SELECT data_period, district AS coverage_name, 'v' || substr(data_period, 1, 4) AS model_version,
    count(*) AS sample_size, {pct('sum(label_heart)', 'count(*)')} AS heart_risk_rate,
    {pct('sum(label_stroke)', 'count(*)')} AS stroke_risk_rate, {pct(_BOTH, 'count(*)')} AS comorbidity_rate
  FROM residents GROUP BY ALL) q"""))
def trend_series(spark, sf_dir):
    version = F.concat(F.lit("v"), F.substring("data_period", 1, 4))
    rows = trends.snapshots(tables.residents(spark, sf_dir), "district", version)
    return trends.trend_series(rows).select(
        "data_period", "coverage_name", "model_version", "sample_size", "heart_risk_rate", "stroke_risk_rate",
        "comorbidity_rate", "points", "position", "available")


_CHANGED = """
complete AS (SELECT * REPLACE (0 AS hypertension, 0 AS smoker, 1 AS exercise, least(bmi, 24.0::DOUBLE) AS bmi)
  FROM base)"""


def _scenario_check() -> str:
    before = SCORED_PARTS[1].replace("scored AS", "before AS")
    after = scored_sql(DEMO_WEIGHTS, contract.FEATURES).replace("scored AS", "after AS").replace(
        "FROM complete", "FROM changed")
    changed = _CHANGED.replace("complete AS", "changed AS").replace("FROM base", "FROM complete")
    return with_parts([SCORED_PARTS[0], before, changed, after], """
SELECT b.resident_id, b.heart_probability AS baseline_heart_probability,
  b.stroke_probability AS baseline_stroke_probability, a.heart_probability AS scenario_heart_probability,
  a.stroke_probability AS scenario_stroke_probability,
  a.heart_probability - b.heart_probability AS heart_probability_change,
  a.stroke_probability - b.stroke_probability AS stroke_probability_change
FROM before b JOIN after a ON b.resident_id = a.resident_id""")


@query("j07_scenario_comparison", _scenario_check())
def scenario_comparison(spark, sf_dir):
    changes = {"hypertension": F.lit(0), "smoker": F.lit(0), "exercise": F.lit(1), "bmi": F.least("bmi", F.lit(24.0))}
    scores = {"heart_probability": demo_probability("heart"), "stroke_probability": demo_probability("stroke")}
    return trends.compare_scenarios(complete_residents(spark, sf_dir), changes, scores, "resident_id")
