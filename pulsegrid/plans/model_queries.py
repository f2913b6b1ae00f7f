"""Quantiles, evaluation, splits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.operators import evaluation, quantiles, splitting
from pulsegrid.plans.checks import fixed, with_clean, with_parts, with_residents
from pulsegrid.plans.registry import query
from pulsegrid.plans.scoring_base import SCORED_PARTS, scored_residents
from pulsegrid.session import durable
from pulsegrid.sources.tables import residents

C = F.col


@query("a06_median_imputation", with_clean("SELECT resident_id, " + ", ".join(
    f"coalesce({n}, (SELECT quantile_disc({n}, 0.5) FROM clean)) AS {n}" for n in contract.FEATURES) + " FROM clean"))
def median_imputation(spark, sf_dir):
    return quantiles.impute_medians(cleaning.clean(residents(spark, sf_dir))).select("resident_id", *contract.FEATURES)


@query("j02_prevalence_cutoff", with_parts(SCORED_PARTS, """
SELECT resident_id, CAST(stroke_probability >= (
  SELECT quantile_cont(stroke_probability, 1.0::DOUBLE - 0.1597::DOUBLE) FROM scored) AS INTEGER) AS flag
FROM scored"""))
def prevalence_cutoff(spark, sf_dir):
    scored = scored_residents(spark, sf_dir).select("resident_id", "stroke_probability")
    return quantiles.flag_by_prevalence(scored, "stroke_probability", 0.1597, "flag").select("resident_id", "flag")


# -- evaluation ---------------------------------------------------------------

_CELLS = """
cells AS (
  SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS true_negative, count(*) FILTER (WHERE y = 0 AND p = 1) AS false_positive,
    count(*) FILTER (WHERE y = 1 AND p = 0) AS false_negative, count(*) FILTER (WHERE y = 1 AND p = 1) AS true_positive
  FROM (SELECT label_stroke AS y, CAST(stroke_probability >= 0.2 AS INTEGER) AS p FROM scored) q
), rates AS (
  SELECT *, true_positive / CAST(true_positive + false_negative AS DOUBLE) AS r,
    true_negative / CAST(true_negative + false_positive AS DOUBLE) AS s,
    CAST(true_positive + true_negative + false_positive + false_negative AS DOUBLE) AS n FROM cells
)"""


def predictions(spark, sf_dir):
    df = scored_residents(spark, sf_dir)
    return df.withColumn("predicted", (C("stroke_probability") >= 0.2).cast("int"))


@query("a12_confusion", with_parts([*SCORED_PARTS, _CELLS], f"""
SELECT true_negative, false_positive, false_negative, true_positive,
  {fixed('(true_positive + true_negative) / n', 4)} AS accuracy,
  {fixed('2 * true_positive / CAST(2 * true_positive + false_negative + false_positive AS DOUBLE)', 4)} AS f1_score,
  {fixed('5 * true_positive / CAST(5 * true_positive + 4 * false_negative + false_positive AS DOUBLE)', 4)} AS f2_score,
  {fixed('true_positive / CAST(true_positive + false_positive AS DOUBLE)', 4)} AS precision,
  {fixed('r', 4)} AS recall, {fixed('s', 4)} AS specificity, {fixed('(r + s) / 2', 4)} AS balanced_accuracy,
  {fixed('(true_positive + false_negative) / n', 6)} AS positive_rate
FROM rates"""))
def confusion(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir), "label_stroke", "predicted")


CURVE = """
points AS (
  SELECT stroke_probability AS score, CAST(sum(label_stroke) AS BIGINT) AS pos,
    CAST(sum(1 - label_stroke) AS BIGINT) AS neg FROM scored GROUP BY 1
), curve AS (
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM points
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)"""


def curve_check(body: str) -> str:
    return with_parts([*SCORED_PARTS, CURVE], body)


def points_of(spark, sf_dir):
    points = evaluation.score_points(scored_residents(spark, sf_dir), "label_stroke", "stroke_probability")
    return durable(points, "score-points")


@query("a13_average_precision", curve_check(
    f"SELECT {fixed('sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos)', 4)} AS pr_auc FROM curve"))
def average_precision(spark, sf_dir):
    return evaluation.ranking_measures(points_of(spark, sf_dir)).select("pr_auc")


@query("a14_brier_score", with_parts(SCORED_PARTS, f"""
SELECT {fixed('avg((stroke_probability - label_stroke) * (stroke_probability - label_stroke))', 4)} AS brier_score
FROM scored"""))
def brier_score(spark, sf_dir):
    return evaluation.brier(scored_residents(spark, sf_dir), "label_stroke", "stroke_probability")


@query("a15_roc_area", curve_check(f"""
SELECT {fixed('sum(neg * ((tp - pos) + 0.5::DOUBLE * pos)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))', 4)}
  AS roc_auc FROM curve"""))
def roc_area(spark, sf_dir):
    return evaluation.ranking_measures(points_of(spark, sf_dir)).select("roc_auc")


@query("a16_decision_threshold", curve_check("""
SELECT score AS threshold FROM curve
WHERE CAST(tp AS DOUBLE) / (SELECT sum(pos) FROM points) >= 0.70::DOUBLE
ORDER BY CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) DESC, score LIMIT 1"""))
def decision_threshold(spark, sf_dir):
    return evaluation.decision_threshold(points_of(spark, sf_dir))


@query("w07_score_curve", curve_check("SELECT * FROM curve"))
def score_curve(spark, sf_dir):
    return evaluation.running_totals(points_of(spark, sf_dir))


# -- splits -------------------------------------------------------------------

SPLIT = """
sized AS (
  SELECT *, n - kept AS test_n, CAST(floor(kept * 1.0) AS BIGINT) AS rest FROM (
    SELECT label_stroke AS y, n, low + CASE WHEN place <= total_kept - sum(low) OVER () THEN 1 ELSE 0 END AS kept FROM (
      SELECT *, row_number() OVER (ORDER BY low - share, label_stroke) AS place FROM (
        SELECT label_stroke, n, total_kept, n * total_kept / CAST(total AS DOUBLE) AS share,
          CAST(floor(n * total_kept / CAST(total AS DOUBLE)) AS BIGINT) AS low FROM (
          SELECT label_stroke, n, total, total - CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS total_kept FROM (
            SELECT label_stroke, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
            FROM residents GROUP BY label_stroke) a) b) c) d) e
), sized2 AS (
  SELECT y, test_n, rest - (low + CASE WHEN place <= total_kept - sum(low) OVER () THEN 1 ELSE 0 END) AS cal_n FROM (
    SELECT *, row_number() OVER (ORDER BY low - share, y) AS place FROM (
      SELECT y, test_n, rest, total_kept, rest * total_kept / CAST(total AS DOUBLE) AS share,
        CAST(floor(rest * total_kept / CAST(total AS DOUBLE)) AS BIGINT) AS low FROM (
        SELECT y, test_n, rest, total, total - CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS total_kept FROM (
          SELECT y, test_n, rest, CAST(sum(rest) OVER () AS BIGINT) AS total FROM sized) a) b) c) d
), parted AS (
  SELECT r.*, CASE WHEN place <= test_n THEN 'test' WHEN place <= test_n + cal_n THEN 'calibrate' ELSE 'fit' END AS split
  FROM (SELECT *, md5('42:' || CAST(resident_id AS VARCHAR)) AS split_key,
      row_number() OVER (PARTITION BY label_stroke ORDER BY md5('42:' || CAST(resident_id AS VARCHAR))) AS place
    FROM residents) r JOIN sized2 ON label_stroke = y
)"""


RARE = """
rare AS (
  SELECT * REPLACE (CAST(label_stroke = 1 AND alcohol = 1 AND diabetes = 1 AS INTEGER) AS label_stroke) FROM residents
)"""
RARE_SPLIT = SPLIT.replace("FROM residents", "FROM rare")


def parted(spark, sf_dir):
    return splitting.stratified_split(cleaning.training_table(residents(spark, sf_dir)), "label_stroke", "resident_id")


def rare_fit_part(spark, sf_dir):
    """Fit part of a split on an outcome of about two percent, so that rows have to be added."""
    rare = ((C("label_stroke") == 1) & (C("alcohol") == 1) & (C("diabetes") == 1)).cast("int")
    rows = cleaning.training_table(residents(spark, sf_dir).withColumn("label_stroke", rare))
    return splitting.stratified_split(rows, "label_stroke", "resident_id").filter(C("split") == "fit")


@query("m01_stratified_split", with_parts([SPLIT], "SELECT resident_id, label_stroke, split FROM parted"))
def stratified_split(spark, sf_dir):
    return parted(spark, sf_dir).select("resident_id", "label_stroke", "split")


DRAWN = """
fit AS (SELECT * FROM parted WHERE split = 'fit'
), pool AS (
  SELECT resident_id, row_number() OVER (ORDER BY split_key) - 1 AS position, count(*) OVER () AS positives
  FROM fit WHERE label_stroke = 1
), sizes AS (
  SELECT p, greatest(least(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), CAST(floor(p * 3.0::DOUBLE) AS BIGINT)) - p, 0) AS added
  FROM (SELECT count(*) FILTER (WHERE label_stroke = 1) AS p, count(*) FILTER (WHERE label_stroke = 0) AS n FROM fit) q
), draws AS (
  SELECT CAST('0x' || substr(md5('42:draw:' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) % p AS position
  FROM (SELECT p, unnest(range(added)) AS i FROM sizes) q
), picked AS (SELECT resident_id FROM draws JOIN pool USING (position))"""


def model_sizes_sql(trees: int) -> str:
    """What the data determine of two fitted models: sizes of the held-out part and the rows added to the fit part."""
    heart = [f"heart_{part}" for part in ("sized", "sized2", "parted")]
    heart_split = SPLIT.replace("label_stroke", "label_heart")
    for own in heart:
        heart_split = re.sub(rf"\b{own.removeprefix('heart_')}\b", own, heart_split)
    facts = f"{trees} AS trees, {len(contract.FEATURES)} AS features, count(*) FILTER (WHERE split = 'test') AS test_rows"
    known = "TRUE AS all_tested, TRUE AS ranks, TRUE AS calibrated"
    return with_parts([heart_split, RARE, RARE_SPLIT, DRAWN], f"""
SELECT 'heart' AS target, {facts}, count(*) FILTER (WHERE split = 'test' AND label_heart = 1) AS test_positives,
  CAST(0 AS BIGINT) AS added_rows, {known} FROM heart_parted
UNION ALL SELECT 'stroke', {facts}, count(*) FILTER (WHERE split = 'test' AND label_stroke = 1),
  (SELECT max(added) FROM sizes), {known} FROM parted""")


@query("m02_oversampled_rows", with_parts([RARE, RARE_SPLIT, DRAWN], """
SELECT resident_id, count(*) AS copies FROM (
  SELECT resident_id FROM fit UNION ALL SELECT resident_id FROM picked) q GROUP BY resident_id"""))
def oversampled_rows(spark, sf_dir):
    rows, _ = splitting.oversample(rare_fit_part(spark, sf_dir), "label_stroke")
    return rows.groupBy("resident_id").agg(F.count(F.lit(1)).alias("copies"))


@query("u02_appended_rows", with_parts([RARE, RARE_SPLIT, DRAWN], """
SELECT (SELECT count(*) FROM fit) + (SELECT count(*) FROM picked) AS rows,
  (SELECT count(*) FROM fit WHERE label_stroke = 1) + (SELECT count(*) FROM picked) AS positives"""))
def appended_rows(spark, sf_dir):
    rows, _ = splitting.oversample(rare_fit_part(spark, sf_dir), "label_stroke")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("label_stroke").alias("positives"))


@query("a18_table_summary", with_residents("""
SELECT count(*) AS processed_rows, 13 AS processed_columns,
  CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT) AS train_rows,
  count(*) - CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT) AS test_rows FROM residents"""))
def table_summary(spark, sf_dir):
    return splitting.table_summary(cleaning.training_table(residents(spark, sf_dir)), "resident_id")


@query("a19_split_rates", with_parts([SPLIT], f"""
SELECT split, count(*) AS rows, {fixed('avg(label_stroke)', 6)} AS positive_rate FROM parted GROUP BY split"""))
def split_rates(spark, sf_dir):
    from pulsegrid.functions.numeric import round_exact

    return parted(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), round_exact(F.avg("label_stroke"), 6).alias("positive_rate"))
