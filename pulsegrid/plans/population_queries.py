"""Population and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import cleaning, fixed_values as V
from pulsegrid.operators import population, regions
from pulsegrid.plans.checks import pct, quote, with_clean, with_parts, with_residents
from pulsegrid.plans.registry import query
from pulsegrid.sources.tables import residents

C = F.col

FOLLOW_UP_FILTER = "age >= 65 AND (label_heart = 1 OR label_stroke = 1)"
FOLLOW_UP_SCORE = (
    "CAST(label_heart + label_stroke + hypertension + diabetes + CASE WHEN cholesterol >= 2 THEN 1 ELSE 0 END AS INTEGER)"
)
BOTH = "label_heart = 1 AND label_stroke = 1"


@query("s03_population_scan", with_residents("""
SELECT age, district, age_group, bmi, hypertension, diabetes, cholesterol, smoker, exercise, label_heart, label_stroke
FROM residents"""))
def population_scan(spark, sf_dir):
    return population.population_scan(residents(spark, sf_dir))


@query("a01_key_figures", with_residents(f"""
SELECT count(*) AS total_residents,
  {pct('sum(CASE WHEN label_heart = 1 THEN 1 ELSE 0 END)', 'count(*)')} AS heart_risk_rate,
  {pct('sum(CASE WHEN label_stroke = 1 THEN 1 ELSE 0 END)', 'count(*)')} AS stroke_risk_rate,
  {pct(f'sum(CASE WHEN {BOTH} THEN 1 ELSE 0 END)', 'count(*)')} AS comorbidity_rate,
  count(*) FILTER (WHERE {FOLLOW_UP_FILTER}) AS high_risk_follow_up_count
FROM residents"""))
def key_figures(spark, sf_dir):
    return population.key_figures(residents(spark, sf_dir))


DISTRICT_SQL = with_residents(f"""
SELECT district, count(*) AS residents,
  {pct('sum(label_heart)', 'count(*)')} AS heart_rate, {pct('sum(label_stroke)', 'count(*)')} AS stroke_rate,
  {pct(f'sum(CASE WHEN {BOTH} THEN 1 ELSE 0 END)', 'count(*)')} AS comorbidity_rate
FROM residents GROUP BY district ORDER BY stroke_rate DESC, district""")


@query("a02_district_report", DISTRICT_SQL)
def district_report(spark, sf_dir):
    return population.district_report(residents(spark, sf_dir))


@query("a03_district_means", with_residents("""
SELECT district, count(*) AS residents, avg(label_heart) AS heart_risk_rate, avg(label_stroke) AS stroke_risk_rate,
  avg(label_heart * label_stroke) AS comorbidity_rate
FROM residents GROUP BY district"""))
def district_means(spark, sf_dir):
    return population.district_means(residents(spark, sf_dir))


@query("a04_age_band_report", with_residents("""
SELECT age_group, count(*) AS residents, CAST(sum(label_heart) AS BIGINT) AS heart,
  CAST(sum(label_stroke) AS BIGINT) AS stroke
FROM residents GROUP BY age_group"""))
def age_band_report(spark, sf_dir):
    return population.age_band_report(residents(spark, sf_dir))


_FACTOR_SQL = {
    "hypertension": "hypertension = 1", "diabetes": "diabetes = 1", "cholesterol": "cholesterol >= 2",
    "smoker": "smoker = 2", "bmi": "bmi >= 25", "exercise": "exercise = 0",
}


@query("a05_risk_factor_report", with_residents(" UNION ALL ".join(
    f"SELECT {quote(V.RISK_FACTOR_NAMES[name])} AS name, "
    f"{pct(f'sum(CASE WHEN {test} THEN 1 ELSE 0 END)', 'count(*)')} AS rate FROM residents"
    for name, test in _FACTOR_SQL.items()
)))
def risk_factor_report(spark, sf_dir):
    return population.risk_factor_report(residents(spark, sf_dir))


@query("p13_follow_up_filter", with_clean(f"""
SELECT resident_id, district, age, label_heart, label_stroke FROM clean WHERE {FOLLOW_UP_FILTER}"""))
def follow_up_filter(spark, sf_dir):
    df = cleaning.clean(residents(spark, sf_dir))
    return df.filter(cleaning.needs_follow_up(C("age"), C("label_heart"), C("label_stroke"))).select(
        "resident_id", "district", "age", "label_heart", "label_stroke")


@query("p14_follow_up_score", with_clean(f"""
SELECT resident_id, {FOLLOW_UP_SCORE} AS risk_score FROM (
  SELECT resident_id, label_heart, label_stroke, hypertension, diabetes,
    CASE WHEN cholesterol IS NOT NULL THEN cholesterol END AS cholesterol FROM clean
) q WHERE cholesterol IS NOT NULL
UNION ALL SELECT resident_id, CAST(NULL AS INTEGER) FROM clean WHERE cholesterol IS NULL"""))
def follow_up_score(spark, sf_dir):
    df = cleaning.clean(residents(spark, sf_dir))
    return df.select("resident_id", cleaning.follow_up_score().alias("risk_score"))


@query("p15_screening_basis", with_residents(f"""
SELECT resident_id, {quote(V.SCREENING_BASIS)} AS screening_basis FROM residents WHERE {FOLLOW_UP_FILTER}"""))
def screening_basis(spark, sf_dir):
    return population.follow_ups(residents(spark, sf_dir)).select("resident_id", "screening_basis")


@query("p16_comorbidity_policies", with_residents(f"""
SELECT district,
  {pct('sum(CASE WHEN label_heart = 1 AND known_stroke = 1 THEN 1 ELSE 0 END)', 'count(*)')} AS strict_rate,
  {pct('sum(label_heart * known_stroke)', 'count(known_stroke)')} AS known_rate
FROM (SELECT district, label_heart, CASE WHEN bmi IS NOT NULL THEN label_stroke END AS known_stroke FROM residents) q
GROUP BY district"""))
def comorbidity_policies(spark, sf_dir):
    from pulsegrid.functions.numeric import count_if, percent

    known = F.when(C("bmi").isNotNull(), C("label_stroke"))
    df = residents(spark, sf_dir).select("district", "label_heart", known.alias("label_stroke"))
    strict = cleaning.comorbid_strict(C("label_heart"), C("label_stroke"))
    product = cleaning.comorbid_known(C("label_heart"), C("label_stroke"))
    return df.groupBy("district").agg(
        percent(count_if(strict), F.count(F.lit(1))).alias("strict_rate"),
        percent(F.sum(product), F.count(product)).alias("known_rate"),
    )


_RANKED_SQL = f"""
SELECT resident_id, district, age, {FOLLOW_UP_SCORE} AS risk_score
FROM residents WHERE {FOLLOW_UP_FILTER} ORDER BY risk_score DESC, age DESC, resident_id"""


@query("t01_ranked_follow_ups", with_residents(_RANKED_SQL))
def ranked_follow_ups(spark, sf_dir):
    return population.ranked_follow_ups(residents(spark, sf_dir)).select(
        "resident_id", "district", "age", "risk_score")


@query("t02_top_follow_ups", with_residents(_RANKED_SQL + " LIMIT 100"))
def top_follow_ups(spark, sf_dir):
    return population.top_follow_ups(residents(spark, sf_dir), 100).select(
        "resident_id", "district", "age", "risk_score")


@query("t03_sorted_reports", with_residents(f"""
SELECT row_number() OVER (ORDER BY stroke_rate DESC, district) AS position, district, stroke_rate
FROM (SELECT district, {pct('sum(label_stroke)', 'count(*)')} AS stroke_rate FROM residents GROUP BY district) q"""))
def sorted_reports(spark, sf_dir):
    """Districts by stroke rate with their position; one row per district, so the
    single-group window stays small."""
    from pyspark.sql import Window

    report = population.district_report(residents(spark, sf_dir))
    position = F.row_number().over(Window.orderBy(C("stroke_rate").desc(), "district")).cast("bigint")
    return report.select(position.alias("position"), "district", "stroke_rate")


def _counter_parts(df):
    """Counters of each region's part, kept apart to be merged later."""
    return regions.region_counters(df, ["region", "district"])


_COUNTER_SQL = "count(*) AS residents, CAST(sum(label_heart) AS BIGINT) AS heart_positive, " \
    "CAST(sum(label_stroke) AS BIGINT) AS stroke_positive, " \
    f"count(*) FILTER (WHERE {BOTH}) AS comorbidity"


@query("a08_merged_counters", with_residents(f"SELECT district, {_COUNTER_SQL} FROM residents GROUP BY district"))
def merged_counters(spark, sf_dir):
    """Counters per month are merged into totals per district."""
    parts = regions.region_counters(residents(spark, sf_dir), ["district", "data_period"])
    return regions.merge_counters(parts, ["district"]).select(
        "district", "residents", "heart_positive", "stroke_positive", "comorbidity")


def suppressed_sql(source: str, keys: str) -> str:
    """Groups below five hidden; with several keys, also the smallest other group of a parent whose total would tell."""
    names = [name.strip() for name in keys.split(",")]
    if len(names) == 1:
        hidden = "n < 5"
    else:
        parent, last = ", ".join(names[:-1]), names[-1]
        over = f"OVER (PARTITION BY {parent})"
        few, held = f"count(*) FILTER (WHERE n < 5) {over}", f"coalesce(sum(n) FILTER (WHERE n < 5) {over}, 0)"
        place = f"row_number() OVER (PARTITION BY {parent} ORDER BY n < 5 DESC, n, {last})"
        hidden = f"n < 5 OR ({few} > 0 AND NOT ({few} > 1 AND {held} - ({few} - 1) >= 5) AND {place} = {few} + 1)"
    return f"""
SELECT {keys}, CASE WHEN NOT hidden THEN n END AS residents, CASE WHEN NOT hidden THEN hr END AS heart_rate,
  CASE WHEN NOT hidden THEN sr END AS stroke_rate, CASE WHEN NOT hidden THEN cr END AS comorbidity_rate, hidden AS suppressed
FROM (SELECT *, {hidden} AS hidden FROM (SELECT {keys}, count(*) AS n, {pct('sum(label_heart)', 'count(*)')} AS hr,
  {pct('sum(label_stroke)', 'count(*)')} AS sr,
  {pct(f'sum(CASE WHEN {BOTH} THEN 1 ELSE 0 END)', 'count(*)')} AS cr FROM {source} GROUP BY {keys}) q) z"""


@query("a09_protected_districts", with_residents(f"""
SELECT district, count(*) AS residents, {pct('sum(label_heart)', 'count(*)')} AS heart_rate, {pct('sum(label_stroke)', 'count(*)')} AS stroke_rate,
  {pct(f'sum(CASE WHEN {BOTH} THEN 1 ELSE 0 END)', 'count(*)')} AS comorbidity_rate, FALSE AS suppressed
FROM residents GROUP BY district"""))
def protected_districts(spark, sf_dir):
    """District totals beside the suppressed communities; hidden where a district has no community that may be shown."""
    return regions.parent_report(residents(spark, sf_dir), ["district", "community_id"])


@query("a09_suppressed_communities", with_residents(suppressed_sql("residents", "district, community_id")))
def suppressed_communities(spark, sf_dir):
    return regions.region_report(residents(spark, sf_dir), ["district", "community_id"])


@query("a10_coverage", with_residents("""
SELECT CASE WHEN count(DISTINCT district) > 1 THEN 'district' ELSE 'table' END AS coverage_level,
  CASE WHEN count(DISTINCT district) = 1 THEN min(district) WHEN count(DISTINCT region) = 1 THEN min(region)
       ELSE 'multiple' END AS coverage_name,
  count(DISTINCT district) > 1 AND count(DISTINCT region) = 1 AND min(region) = '成都市' AS map_available,
  CASE WHEN count(DISTINCT district) > 1 AND count(DISTINCT region) = 1 AND min(region) = '成都市'
       THEN 'chengdu' END AS map_name
FROM residents"""))
def coverage(spark, sf_dir):
    return regions.coverage(residents(spark, sf_dir))


_MIXED = """
mixed AS (
  SELECT district, CASE WHEN nk % 3 = 0 THEN label_heart END AS label_heart,
    CASE WHEN nk % 3 = 0 THEN label_stroke END AS label_stroke,
    CASE WHEN nk % 3 < 2 THEN heart_probability END AS heart_probability,
    CASE WHEN nk % 3 < 2 AND gender = 1 THEN stroke_probability END AS stroke_probability
  FROM (SELECT *, community_id // 1000 AS nk FROM scored) q
)"""


def mixed_sources(df):
    """A third of the nations carries labels and scores, a third scores only, a third neither; one gender has no stroke score."""
    kind = F.expr("community_id div 1000") % 3
    has_score = {"heart_probability": kind < 2, "stroke_probability": (kind < 2) & (C("gender") == 1)}
    return df.select(
        "district",
        *[F.when(kind == 0, C(name)).alias(name) for name in ("label_heart", "label_stroke")],
        *[F.when(known, C(name)).alias(name) for name, known in has_score.items()],
    )


def _source_rate(labels: str, scores: str) -> str:
    return f"""CASE WHEN count(label_heart) > 0 AND count(label_stroke) > 0 THEN {labels}
    WHEN count(heart_probability) + count(stroke_probability) > 0 THEN {scores} END"""


def _register_metric_source():
    from pulsegrid.plans.scoring_base import SCORED_PARTS, scored_residents

    high = "count(*) FILTER (WHERE {0}_probability >= 0.35)"
    both_high = "count(*) FILTER (WHERE heart_probability >= 0.35 AND stroke_probability >= 0.35)"
    scored = "count({0}_probability)"
    both_scored = "count(*) FILTER (WHERE heart_probability IS NOT NULL AND stroke_probability IS NOT NULL)"
    check = with_parts([*SCORED_PARTS, _MIXED], f"""
SELECT district, count(*) AS residents,
  CASE WHEN count(label_heart) > 0 AND count(label_stroke) > 0 THEN 'labels'
       WHEN count(heart_probability) + count(stroke_probability) > 0 THEN 'model_probability' ELSE 'unavailable' END AS risk_metric_source,
  {_source_rate(pct('sum(label_heart)', 'count(label_heart)'), pct(high.format('heart'), scored.format('heart')))} AS heart_rate,
  {_source_rate(pct('sum(label_stroke)', 'count(label_stroke)'), pct(high.format('stroke'), scored.format('stroke')))} AS stroke_rate,
  {_source_rate(pct(f'count(*) FILTER (WHERE {BOTH})', 'count(*)'), pct(both_high, both_scored))} AS comorbidity_rate
FROM mixed GROUP BY district""")

    @query("a11_metric_source", check)
    def metric_source(spark, sf_dir):
        counters = regions.region_counters(mixed_sources(scored_residents(spark, sf_dir)), ["district"])
        return regions.region_rates(counters).select(
            "district", "residents", "risk_metric_source", *regions.HIDDEN[1:])


_register_metric_source()
