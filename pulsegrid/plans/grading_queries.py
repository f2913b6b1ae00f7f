"""Validation, grading, texts, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading, privacy
from pulsegrid.plans.checks import fixed, quote, with_clean, with_parts, with_residents
from pulsegrid.plans.registry import query
from pulsegrid.plans.scoring_base import SCORED_PARTS, complete_residents, scored_residents
from pulsegrid.sources.tables import residents

C = F.col


def scored_check(body: str) -> str:
    return with_parts(SCORED_PARTS, body)


# -- P11, P12 -----------------------------------------------------------------

PAYLOAD = """
payload AS (
  SELECT resident_id,
    CASE WHEN h1 = 'a' THEN 'n/a' WHEN h1 = 'b' THEN 'inf' WHEN h1 = 'c' THEN CAST(age AS VARCHAR) || '.5'
         ELSE CAST(age AS VARCHAR) END AS age,
    CAST(gender AS VARCHAR) AS gender, CAST(bmi AS VARCHAR) AS bmi, CAST(cholesterol AS VARCHAR) AS cholesterol,
    CASE WHEN h1 <> 'd' THEN CAST(diabetes AS VARCHAR) END AS diabetes, CAST(hypertension AS VARCHAR) AS hypertension,
    CAST(smoker AS VARCHAR) AS smoker, CAST(alcohol AS VARCHAR) AS alcohol, CAST(exercise AS VARCHAR) AS exercise,
    CASE WHEN h1 = 'e' THEN '999' ELSE CAST(systolic_bp AS VARCHAR) END AS systolic_bp,
    CASE WHEN h1 = 'f' THEN '' ELSE CAST(diastolic_bp AS VARCHAR) END AS diastolic_bp,
    CASE WHEN h1 = 'e' THEN 'x' ELSE CAST(fasting_glucose AS VARCHAR) END AS fasting_glucose,
    CASE WHEN h1 = 'f' THEN '0.5' ELSE CAST(family_history AS VARCHAR) END AS family_history
  FROM (SELECT *, substr(md5(CAST(resident_id AS VARCHAR)), 1, 1) AS h1 FROM residents) q
)"""


def payload(spark, sf_dir):
    """Raw text records: some values unreadable, infinite, fractional, out of range, empty or absent."""
    kind = F.substring(F.md5(C("resident_id").cast("string")), 1, 1)
    df = residents(spark, sf_dir)
    optional = list(contract.OPTIONAL_RANGES)
    text = df.select("resident_id", kind.alias("kind"), *[
        C(name).cast("string").alias(name) for name in [*contract.FEATURES, *optional]])
    return text.withColumns({
        "age": F.when(C("kind") == "a", "n/a").when(C("kind") == "b", "inf")
        .when(C("kind") == "c", F.concat("age", F.lit(".5"))).otherwise(C("age")),
        "diabetes": F.when(C("kind") != "d", C("diabetes")),
        "systolic_bp": F.when(C("kind") == "e", "999").otherwise(C("systolic_bp")),
        "diastolic_bp": F.when(C("kind") == "f", "").otherwise(C("diastolic_bp")),
        "fasting_glucose": F.when(C("kind") == "e", "x").otherwise(C("fasting_glucose")),
        "family_history": F.when(C("kind") == "f", "0.5").otherwise(C("family_history")),
    }).drop("kind")


def _reason_sql(name: str, low, high, optional: bool) -> str:
    number = f"try_cast({name} AS DOUBLE)"
    text = quote(f"{V.REASON_RANGE_PREFIX}{low}~{high}")
    outside = f"NOT ({number} BETWEEN {low} AND {high})"
    parts = [f"CASE WHEN {name} IS NULL" + (f" OR {name} = ''" if optional else "") + " THEN NULL"]
    parts.append(f"WHEN {number} IS NULL THEN {quote(V.REASON_NOT_NUMBER)}")
    if optional:
        parts.append(f"WHEN NOT isfinite({number}) OR {outside} THEN {text}")
    else:
        parts.append(f"WHEN NOT isfinite({number}) THEN {quote(V.REASON_NOT_FINITE)} WHEN {outside} THEN {text}")
    if name == "family_history" or (not optional and name != "bmi"):
        parts.append(f"WHEN {number} <> floor({number}) THEN {quote(V.REASON_NOT_CODE)}")
    return " ".join(parts) + " END"


_REASONS = {
    **{name: _reason_sql(name, *contract.RANGES[name], False) for name in contract.FEATURES},
    **{name: _reason_sql(name, *limits, True) for name, limits in contract.OPTIONAL_RANGES.items()},
}
_REASON_SQL = "concat_ws(';', " + ", ".join(_REASONS.values()) + ")"
_INVALID_SQL = "concat_ws(';', " + ", ".join(
    f"CASE WHEN ({sql}) IS NOT NULL THEN '{name}' END" for name, sql in _REASONS.items()) + ")"
_MISSING_SQL = "concat_ws(';', " + ", ".join(
    f"CASE WHEN {name} IS NULL THEN '{name}' END" for name in contract.FEATURES) + ")"


VERDICT_SQL = f"""
SELECT resident_id, missing_fields, invalid_fields, reasons, missing_fields = '' AND invalid_fields = '' AS valid
FROM (SELECT resident_id, {_MISSING_SQL} AS missing_fields, {_INVALID_SQL} AS invalid_fields, {_REASON_SQL} AS reasons
  FROM payload) q"""


@query("p11_record_validation", with_parts([PAYLOAD], VERDICT_SQL))
def record_validation(spark, sf_dir):
    df = grading.with_numbers(payload(spark, sf_dir))
    found = df.select(
        "resident_id", grading.missing_fields().alias("missing"), grading.invalid_fields(df.columns).alias("invalid"))
    return found.select(
        "resident_id",
        F.array_join("missing", ";").alias("missing_fields"),
        F.array_join(F.map_keys("invalid"), ";").alias("invalid_fields"),
        F.array_join(F.map_values("invalid"), ";").alias("reasons"),
        ((F.size("missing") == 0) & (F.size("invalid") == 0)).alias("valid"),
    )


_CODES = [name for name in contract.FEATURES if name != "bmi"] + ["family_history"]


@query("p12_normal_record", with_parts([PAYLOAD], f"""
SELECT resident_id, {", ".join(f"CAST(trunc(CAST({n} AS DOUBLE)) AS INTEGER) AS {n}" for n in _CODES)},
  {", ".join(fixed(f"CAST(nullif({n}, '') AS DOUBLE)", 2) + f" AS {n}" for n in ("bmi", "systolic_bp", "diastolic_bp", "fasting_glucose"))}
FROM (SELECT * REPLACE (CAST(CAST(bmi AS DOUBLE) * 1.037 AS VARCHAR) AS bmi) FROM payload) p
WHERE {_MISSING_SQL} = '' AND {_INVALID_SQL} = ''"""))
def normal_record(spark, sf_dir):
    scaled = (C("bmi").cast("double") * F.lit(1.037)).cast("string")
    df = grading.with_numbers(payload(spark, sf_dir).withColumn("bmi", scaled))
    return df.filter(grading.is_valid(df.columns)).select("resident_id", *[
        value.alias(name) for name, value in grading.normal_record(df.columns).items()])


# -- P17 to P25 ---------------------------------------------------------------

LEVEL_SQL = """CASE WHEN {p} < 0.15 THEN 1 WHEN {p} < 0.35 THEN 2 WHEN {p} < 0.6 THEN 3 WHEN {p} < 0.8 THEN 4 ELSE 5 END"""
OVERALL_SQL = "greatest(heart_probability, stroke_probability)"
LEVEL = LEVEL_SQL.format(p=OVERALL_SQL)
CATEGORY = """CASE WHEN heart_probability >= 0.35 THEN 1 ELSE 0 END + 2 * CASE WHEN stroke_probability >= 0.35 THEN 1 ELSE 0 END"""


def case_text(value: str, texts: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {key} THEN {quote(text)}" for key, text in texts.items())
    return f"CASE {value} {arms}" + (f" ELSE {default}" if default else "") + " END"


@query("p17_risk_level", scored_check(f"""
SELECT resident_id, code, {case_text('code', {c: n for c, n, _ in V.RISK_LEVELS})} AS name,
  {case_text('code', {c: k for c, _, k in V.RISK_LEVELS})} AS color
FROM (SELECT resident_id, {LEVEL} AS code FROM scored) q"""))
def risk_level(spark, sf_dir):
    probability = grading.overall_probability(C("heart_probability"), C("stroke_probability"))
    graded = scored_residents(spark, sf_dir).select("resident_id", grading.level_code(probability).alias("code"))
    return graded.withColumns({"name": grading.level_name(C("code")), "color": grading.level_color(C("code"))})


@query("p18_final_category", scored_check(f"""
SELECT resident_id, {CATEGORY} AS final_category
FROM (SELECT * REPLACE (CASE WHEN gender = 1 THEN heart_probability END AS heart_probability) FROM scored) q"""))
def final_category(spark, sf_dir):
    df = scored_residents(spark, sf_dir)
    heart = F.when(C("gender") == 1, C("heart_probability"))
    return df.select("resident_id", grading.final_category(heart, C("stroke_probability")).alias("final_category"))


@query("p19_overall_probability", scored_check(f"SELECT resident_id, {OVERALL_SQL} AS probability FROM scored"))
def overall_probability(spark, sf_dir):
    return scored_residents(spark, sf_dir).select(
        "resident_id",
        grading.overall_probability(C("heart_probability"), C("stroke_probability")).alias("probability"))


_HIGHLIGHT_SQL = [
    ("hypertension = 1", V.HIGHLIGHT_HYPERTENSION), ("cholesterol >= 2", V.HIGHLIGHT_CHOLESTEROL),
    ("diabetes = 1", V.HIGHLIGHT_DIABETES), ("smoker >= 1", V.HIGHLIGHT_SMOKER), ("alcohol = 1", V.HIGHLIGHT_ALCOHOL),
    ("exercise = 0", V.HIGHLIGHT_EXERCISE), ("bmi >= 24", V.HIGHLIGHT_BMI),
    ("systolic_bp >= 140 OR diastolic_bp >= 90", V.HIGHLIGHT_PRESSURE), ("fasting_glucose >= 7.0", V.HIGHLIGHT_GLUCOSE),
    ("family_history = 1", V.HIGHLIGHT_FAMILY),
]
_HIGHLIGHTS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {test} THEN {quote(text)} END" for test, text in _HIGHLIGHT_SQL) + ")"


@query("p20_highlights", with_residents(f"""
SELECT resident_id, CASE WHEN h = '' THEN {quote(V.HIGHLIGHT_NONE)} ELSE h END AS highlights
FROM (SELECT resident_id, {_HIGHLIGHTS} AS h FROM residents) q"""))
def highlight_list(spark, sf_dir):
    df = residents(spark, sf_dir)
    return df.select("resident_id", F.array_join(grading.highlights(df.columns), "|").alias("highlights"))


SUMMARY = f"""CASE c WHEN 1 THEN {quote(V.SUMMARY_HEART)} WHEN 2 THEN {quote(V.SUMMARY_STROKE)}
  WHEN 3 THEN {quote(V.SUMMARY_BOTH)} ELSE CASE WHEN l > 1 THEN {quote(V.SUMMARY_WATCH)}
  ELSE {quote(V.SUMMARY_HEALTHY)} END END"""


@query("p21_summary_text", scored_check(f"""
SELECT resident_id, {SUMMARY} AS risk_summary, {fixed('heart_probability * 100', 2)} AS heart_probability_percent,
  {fixed('stroke_probability * 100', 2)} AS stroke_probability_percent
FROM (SELECT *, {CATEGORY} AS c, {LEVEL} AS l FROM scored) q"""))
def summary_text(spark, sf_dir):
    heart, stroke = C("heart_probability"), C("stroke_probability")
    level = grading.level_code(grading.overall_probability(heart, stroke))
    return scored_residents(spark, sf_dir).select(
        "resident_id",
        grading.summary_text(grading.final_category(heart, stroke), level).alias("risk_summary"),
        grading.probability_percent(heart).alias("heart_probability_percent"),
        grading.probability_percent(stroke).alias("stroke_probability_percent"),
    )


def _insight_sql(key: str, present: str, value: str, status: str, auxiliary: bool) -> str:
    return (
        f"SELECT resident_id, {quote(V.INDICATOR_NAMES[key])} AS indicator, {value} AS value, {status} AS status, "
        f"{quote(V.INDICATOR_COMMENTS[key])} AS comment, {str(auxiliary).upper()} AS auxiliary FROM clean2 WHERE {present}"
    )


def _status(test: str, yes: str, no: str) -> str:
    return f"CASE WHEN {test} THEN {quote(yes)} ELSE {quote(no)} END"


_CLEAN2 = """
clean2 AS (
  SELECT c.*, r.systolic_bp, r.diastolic_bp, r.fasting_glucose
  FROM clean c JOIN residents r ON c.resident_id = r.resident_id
)"""


@query("p22_indicator_insights", with_clean("SELECT 1").replace("\nSELECT 1", f", {_CLEAN2}\n" + " UNION ALL ".join([
    _insight_sql("hypertension", "hypertension IS NOT NULL", "CAST(hypertension AS VARCHAR)",
                 _status("hypertension = 0", V.STATUS_NORMAL, V.STATUS_HYPERTENSION), False),
    _insight_sql("cholesterol", "cholesterol IS NOT NULL", "CAST(cholesterol AS VARCHAR)",
                 _status("cholesterol = 1", V.STATUS_NORMAL, V.STATUS_CHOLESTEROL), False),
    _insight_sql("diabetes", "diabetes IS NOT NULL", "CAST(diabetes AS VARCHAR)",
                 _status("diabetes = 0", V.STATUS_NORMAL, V.STATUS_DIABETES), False),
    _insight_sql("bmi", "bmi IS NOT NULL", "CAST(bmi AS VARCHAR)",
                 _status("bmi >= 24", V.STATUS_BMI, V.STATUS_NORMAL), False),
    _insight_sql("smoker", "smoker IS NOT NULL", "CAST(smoker AS VARCHAR)",
                 case_text("smoker", V.CODE_LABELS["smoker"], quote(V.STATUS_UNKNOWN)), False),
    _insight_sql("pressure", "systolic_bp IS NOT NULL AND diastolic_bp IS NOT NULL",
                 "CAST(systolic_bp AS VARCHAR) || '/' || CAST(diastolic_bp AS VARCHAR) || ' mmHg'",
                 _status("systolic_bp >= 140 OR diastolic_bp >= 90", V.STATUS_PRESSURE, V.STATUS_IN_RANGE), True),
    _insight_sql("glucose", "fasting_glucose IS NOT NULL", "CAST(fasting_glucose AS VARCHAR) || ' mmol/L'",
                 _status("fasting_glucose >= 7.0", V.STATUS_GLUCOSE, V.STATUS_IN_RANGE), True),
])))
def indicator_insights(spark, sf_dir):
    """Values are cleaned in place, so unknown indicators are skipped."""
    df = residents(spark, sf_dir).withColumns({
        "cholesterol": F.when(C("cholesterol").isin(1, 2, 3), C("cholesterol")),
        "smoker": F.when(C("smoker").isin(0, 1, 2), C("smoker")),
    })
    return df.select("resident_id", F.inline(grading.insights(df.columns)))


FACTOR_SQL = {
    "hypertension": "hypertension = 1", "cholesterol": "cholesterol >= 2", "diabetes": "diabetes = 1",
    "smoker": "smoker >= 1", "alcohol": "alcohol = 1", "exercise": "exercise = 0", "bmi": "bmi >= 24",
}
ACTIVE_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END" for name, test in FACTOR_SQL.items())


@query("p23_active_factors", scored_check(f"""
SELECT resident_id, {ACTIVE_SQL}, CASE WHEN {LEVEL} >= 4 THEN 'risk_level' END) AS factors FROM scored"""))
def active_factors(spark, sf_dir):
    level = grading.level_code(grading.overall_probability(C("heart_probability"), C("stroke_probability")))
    return scored_residents(spark, sf_dir).select(
        "resident_id", F.array_join(grading.active_factors(level), "|").alias("factors"))


@query("p24_guidance", scored_check(f"""
SELECT resident_id, {case_text('l', V.FOLLOW_UP_GUIDANCE)} AS follow_up,
  concat_ws('|', {", ".join(f"CASE WHEN {FACTOR_SQL[n]} THEN {quote(t)} END" for n, t in V.FALLBACK_ADVICE.items())},
    {case_text('l', V.FALLBACK_GUIDANCE)}) AS fallback
FROM (SELECT *, {LEVEL} AS l FROM scored) q"""))
def guidance(spark, sf_dir):
    level = grading.level_code(grading.overall_probability(C("heart_probability"), C("stroke_probability")))
    return scored_residents(spark, sf_dir).withColumn("level", level).select(
        "resident_id", grading.follow_up_text(C("level")).alias("follow_up"),
        F.array_join(grading.fallback_advice(C("level")), "|").alias("fallback"))


@query("p25_value_labels", with_parts(SCORED_PARTS[:1], f"""
SELECT resident_id, {", ".join(f"{case_text(n, V.CODE_LABELS[n])} AS {n}" for n in V.CODE_LABELS)},
  printf('%.1f', bmi) AS bmi, CAST(age AS VARCHAR) AS age FROM complete"""))
def value_labels(spark, sf_dir):
    return complete_residents(spark, sf_dir).select("resident_id", *[
        grading.value_label(name, C(name)).alias(name) for name in [*V.CODE_LABELS, "bmi", "age"]])


# -- P26 to P29 ---------------------------------------------------------------

@query("p26_masked_fields", with_residents(r"""
SELECT left(i, 1) || repeat('*', CAST(length(i) - 3 AS BIGINT)) || right(i, 2) AS resident_id,
  regexp_replace(phone, '^(\d{3})\d{4}(\d{4})$', '\1****\2') AS phone, left(name, 1) || '**' AS name, age
FROM (SELECT CAST(resident_id AS VARCHAR) AS i, phone, name, age FROM residents) q"""))
def masked_fields(spark, sf_dir):
    return privacy.mask_frame(residents(spark, sf_dir).select("resident_id", "phone", "name", "age"))


# Key of the demonstration pseudonyms.
DEMO_KEY = b"demonstration-key"


def _blob(mask: int) -> str:
    return "'" + "".join(f"\\x{b ^ mask:02X}" for b in DEMO_KEY.ljust(64, b"\0")) + "'::BLOB"


HASH_SQL = f"sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(client))))"


@query("p27_keyed_pseudonym", f"""
SELECT resident_id, {HASH_SQL} AS client_hash
FROM (SELECT o_orderkey + 510100000001 AS resident_id, CAST(o_orderkey + 510100000001 AS VARCHAR) AS client
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) q""")
def keyed_pseudonym(spark, sf_dir):
    return residents(spark, sf_dir).select(
        "resident_id", privacy.keyed_pseudonym(C("resident_id").cast("string"), DEMO_KEY).alias("client_hash"))


@query("p28_client_id_check", """
SELECT event_id, length(trim(id)) BETWEEN 8 AND 256 AS valid
FROM (SELECT event_id, '  ' || event_type || '-' || CAST(user_id AS VARCHAR) || ' ' AS id FROM events) q""")
def client_id_check(spark, sf_dir):
    text = F.concat(F.lit("  "), "event_type", F.lit("-"), C("user_id").cast("string"), F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", privacy.is_client_id(text).alias("valid"))


_JSON_FIELDS = sorted(["age", "gender", "cholesterol", "district", "community_id", "age_group", "bmi", "fasting_glucose", "systolic_bp"])
_JSON_TEXT = {"district", "age_group"}


def _json_value(name: str) -> str:
    shown = f"'\"' || {name} || '\"'" if name in _JSON_TEXT else f"CAST({name} AS VARCHAR)"
    return f"'\"{name}\":' || coalesce({shown}, 'null')"


@query("p29_canonical_json", with_residents(
    "SELECT resident_id, '{' || " + " || ',' || ".join(_json_value(name) for name in _JSON_FIELDS)
    + " || '}' AS input_json FROM residents"))
def canonical_json(spark, sf_dir):
    df = residents(spark, sf_dir)
    return df.select("resident_id", privacy.canonical_json(df, _JSON_FIELDS).alias("input_json"))


