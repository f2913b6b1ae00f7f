"""Cleaning, shaping and per-record derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.plans.checks import with_clean, with_residents
from pulsegrid.plans.registry import query
from pulsegrid.sources.tables import residents

C = F.col


@query("p01_contract_columns", with_residents(" UNION ALL ".join(
    f"SELECT '{name}' AS column_name, TRUE AS present, count({name}) AS filled FROM residents"
    if name != "target_disease" else
    "SELECT 'target_disease' AS column_name, FALSE AS present, 0 AS filled"
    for name in [*contract.FEATURES, "target_disease"]
).replace("0 AS filled", "CAST(0 AS BIGINT) AS filled")))
def contract_columns(spark, sf_dir):
    """Presence of each wanted column and its number of filled rows, from one scan."""
    df = residents(spark, sf_dir)
    wanted = [*contract.FEATURES, "target_disease"]
    missing = contract.absent(df.columns, wanted)
    counts = df.agg(*[
        (F.lit(0).cast("bigint") if name in missing else F.count(name)).alias(name) for name in wanted])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(name not in missing).alias("present"), C(name).alias("filled"))
        for name in wanted])))


@query("p02_positive_values", with_residents("""
SELECT resident_id, CASE WHEN age > 0 THEN age END AS age, CASE WHEN bmi > 0 THEN bmi END AS bmi,
  CASE WHEN cholesterol > 0 THEN cholesterol END AS cholesterol FROM residents"""))
def positive_values(spark, sf_dir):
    return residents(spark, sf_dir).select(
        "resident_id", *[cleaning.positive_or_null(name).alias(name) for name in ("age", "bmi", "cholesterol")])


@query("p03_binary_domain", with_residents("""
SELECT resident_id, CASE WHEN g IN (0, 1) THEN g END AS gender, CASE WHEN d IN (0, 1) THEN d END AS diabetes
FROM (SELECT resident_id, gender + CASE WHEN age < 0 THEN 2 ELSE 0 END AS g,
  diabetes - CASE WHEN smoker = 5 THEN 1 ELSE 0 END AS d FROM residents) q"""))
def binary_domain(spark, sf_dir):
    """Codes are shifted on some rows first so that illegal values occur."""
    df = residents(spark, sf_dir).select(
        "resident_id",
        (C("gender") + F.when(C("age") < 0, 2).otherwise(0)).alias("gender"),
        (C("diabetes") - F.when(C("smoker") == 5, 1).otherwise(0)).alias("diabetes"),
    )
    return df.select("resident_id", *[cleaning.code_or_null(name, 0, 1).alias(name) for name in ("gender", "diabetes")])


@query("p04_ordinal_domain", with_residents("""
SELECT resident_id, CASE WHEN smoker IN (0, 1, 2) THEN smoker END AS smoker,
  CASE WHEN cholesterol IN (1, 2, 3) THEN cholesterol END AS cholesterol FROM residents"""))
def ordinal_domain(spark, sf_dir):
    return residents(spark, sf_dir).select(
        "resident_id", cleaning.code_or_null("smoker", 0, 1, 2).alias("smoker"),
        cleaning.code_or_null("cholesterol", 1, 2, 3).alias("cholesterol"))


@query("p05_legacy_labels", with_residents("""
SELECT resident_id, CAST(t = 1 AS INTEGER) AS label_heart, CAST(t = 2 AS INTEGER) AS label_stroke
FROM (SELECT resident_id, CASE WHEN bmi IS NULL THEN NULL WHEN label_stroke = 1 THEN 2
  WHEN label_heart = 1 THEN 1 ELSE 0 END AS t FROM residents) q"""))
def legacy_labels(spark, sf_dir):
    target = cleaning.legacy_target(C("label_heart"), C("label_stroke"))
    old = residents(spark, sf_dir).select(
        "resident_id", F.when(C("bmi").isNotNull(), target).alias("target_disease"))
    return cleaning.with_labels(old).drop("target_disease")


@query("p06_contract_projection", with_clean("SELECT * FROM clean"))
def contract_projection(spark, sf_dir):
    return cleaning.clean(residents(spark, sf_dir))


@query("p07_numeric_coercion", with_residents("""
SELECT resident_id, try_cast(CASE WHEN age < 0 THEN 'n/a' ELSE CAST(age AS VARCHAR) END AS DOUBLE) AS age,
  try_cast(CAST(bmi AS VARCHAR) AS DOUBLE) AS bmi,
  try_cast(CASE WHEN smoker = 5 THEN '' ELSE CAST(smoker AS VARCHAR) END AS DOUBLE) AS smoker FROM residents"""))
def numeric_coercion(spark, sf_dir):
    text = residents(spark, sf_dir).withColumns({
        "age": F.when(C("age") < 0, "n/a").otherwise(C("age").cast("string")),
        "bmi": C("bmi").cast("string"),
        "smoker": F.when(C("smoker") == 5, "").otherwise(C("smoker").cast("string")),
    })
    return cleaning.numeric_features(text).select("resident_id", "age", "bmi", "smoker")


def _clip_sql(name: str, low: float, high: float, digits: int) -> str:
    value = f"CASE WHEN {name} < {low} THEN {low} WHEN {name} > {high} THEN {high} ELSE {name} END"
    factor = float(10 ** digits)
    return f"CAST(round_even(CAST({value} AS DOUBLE) * {factor}::DOUBLE, 0) AS DOUBLE) / {factor}::DOUBLE AS {name}"


@query("p08_legal_ranges", with_residents("SELECT resident_id, " + ", ".join(
    _clip_sql(name, *map(float, contract.RANGES[name]), 2 if name == "bmi" else 0) for name in contract.FEATURES
) + " FROM (SELECT * REPLACE (bmi * 1.0371 AS bmi, age + 0.5 AS age) FROM residents) q"))
def legal_ranges(spark, sf_dir):
    df = residents(spark, sf_dir).withColumns({
        "bmi": C("bmi") * 1.0371, "age": (C("age") + F.lit(0.5)).cast("double")})
    shaped = cleaning.legal_features(cleaning.numeric_features(df), keep_missing=True)
    return shaped.select("resident_id", *contract.FEATURES)


@query("p09_sample_weight", with_residents("""
SELECT resident_id, CASE WHEN regexp_matches(coalesce(place, ''), '成都|四川|中国') THEN 4.0::DOUBLE
  ELSE 1.0::DOUBLE END AS sample_weight
FROM (SELECT resident_id, CASE WHEN gender = 1 THEN '四川省' || region WHEN bmi IS NOT NULL THEN region END AS place
  FROM residents) q"""))
def sample_weight(spark, sf_dir):
    place = F.when(C("gender") == 1, F.concat(F.lit("四川省"), "region")).when(C("bmi").isNotNull(), C("region"))
    df = residents(spark, sf_dir).select("resident_id", place.alias("region"))
    return df.select("resident_id", cleaning.sample_weight(df).alias("sample_weight"))


@query("p10_feature_shape", with_clean("""
SELECT resident_id, round(bmi, 2) AS bmi, 1.0::DOUBLE AS sample_weight FROM clean"""))
def feature_shape(spark, sf_dir):
    return cleaning.feature_layer(cleaning.clean(residents(spark, sf_dir))).select(
        "resident_id", "bmi", "sample_weight")


@query("p31_period_check", """
SELECT o_orderkey, period, regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2]|Q[1-4])') AS valid FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m')
    WHEN 'O' THEN strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period FROM orders) q""")
def period_check(spark, sf_dir):
    """Months, quarters and full dates; only the first two are periods."""
    day = C("o_orderdate")
    period = (
        F.when(C("o_orderstatus") == "F", F.date_format(day, "yyyy-MM"))
        .when(C("o_orderstatus") == "O", F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", period.alias("period")).withColumn(
        "valid", cleaning.is_period(C("period")))


@query("p32_age_bands", with_residents("""
SELECT resident_id, CASE WHEN age > 17 AND age <= 39 THEN '18-39' WHEN age > 39 AND age <= 59 THEN '40-59'
  WHEN age > 59 AND age <= 74 THEN '60-74' WHEN age > 74 AND age <= 90 THEN '75-90' END AS age_group
FROM residents"""))
def age_bands(spark, sf_dir):
    return residents(spark, sf_dir).select("resident_id", cleaning.age_band(C("age")).alias("age_group"))


@query("p33_derived_measures", with_residents("""
SELECT resident_id, CAST(round_even(bmi * pow(height_cm / 100.0::DOUBLE, 2) * 10.0::DOUBLE, 0) AS DOUBLE) / 10.0::DOUBLE
    AS weight_kg,
  CAST(substr(district, 8) AS INTEGER) * 1000 + CAST(community_id % 1000 AS INTEGER) AS community_code,
  CASE WHEN label_stroke = 1 THEN 2 WHEN label_heart = 1 THEN 1 ELSE 0 END AS target_disease FROM residents"""))
def derived_measures(spark, sf_dir):
    code = F.substring("district", 8, 10).cast("int") * 1000 + (C("community_id") % 1000).cast("int")
    return residents(spark, sf_dir).select(
        "resident_id",
        cleaning.body_weight(C("bmi"), C("height_cm")).alias("weight_kg"),
        code.alias("community_code"),
        cleaning.legacy_target(C("label_heart"), C("label_stroke")).alias("target_disease"),
    )
