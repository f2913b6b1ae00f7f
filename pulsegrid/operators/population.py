"""Population reports: key figures, districts, age bands, risk factors, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.cleaning import comorbid_known, comorbid_strict, follow_up_score, needs_follow_up
from pulsegrid.functions.numeric import count_if, percent

C = F.col


def _heart() -> Column:
    return C("label_heart")


def _stroke() -> Column:
    return C("label_stroke")


def population_scan(df: DataFrame) -> DataFrame:
    """The eleven report columns and nothing else; missing columns are an error."""
    contract.require_columns(df.columns, contract.POPULATION_COLUMNS)
    return df.select(*contract.POPULATION_COLUMNS)


def key_figures(df: DataFrame) -> DataFrame:
    """One row: residents, percentages of each outcome, residents to follow up."""
    return df.agg(
        F.count(F.lit(1)).alias("total_residents"),
        percent(count_if(_heart() == 1), F.count("label_heart")).alias("heart_risk_rate"),
        percent(count_if(_stroke() == 1), F.count("label_stroke")).alias("stroke_risk_rate"),
        percent(count_if(comorbid_strict(_heart(), _stroke())), F.count(F.lit(1))).alias("comorbidity_rate"),
        count_if(needs_follow_up(C("age"), _heart(), _stroke())).alias("high_risk_follow_up_count"),
    )


def district_report(df: DataFrame) -> DataFrame:
    """Residents and percentages by district, highest stroke rate first."""
    report = df.groupBy("district").agg(
        F.count(F.lit(1)).alias("residents"),
        percent(count_if(_heart() == 1), F.count("label_heart")).alias("heart_rate"),
        percent(count_if(_stroke() == 1), F.count("label_stroke")).alias("stroke_rate"),
        percent(count_if(comorbid_strict(_heart(), _stroke())), F.count(F.lit(1))).alias("comorbidity_rate"),
    )
    return report.orderBy(C("stroke_rate").desc(), "district")


def district_means(df: DataFrame) -> DataFrame:
    """Residents and plain mean rates by district; unknown labels are left out of the mean."""
    return df.groupBy("district").agg(
        F.count(F.lit(1)).alias("residents"),
        F.avg("label_heart").alias("heart_risk_rate"),
        F.avg("label_stroke").alias("stroke_risk_rate"),
        F.avg(comorbid_known(_heart(), _stroke())).alias("comorbidity_rate"),
    )


def age_band_report(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("age_group")
        .agg(
            F.count(F.lit(1)).alias("residents"),
            F.sum("label_heart").alias("heart"),
            F.sum("label_stroke").alias("stroke"),
        )
        .orderBy("age_group")
    )


def risk_factor_report(df: DataFrame) -> DataFrame:
    """Prevalence of six risk factors in long form, highest first.

    One pass computes all counts; the six result rows are then unfolded from the
    single aggregate row.
    """
    total = F.count(F.lit(1))
    counted = {
        "hypertension": (count_if(C("hypertension") == 1), F.count("hypertension")),
        "diabetes": (count_if(C("diabetes") == 1), F.count("diabetes")),
        "cholesterol": (count_if(C("cholesterol") >= 2), total),
        "smoker": (count_if(C("smoker") == 2), total),
        "bmi": (count_if(C("bmi") >= 25), total),
        "exercise": (count_if(C("exercise") == 0), total),
    }
    rows = F.array(*[
        F.struct(F.lit(V.RISK_FACTOR_NAMES[name]).alias("name"), part.alias("part"), whole.alias("whole"))
        for name, (part, whole) in counted.items()
    ])
    long = df.agg(rows.alias("rows")).select(F.inline("rows"))
    return long.select("name", percent(C("part"), C("whole")).alias("rate")).orderBy(C("rate").desc(), "name")


def follow_ups(df: DataFrame) -> DataFrame:
    """Residents needing follow-up with their 0 to 5 score and the stated reason."""
    return (
        df.filter(needs_follow_up(C("age"), _heart(), _stroke()))
        .withColumns({"risk_score": follow_up_score(), "screening_basis": F.lit(V.SCREENING_BASIS)})
    )


def follow_up_order() -> list:
    """Score and age descending; the unique resident id settles ties, so equal
    scores spread over many range partitions."""
    return [C("risk_score").desc_nulls_last(), C("age").desc(), C("resident_id")]


def ranked_follow_ups(df: DataFrame) -> DataFrame:
    return follow_ups(df).orderBy(*follow_up_order())


def top_follow_ups(df: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` follow-ups, limit held within 1 to 500."""
    kept = max(1, min(int(limit), contract.FOLLOW_UP_LIMIT))
    return ranked_follow_ups(df).limit(kept)
