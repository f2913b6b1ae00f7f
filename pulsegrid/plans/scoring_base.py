"""Complete and scored residents, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions.grading import DEMO_WEIGHTS, demo_probability
from pulsegrid.plans.checks import COMPLETE, scored_sql
from pulsegrid.sources.tables import residents

C = F.col

SCORED_PARTS = [COMPLETE, scored_sql(DEMO_WEIGHTS, contract.FEATURES)]


def complete_residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residents whose unknown values are replaced by fixed stand-ins."""
    return residents(spark, sf_dir).withColumns({
        "age": F.when(C("age") > 0, C("age")).otherwise(57),
        "bmi": F.coalesce("bmi", F.lit(25.0)),
        "cholesterol": F.when(C("cholesterol").isin(1, 2, 3), C("cholesterol")).otherwise(1),
        "smoker": F.when(C("smoker").isin(0, 1, 2), C("smoker")).otherwise(0),
    }).drop("name", "phone", "height_cm")


def scored_residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_residents(spark, sf_dir).withColumns({
        "heart_probability": demo_probability("heart"),
        "stroke_probability": demo_probability("stroke"),
    })
