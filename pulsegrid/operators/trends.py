"""Snapshots over time and scenario comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions.cleaning import is_period
from pulsegrid.operators import regions

C = F.col
SCOPE = ["coverage_level", "coverage_name", "model_version"]


def snapshots(df: DataFrame, coverage_column: str, model_version: Column) -> DataFrame:
    """One summary row per period and place."""
    counters = regions.region_counters(
        df.withColumn("model_version", model_version), [coverage_column, "model_version", "data_period"])
    return regions.region_rates(counters).select(
        "data_period",
        F.lit(coverage_column).alias("coverage_level"),
        C(coverage_column).alias("coverage_name"),
        "model_version",
        C("residents").alias("sample_size"),
        C("heart_rate").alias("heart_risk_rate"),
        C("stroke_rate").alias("stroke_risk_rate"),
        "comorbidity_rate", "risk_metric_source",
    )


def trend_series(rows: DataFrame) -> DataFrame:
    """Comparable snapshots with the number of points of their series.

    Only rows that share coverage and model version form a series; months and
    quarters are kept apart. A series needs two points to be available. Each
    series holds one row per period, so the windows stay small.
    """
    kind = F.when(C("data_period").contains("Q"), "quarter").otherwise("month")
    scope = Window.partitionBy(*SCOPE, "period_kind")
    return (
        rows.filter(is_period(C("data_period")))
        .withColumn("period_kind", kind)
        .withColumns({
            "points": F.count(F.lit(1)).over(scope),
            "position": F.row_number().over(scope.orderBy("data_period")),
        })
        .withColumn("available", C("points") >= 2)
    )


def compare_scenarios(rows: DataFrame, changes: dict[str, Column], scores: dict[str, Column], key: str) -> DataFrame:
    """Scores of every record as it is and with its features changed, side by side.

    Both are columns of the record's own row: the scores are taken, the features changed, and the scores taken again.
    """
    before = rows.withColumns({f"baseline_{name}": score for name, score in scores.items()})
    after = apply_scenario(before, changes).withColumns({f"scenario_{name}": score for name, score in scores.items()})
    sides = [f"{side}_{name}" for side in ("baseline", "scenario") for name in scores]
    return after.select(key, *sides, *[(C(f"scenario_{name}") - C(f"baseline_{name}")).alias(f"{name}_change") for name in scores])


def apply_scenario(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Change model features only; any other column is refused."""
    foreign = [name for name in changes if name not in contract.FEATURES]
    if foreign:
        raise ValueError(f"a scenario may only change model features, not {foreign}")
    return df.withColumns(changes)
