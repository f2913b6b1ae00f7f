"""Region reports with coverage inference and small-group suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions.cleaning import comorbid_strict
from pulsegrid.functions.numeric import count_if, percent

C = F.col

LABELS_SOURCE = "labels"
MODEL_SOURCE = "model_probability"
NO_SOURCE = "unavailable"
MAP_CITY = "成都市"
MAP_NAME = "chengdu"


def coverage(df: DataFrame) -> DataFrame:
    """One row: several districts cover a city (or all), one district is shown as a table.

    Districts are reduced to a distinct list before they are counted, so the count
    moves a handful of rows however many residents there are.
    """
    places = df.groupBy("region", "district").agg(F.count(F.lit(1)).alias("n"))
    found = places.agg(
        F.count_distinct("district").alias("districts"),
        F.min("district").alias("first_district"),
        F.min("region").alias("first_city"),
        F.max("region").alias("last_city"),
    )
    return found.select(*[value.alias(name) for name, value in _coverage_columns().items()])


def _coverage_columns() -> dict[str, Column]:
    """Coverage from the number of districts and the first and last names."""
    many, one_city = C("districts") > 1, C("first_city") == C("last_city")
    mapped = many & one_city & (C("first_city") == MAP_CITY)
    return {
        "coverage_level": F.when(many, "district").otherwise("table"),
        "coverage_name": F.when(~many, C("first_district")).when(one_city, C("first_city")).otherwise("multiple"),
        "map_available": F.coalesce(mapped, F.lit(False)),
        "map_name": F.when(mapped, MAP_NAME),
    }


def _number_or_null(df: DataFrame, name: str) -> Column:
    return C(name) if name in df.columns else F.lit(None).cast("double")


def region_counters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Additive counters by group.

    Sums of counters of parts equal the counters of the whole, so input may
    arrive in any number of files or batches.
    """
    heart, stroke = _number_or_null(df, "label_heart"), _number_or_null(df, "label_stroke")
    p_heart, p_stroke = _number_or_null(df, "heart_probability"), _number_or_null(df, "stroke_probability")
    cutoff = contract.LEVEL_CUTOFFS[1]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("residents"),
        F.count(heart).alias("heart_labelled"),
        F.count(stroke).alias("stroke_labelled"),
        count_if(heart == 1).alias("heart_positive"),
        count_if(stroke == 1).alias("stroke_positive"),
        count_if(comorbid_strict(heart, stroke)).alias("comorbidity"),
        F.count(p_heart).alias("heart_scored"),
        F.count(p_stroke).alias("stroke_scored"),
        count_if(p_heart.isNotNull() & p_stroke.isNotNull()).alias("both_scored"),
        count_if(p_heart >= cutoff).alias("heart_high"),
        count_if(p_stroke >= cutoff).alias("stroke_high"),
        count_if((p_heart >= cutoff) & (p_stroke >= cutoff)).alias("predicted_comorbidity"),
    )


COUNTERS = [
    "residents", "heart_labelled", "stroke_labelled", "heart_positive", "stroke_positive", "comorbidity",
    "heart_scored", "stroke_scored", "both_scored", "heart_high", "stroke_high", "predicted_comorbidity",
]


def merge_counters(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in COUNTERS])


def region_rates(counters: DataFrame) -> DataFrame:
    """Rates by group, from labels when the group has them, else from model scores.

    A rate is never made up: without labels and scores it stays null. Each model
    rate is a share of the residents that have the scores it is about.
    """
    labelled = (C("heart_labelled") > 0) & (C("stroke_labelled") > 0)
    scored = (C("heart_scored") > 0) | (C("stroke_scored") > 0)

    def rate(positive: str, known: str, high: str, scores: str) -> Column:
        part = F.when(labelled, C(positive)).otherwise(C(high))
        return percent(part, F.when(labelled, C(known)).otherwise(C(scores)))

    return counters.withColumns({
        "risk_metric_source": F.when(labelled, LABELS_SOURCE).when(scored, MODEL_SOURCE).otherwise(NO_SOURCE),
        "heart_rate": rate("heart_positive", "heart_labelled", "heart_high", "heart_scored"),
        "stroke_rate": rate("stroke_positive", "stroke_labelled", "stroke_high", "stroke_scored"),
        "comorbidity_rate": rate("comorbidity", "residents", "predicted_comorbidity", "both_scored"),
    })


def label_rates(counters: DataFrame) -> DataFrame:
    """Rates from labels only; null where no labels are known."""
    return counters.withColumns({
        "heart_rate": percent(C("heart_positive"), C("heart_labelled")),
        "stroke_rate": percent(C("stroke_positive"), C("stroke_labelled")),
        "comorbidity_rate": F.when(
            (C("heart_labelled") > 0) & (C("stroke_labelled") > 0), percent(C("comorbidity"), C("residents"))),
    })


HIDDEN = ["residents", "heart_rate", "stroke_rate", "comorbidity_rate"]


def _derivable(hidden: Column, held: Column, minimum: int) -> Column:
    """Whether hidden groups can be told to be small from their common total.

    Of several hidden groups with a known total each may hold all that the others, at one resident each, leave. Unless there
    are two and that is at least ``minimum``, the total shows that a group is small, or its very size.
    """
    return (hidden > 0) & ~((hidden > 1) & (held - (hidden - 1) >= minimum))


def suppress_small(
    rates: DataFrame, minimum: int = contract.MIN_GROUP_SIZE, parents: list[str] | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Hide size and rates of groups below ``minimum``; the key and the flag stay.

    With ``parents``, whose totals are known, a parent's hidden groups must not follow from its total. Where they would, its
    smallest other group is hidden too, the cheapest cell that protects: it holds at least ``minimum`` residents, so one is
    enough. Parents are summed up by an aggregate, so one with many groups is no single task. Where there is no other
    group, ``parent_exposed`` says that the parent's own total has to be hidden.
    """
    small = C("residents") < minimum
    if parents is None:
        flagged = rates.withColumn("suppressed", small)
    else:
        place = F.struct("residents", *[k for k in keys if k not in parents])
        sums = rates.groupBy(*[C(p).alias(f"_{p}") for p in parents]).agg(
            count_if(small).alias("_hidden"), F.coalesce(F.sum(F.when(small, C("residents"))), F.lit(0)).alias("_held"),
            F.min(F.when(~small, place)).alias("_cover"))
        same = [C(p).eqNullSafe(C(f"_{p}")) for p in parents]
        exposed = _derivable(C("_hidden"), C("_held"), minimum)
        flagged = rates.join(sums, same).withColumns({
            "suppressed": small | (exposed & F.coalesce(C("_cover").eqNullSafe(place), F.lit(False))),
            "parent_exposed": exposed & C("_cover").isNull(),
        }).drop("_hidden", "_held", "_cover", *[f"_{p}" for p in parents])
    visible = {name: F.when(~C("suppressed"), C(name)) for name in HIDDEN if name in rates.columns}
    return flagged.withColumns(visible)


def region_report(df: DataFrame, keys: list[str], minimum: int = contract.MIN_GROUP_SIZE) -> DataFrame:
    """Group report: suppressed groups last, larger groups first. Groups of several keys are protected against the totals
    of the keys before the last one."""
    rates = label_rates(region_counters(df, keys)).select(*keys, *HIDDEN)
    shown = suppress_small(rates, minimum, keys[:-1] or None, keys).drop("parent_exposed")
    return shown.orderBy("suppressed", C("residents").desc_nulls_last(), *keys)


def parent_report(df: DataFrame, keys: list[str], minimum: int = contract.MIN_GROUP_SIZE) -> DataFrame:
    """Report of the keys before the last one that fits ``region_report``: a total that would show its only hidden groups is hidden.

    Both levels come from one aggregate of the rows.
    """
    parents = keys[:-1]
    counters = region_counters(df, keys)
    inner = suppress_small(label_rates(counters).select(*keys, *HIDDEN), minimum, parents, keys)
    exposed = inner.groupBy(*[C(p).alias(f"_{p}") for p in parents]).agg(F.bool_or("parent_exposed").alias("exposed"))
    outer = label_rates(merge_counters(counters, parents)).select(*parents, *HIDDEN)
    joined = suppress_small(outer, minimum).join(exposed, [C(p).eqNullSafe(C(f"_{p}")) for p in parents])
    hidden = C("suppressed") | C("exposed")
    return joined.withColumns({"suppressed": hidden, **{name: F.when(~hidden, C(name)) for name in HIDDEN}}).select(*parents, *HIDDEN, "suppressed")


def population_summary(df: DataFrame, metadata: dict[str, str], minimum: int = contract.MIN_GROUP_SIZE) -> DataFrame:
    """One row per population: totals, coverage and the list of region rows.

    The data is aggregated once, by city and district; totals, coverage and the
    list all come from that small table. The list has one entry per district, with the source of its rates. Where the
    size of a hidden district would follow from the totals, the smallest other district is hidden too; the totals
    themselves are hidden when they are below ``minimum`` or when there is no other district.
    """
    by_place = region_counters(df, ["region", "district"])
    by_district = by_place.groupBy("district").agg(
        F.min("region").alias("first_city"), F.max("region").alias("last_city"),
        *[F.sum(name).alias(name) for name in COUNTERS])
    small = C("residents") < minimum
    entry = F.struct(C("district").alias("region"), *HIDDEN, "risk_metric_source")
    single = region_rates(by_district).agg(
        count_if(small).alias("hidden"), F.coalesce(F.sum(F.when(small, C("residents"))), F.lit(0)).alias("held"),
        F.min(F.when(~small, F.struct("residents", "district"))).alias("cover"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.count("district").alias("districts"), F.min("district").alias("first_district"),
        F.min("first_city").alias("first_city"), F.max("last_city").alias("last_city"),
        *[F.sum(name).alias(name) for name in COUNTERS],
    )
    exposed = _derivable(C("hidden"), C("held"), minimum)

    def shown(e: Column) -> Column:
        cover = F.coalesce(C("exposed") & (C("cover.residents") == e["residents"]) & C("cover.district").eqNullSafe(e["region"]), F.lit(False))
        hide = (e["residents"] < minimum) | cover
        return F.struct(e["region"].alias("region"), *[F.when(~hide, e[name]).alias(name) for name in HIDDEN], hide.alias("suppressed"), e["risk_metric_source"].alias("risk_metric_source"))

    secret = (C("residents") < minimum) | (exposed & C("cover").isNull())
    return region_rates(single).withColumns({"exposed": exposed, "totals_suppressed": secret}).withColumn(
        "region_analysis", F.transform("entries", shown)).select(
        *[F.when(~C("totals_suppressed"), C(name)).alias(as_) for name, as_ in (
            ("residents", "total_residents"), ("heart_rate", "heart_risk_rate"), ("stroke_rate", "stroke_risk_rate"),
            ("comorbidity_rate", "comorbidity_rate"))],
        "totals_suppressed", "risk_metric_source",
        *[value.alias(name) for name, value in _coverage_columns().items()],
        "region_analysis",
        *[F.lit(value).alias(name) for name, value in metadata.items()],
    )
