"""Per-record feature contributions, their ranking, and the merge of two models.

A record has nine features, so its factors are sorted in one small array inside
the row: no shuffle, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading
from pulsegrid.functions.numeric import add_all, round_exact, round_to_grid

C = F.col
TOP_PER_MODEL = 3
TOP_COMBINED = 4
POSITIONS = 16


# -- contributions --------------------------------------------------------------

def linear_contributions(weights: dict[str, float], baseline: dict[str, float]) -> dict[str, Column]:
    """Exact contributions of a linear margin: weight times distance from the baseline."""
    return {
        name: F.lit(weights[name]) * (C(name).cast("double") - F.lit(baseline[name])) for name in contract.FEATURES}


def mean_features(df: DataFrame) -> dict[str, float]:
    """Feature means, four decimals, as the reference point of contributions."""
    means = df.agg(*[F.avg(name).alias(name) for name in contract.FEATURES])
    row = means.select(*[round_exact(C(name), 4).alias(name) for name in contract.FEATURES]).first()
    return row.asDict()


def _order(column: str, sign: int, position: int) -> Column:
    """Whole number that sorts the strongest value of a sign first, ties by feature order.

    Contributions have six decimals; the last four bits hold the feature's position.
    """
    return F.rint(C(column) * F.lit(-sign * 1e6)).cast("bigint") * POSITIONS + position


def _sorted(columns: list[str], sign: int) -> Column:
    return F.sort_array(F.array(*[_order(column, sign, k) for k, column in enumerate(columns)]))


def rank_contributions(df: DataFrame, contributions: dict[str, Column], prefix: str = "") -> DataFrame:
    """Add contribution and share of the total for every feature, and both rankings.

    Columns are ``{prefix}contribution_x``, ``{prefix}impact_x``, ``{prefix}raising``
    and ``{prefix}lowering``. An unknown feature contributes nothing.
    """
    raw = {name: f"{prefix}raw_{name}" for name in contract.FEATURES}
    kept = {name: f"{prefix}contribution_{name}" for name in contract.FEATURES}
    total, whole = f"{prefix}total", C(f"{prefix}total")
    return (
        df.withColumns({raw[name]: F.coalesce(contributions[name], F.lit(0.0)) for name in raw})
        .withColumn(total, add_all([F.abs(C(column)) for column in raw.values()]))
        .withColumn(total, F.when(whole == 0, 1.0).otherwise(whole))
        .withColumns({
            **{kept[name]: round_to_grid(C(raw[name]), 6) for name in raw},
            **{f"{prefix}impact_{name}": round_to_grid(F.abs(C(raw[name])) / whole * 100, 2) for name in raw},
        })
        .withColumns({
            f"{prefix}raising": _sorted(list(kept.values()), 1),
            f"{prefix}lowering": _sorted(list(kept.values()), -1),
        })
        .drop(total, *raw.values())
    )


def _ranked_rows(df: DataFrame, keep: list[str], prefix: str, limit: int, fields: dict[str, Column]) -> DataFrame:
    """Unfold the first ``limit`` places of both rankings; fields are arrays in feature order."""
    best = F.concat(F.slice(C(f"{prefix}raising"), 1, limit), F.slice(C(f"{prefix}lowering"), 1, limit))
    rows = df.select(*keep, *[value.alias(f"list_{name}") for name, value in fields.items()],
                     F.posexplode(best).alias("slot", "factor"))
    position = (C("factor").bitwiseAND(F.lit(POSITIONS - 1)) + 1).cast("int")
    # below zero: the value has the sign of its ranking and is not zero
    return rows.filter(C("factor") < 0).select(
        *keep,
        (C("slot") % limit + 1).alias("place"),
        F.when(C("slot") < limit, "increase").otherwise("decrease").alias("direction"),
        F.element_at(F.array(*[F.lit(name) for name in contract.FEATURES]), position).alias("feature"),
        *[F.element_at(C(f"list_{name}"), position).alias(name) for name in fields],
    )


def _ranked_list(prefix: str, limit: int, fields: dict[str, Column]) -> Column:
    """The first ``limit`` places of both rankings as an array; fields are arrays in feature order."""
    best = F.concat(F.slice(C(f"{prefix}raising"), 1, limit), F.slice(C(f"{prefix}lowering"), 1, limit))
    names = F.array(*[F.lit(name) for name in contract.FEATURES])

    def entry(factor: Column, slot: Column) -> Column:
        position = (factor.bitwiseAND(F.lit(POSITIONS - 1)) + 1).cast("int")
        return F.when(factor < 0, F.struct(
            (slot % limit + 1).alias("place"), F.when(slot < limit, "increase").otherwise("decrease").alias("direction"),
            F.element_at(names, position).alias("feature"), *[F.element_at(value, position).alias(name) for name, value in fields.items()]))

    return F.array_compact(F.transform(best, entry))


def factor_list(prefix: str = "", limit: int = TOP_PER_MODEL) -> Column:
    """A model's top factors with their display texts, as an array in the row."""
    names, values = _labels()
    return _ranked_list(prefix, limit, {
        "feature_label": names, "value_label": values,
        "contribution": _feature_array(prefix + "contribution_{}"), "impact_percent": _feature_array(prefix + "impact_{}"),
    })


def combined_list(models: dict[str, str], limit: int = TOP_COMBINED) -> Column:
    """The merged top factors with their sources, as an array in the row."""
    listed = _ranked_list("sum_", limit, {
        "contribution": _feature_array("sum_contribution_{}"), "impact_percent": _feature_array("sum_impact_{}"), "sources": _feature_array("sum_models_{}"),
    })
    bits = [(1 << bit, model) for bit, model in enumerate(models)]
    return F.transform(listed, lambda f: f.withField("contribution", round_to_grid(f["contribution"], 6)).withField(
        "impact_percent", round_to_grid(f["impact_percent"], 2)).withField("sources", F.array_compact(F.array(*[
            F.when(f["sources"].bitwiseAND(F.lit(bit)) > 0, F.lit(model)) for bit, model in bits]))))


def _feature_array(pattern: str) -> Column:
    return F.array(*[C(pattern.format(name)) for name in contract.FEATURES])


def _labels() -> tuple[Column, Column]:
    names = F.array(*[F.lit(V.FEATURE_NAMES[name]) for name in contract.FEATURES])
    return names, F.array(*[grading.value_label(name, C(name)) for name in contract.FEATURES])


def factor_rows(df: DataFrame, keep: list[str], prefix: str = "", limit: int = TOP_PER_MODEL) -> DataFrame:
    """One row per top factor with its display texts."""
    names, values = _labels()
    return _ranked_rows(df, keep, prefix, limit, {
        "feature_label": names, "value_label": values,
        "contribution": _feature_array(prefix + "contribution_{}"), "impact_percent": _feature_array(prefix + "impact_{}"),
    })


def contribution_rows(df: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """All nine features of every record."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), C(f"{prefix}contribution_{name}").alias("contribution"),
                 C(f"{prefix}impact_{name}").alias("impact_percent"))
        for name in contract.FEATURES])))


def combine_models(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """Merge the top factors of several models by feature and rank the sums.

    ``models`` maps a model's name to the prefix of its ranked columns. A feature
    counts only for the models that list it among their top factors, that is,
    when it sorts no later than the last listed place.
    """
    listed, summed = {}, {}
    for position, name in enumerate(contract.FEATURES):
        for model, prefix in models.items():
            own = f"{prefix}contribution_{name}"
            raises = (C(own) > 0) & (_order(own, 1, position) <= C(f"{prefix}raising")[TOP_PER_MODEL - 1])
            lowers = (C(own) < 0) & (_order(own, -1, position) <= C(f"{prefix}lowering")[TOP_PER_MODEL - 1])
            listed[f"listed_{model}_{name}"] = raises | lowers
        for kind in ("contribution", "impact"):
            summed[f"sum_{kind}_{name}"] = add_all([
                F.when(C(f"listed_{m}_{name}"), C(f"{p}{kind}_{name}")).otherwise(0.0) for m, p in models.items()])
        # one bit per model; the names are written out only for the rows that are kept
        summed[f"sum_models_{name}"] = add_all([
            C(f"listed_{m}_{name}").cast("int") * (1 << bit) for bit, m in enumerate(models)])
    columns = [f"sum_contribution_{name}" for name in contract.FEATURES]
    return df.withColumns(listed).withColumns(summed).drop(*listed).withColumns({
        "sum_raising": _sorted(columns, 1), "sum_lowering": _sorted(columns, -1)})


def _source_names(models: dict[str, str]) -> Column:
    bits = C("sources")
    return F.concat_ws("|", *[
        F.when(bits.bitwiseAND(F.lit(1 << bit)) > 0, F.lit(m)) for bit, m in enumerate(models)])


def combined_rows(df: DataFrame, keep: list[str], models: dict[str, str], limit: int = TOP_COMBINED) -> DataFrame:
    """One row per top factor of the merged list."""
    rows = _ranked_rows(df, keep, "sum_", limit, {
        "contribution": _feature_array("sum_contribution_{}"), "impact_percent": _feature_array("sum_impact_{}"),
        "sources": _feature_array("sum_models_{}"),
    })
    return rows.withColumns({
        "contribution": round_to_grid(C("contribution"), 6), "impact_percent": round_to_grid(C("impact_percent"), 2),
        "sources": _source_names(models)})


def merged_rows(df: DataFrame, keep: list[str], models: dict[str, str]) -> DataFrame:
    """Every feature listed by any model, with its sums and sources."""
    rows = df.select(*keep, F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("feature"), C(f"sum_contribution_{name}").alias("contribution"),
            C(f"sum_impact_{name}").alias("impact_percent"), C(f"sum_models_{name}").alias("sources"),
        ) for name in contract.FEATURES]))).filter(C("sources") > 0)
    return rows.withColumns({
        "contribution": round_to_grid(C("contribution"), 6), "impact_percent": round_to_grid(C("impact_percent"), 2),
        "sources": _source_names(models)})
