"""Validation, grading and explanation texts of one record, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.numeric import is_finite, round_exact, to_number

C = F.col


def present(*items: Column) -> Column:
    """Array of the items that are not null.

    Items are distinct, so a set difference with null does it; unlike
    ``array_compact`` it is compiled together with the items.
    """
    return F.array_except(F.array(*items), F.array(F.lit(None)))


# -- validation ---------------------------------------------------------------

def range_reason(limits: tuple) -> str:
    return f"{V.REASON_RANGE_PREFIX}{limits[0]}~{limits[1]}"


def with_numbers(df: DataFrame) -> DataFrame:
    """Read every text field as a number once, into ``number_x``; all checks use these."""
    names = [name for name in [*contract.FEATURES, *contract.OPTIONAL_RANGES] if name in df.columns]
    return df.withColumns({f"number_{name}": to_number(C(name)) for name in names})


def required_reason(name: str) -> Column:
    """Why a required text field is invalid; null when it is fine or missing."""
    low, high = contract.RANGES[name]
    number = C(f"number_{name}")
    reason = (
        F.when(C(name).isNull(), F.lit(None).cast("string"))
        .when(number.isNull(), V.REASON_NOT_NUMBER)
        .when(~is_finite(number), V.REASON_NOT_FINITE)
        .when(~number.between(low, high), range_reason((low, high)))
    )
    if name != "bmi":
        reason = reason.when(number != F.floor(number), V.REASON_NOT_CODE)
    return reason


def optional_reason(name: str) -> Column:
    """Same for an optional field; null and empty text are skipped."""
    low, high = contract.OPTIONAL_RANGES[name]
    number = C(f"number_{name}")
    reason = (
        F.when(C(name).isNull() | (C(name) == ""), F.lit(None).cast("string"))
        .when(number.isNull(), V.REASON_NOT_NUMBER)
        .when(~is_finite(number) | ~number.between(low, high), range_reason((low, high)))
    )
    if name == "family_history":
        reason = reason.when(number != F.floor(number), V.REASON_NOT_CODE)
    return reason


def missing_fields() -> Column:
    return present(*[F.when(C(name).isNull(), name) for name in contract.FEATURES])


def invalid_fields(optional: list[str]) -> Column:
    """Map of field name to reason, invalid fields only."""
    pairs = [(name, required_reason(name)) for name in contract.FEATURES]
    pairs += [(name, optional_reason(name)) for name in contract.OPTIONAL_RANGES if name in optional]
    entries = [
        F.when(reason.isNotNull(), F.struct(F.lit(name).alias("key"), reason.alias("value")))
        for name, reason in pairs
    ]
    return F.map_from_entries(present(*entries))


def is_valid(optional: list[str]) -> Column:
    """Nothing missing and nothing invalid."""
    tests = [C(name).isNotNull() & required_reason(name).isNull() for name in contract.FEATURES]
    tests += [optional_reason(name).isNull() for name in contract.OPTIONAL_RANGES if name in optional]
    return reduce(lambda a, b: a & b, tests)


def normal_record(columns: list[str]) -> dict[str, Column]:
    """Typed values of a valid record: codes truncated, measures with two decimals."""
    shaped = {}
    for name in [*contract.FEATURES, "family_history"]:
        if name in columns and name != "bmi":
            shaped[name] = C(f"number_{name}").cast("int")
    for name in ("bmi", "systolic_bp", "diastolic_bp", "fasting_glucose"):
        if name in columns:
            shaped[name] = round_exact(C(f"number_{name}"), 2)
    return shaped


# -- grading ------------------------------------------------------------------

def level_code(probability: Column) -> Column:
    """Level 1 to 5; every cut-off belongs to the upper level."""
    code = F.when(probability < contract.LEVEL_CUTOFFS[0], 1)
    for position, cutoff in enumerate(contract.LEVEL_CUTOFFS[1:], start=2):
        code = code.when(probability < cutoff, position)
    return code.when(probability.isNotNull(), 5)


def _by_code(code: Column, texts: dict[int, str]) -> Column:
    chosen = None
    for key, text in texts.items():
        chosen = F.when(code == key, text) if chosen is None else chosen.when(code == key, text)
    return chosen


def level_name(code: Column) -> Column:
    return _by_code(code, {key: name for key, name, _ in V.RISK_LEVELS})


def level_color(code: Column) -> Column:
    return _by_code(code, {key: color for key, _, color in V.RISK_LEVELS})


def overall_probability(heart: Column, stroke: Column) -> Column:
    return F.greatest(heart, stroke)


def final_category(heart: Column, stroke: Column) -> Column:
    """0 none, 1 heart, 2 stroke, 3 both; an unknown probability counts as negative."""
    cutoff = contract.LEVEL_CUTOFFS[1]

    def positive(probability: Column) -> Column:
        return F.coalesce(probability >= cutoff, F.lit(False)).cast("int")

    return positive(heart) + 2 * positive(stroke)


def summary_text(category: Column, level: Column) -> Column:
    return (
        F.when(category == 1, V.SUMMARY_HEART).when(category == 2, V.SUMMARY_STROKE)
        .when(category == 3, V.SUMMARY_BOTH).when(level > 1, V.SUMMARY_WATCH)
        .otherwise(V.SUMMARY_HEALTHY)
    )


def probability_percent(probability: Column) -> Column:
    return round_exact(probability * 100, 2)


def pressure_high() -> Column:
    return (C("systolic_bp") >= 140) | (C("diastolic_bp") >= 90)


def highlights(columns: list[str]) -> Column:
    """Sentences for every risk sign present; a default sentence when there is none."""
    checks = [
        (C("hypertension") == 1, V.HIGHLIGHT_HYPERTENSION),
        (C("cholesterol") >= 2, V.HIGHLIGHT_CHOLESTEROL),
        (C("diabetes") == 1, V.HIGHLIGHT_DIABETES),
        (C("smoker") >= 1, V.HIGHLIGHT_SMOKER),
        (C("alcohol") == 1, V.HIGHLIGHT_ALCOHOL),
        (C("exercise") == 0, V.HIGHLIGHT_EXERCISE),
        (C("bmi") >= 24, V.HIGHLIGHT_BMI),
    ]
    if "systolic_bp" in columns and "diastolic_bp" in columns:
        both = C("systolic_bp").isNotNull() & C("diastolic_bp").isNotNull()
        checks.append((both & pressure_high(), V.HIGHLIGHT_PRESSURE))
    if "fasting_glucose" in columns:
        checks.append((C("fasting_glucose") >= 7.0, V.HIGHLIGHT_GLUCOSE))
    if "family_history" in columns:
        checks.append((C("family_history") == 1, V.HIGHLIGHT_FAMILY))
    found = present(*[F.when(condition, text) for condition, text in checks])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(V.HIGHLIGHT_NONE)))


def _insight(key: str, present: Column, value: Column, status: Column, auxiliary: bool) -> Column:
    return F.when(present, F.struct(
        F.lit(V.INDICATOR_NAMES[key]).alias("indicator"),
        value.cast("string").alias("value"),
        status.alias("status"),
        F.lit(V.INDICATOR_COMMENTS[key]).alias("comment"),
        F.lit(auxiliary).alias("auxiliary"),
    ))


def insights(columns: list[str]) -> Column:
    """One struct per known indicator; unknown indicators are skipped."""

    def two_way(good: Column, good_text: str, bad_text: str) -> Column:
        return F.when(good, good_text).otherwise(bad_text)

    smoker_text = F.coalesce(_by_code(C("smoker"), V.CODE_LABELS["smoker"]), F.lit(V.STATUS_UNKNOWN))
    found = [
        _insight("hypertension", C("hypertension").isNotNull(), C("hypertension"),
                 two_way(C("hypertension") == 0, V.STATUS_NORMAL, V.STATUS_HYPERTENSION), False),
        _insight("cholesterol", C("cholesterol").isNotNull(), C("cholesterol"),
                 two_way(C("cholesterol") == 1, V.STATUS_NORMAL, V.STATUS_CHOLESTEROL), False),
        _insight("diabetes", C("diabetes").isNotNull(), C("diabetes"),
                 two_way(C("diabetes") == 0, V.STATUS_NORMAL, V.STATUS_DIABETES), False),
        _insight("bmi", C("bmi").isNotNull(), C("bmi"),
                 two_way(C("bmi") >= 24, V.STATUS_BMI, V.STATUS_NORMAL), False),
        _insight("smoker", C("smoker").isNotNull(), C("smoker"), smoker_text, False),
    ]
    if "systolic_bp" in columns and "diastolic_bp" in columns:
        found.append(_insight(
            "pressure", C("systolic_bp").isNotNull() & C("diastolic_bp").isNotNull(),
            F.concat(C("systolic_bp").cast("string"), F.lit("/"), C("diastolic_bp").cast("string"), F.lit(" mmHg")),
            two_way(pressure_high(), V.STATUS_PRESSURE, V.STATUS_IN_RANGE), True,
        ))
    if "fasting_glucose" in columns:
        found.append(_insight(
            "glucose", C("fasting_glucose").isNotNull(),
            F.concat(C("fasting_glucose").cast("string"), F.lit(" mmol/L")),
            two_way(C("fasting_glucose") >= 7.0, V.STATUS_GLUCOSE, V.STATUS_IN_RANGE), True,
        ))
    return present(*found)


def value_label(name: str, value: Column) -> Column:
    """Display text of a feature value."""
    if name in V.CODE_LABELS:
        return F.coalesce(_by_code(value.cast("int"), V.CODE_LABELS[name]), value.cast("string"))
    if name == "bmi":
        return F.format_string("%.1f", round_exact(value, 1))
    return value.cast("string")


# -- advice inputs ------------------------------------------------------------

def factor_flags() -> dict[str, Column]:
    """The seven advice factors; a missing value takes its harmless default."""
    return {
        "hypertension": F.coalesce(C("hypertension") == 1, F.lit(False)),
        "cholesterol": F.coalesce(C("cholesterol") >= 2, F.lit(False)),
        "diabetes": F.coalesce(C("diabetes") == 1, F.lit(False)),
        "smoker": F.coalesce(C("smoker") >= 1, F.lit(False)),
        "alcohol": F.coalesce(C("alcohol") == 1, F.lit(False)),
        "exercise": F.coalesce(C("exercise") == 0, F.lit(False)),
        "bmi": F.coalesce(C("bmi") >= 24, F.lit(False)),
    }


def active_factors(level: Column | None = None) -> Column:
    """Names of the active factors; levels 4 and 5 add ``risk_level``."""
    names = [F.when(flag, name) for name, flag in factor_flags().items()]
    if level is not None:
        names.append(F.when(level >= 4, "risk_level"))
    return present(*names)


def follow_up_text(level: Column) -> Column:
    return F.coalesce(_by_code(level, V.FOLLOW_UP_GUIDANCE), F.lit(V.FOLLOW_UP_GUIDANCE[1]))


def fallback_advice(level: Column) -> Column:
    """Advice list used without a rules document: one line per factor, then the level's line."""
    flags = factor_flags()
    lines = [F.when(flags[name], text) for name, text in V.FALLBACK_ADVICE.items()]
    guidance = F.coalesce(_by_code(level, V.FALLBACK_GUIDANCE), F.lit(V.FALLBACK_GUIDANCE[1]))
    return present(*lines, guidance)


# -- a fixed logistic score ---------------------------------------------------

# Weights of our own published demonstration score: log-odds per unit.
DEMO_WEIGHTS = {
    "heart": {
        "intercept": -6.5, "age": 0.05, "gender": 0.3, "bmi": 0.04, "cholesterol": 0.35, "diabetes": 0.6,
        "hypertension": 0.9, "smoker": 0.3, "alcohol": 0.15, "exercise": -0.4,
    },
    "stroke": {
        "intercept": -7.5, "age": 0.06, "gender": 0.1, "bmi": 0.03, "cholesterol": 0.25, "diabetes": 0.5,
        "hypertension": 1.2, "smoker": 0.25, "alcohol": 0.2, "exercise": -0.3,
    },
}


def demo_probability(target: str) -> Column:
    """Logistic probability on a grid of four decimals, from fixed weights."""
    weights = DEMO_WEIGHTS[target]
    terms = [f"{weights['intercept']!r}D", *[f"{weights[name]!r}D * double({name})" for name in contract.FEATURES]]
    return F.expr(f"double(floor(10000.0D / (1.0D + exp(-({' + '.join(terms)}))))) / 10000.0D")
