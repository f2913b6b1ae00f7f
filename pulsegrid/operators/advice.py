"""Rule-based advice, matched once per situation.

A plan depends on a record only through its seven factor flags and its level:
at most 2^7 x 5 = 640 situations. A situation is one row that holds its matching
rules, the best rule of each factor and its plan as arrays, worked out by array
functions from the one list of rules. Every record looks its row up and unfolds
what it needs, so nothing above the record's own source is shuffled, stored or
counted, and the looked-up table is broadcast with a proven number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading

C = F.col
FACTORS = ["hypertension", "cholesterol", "diabetes", "smoker", "alcohol", "exercise", "bmi"]
LEVELS = 5
SITUATION = ["factor_mask", "level"]
FOLLOW_UP = "follow_up"
RISK_LEVEL = "risk_level"


def factor_mask() -> Column:
    """The seven factor flags of a record as one small integer."""
    flags = grading.factor_flags()
    total = F.lit(0)
    for position, name in enumerate(FACTORS):
        total = total + flags[name].cast("int") * (1 << position)
    return total


def situations(spark: SparkSession) -> DataFrame:
    """All 640 pairs of factor flags and level with the names of the active factors.

    So few rows are kept in one partition, which spares the ranking its shuffles.
    """
    both = spark.range(0, LEVELS << len(FACTORS), 1, 1).select(
        F.expr(f"CAST(id div {LEVELS} AS INT)").alias("factor_mask"),
        (C("id") % LEVELS + 1).cast("int").alias("level"),
    )
    names = [
        F.when(C("factor_mask").bitwiseAND(F.lit(1 << position)) > 0, name) for position, name in enumerate(FACTORS)]
    names.append(F.when(C("level") >= 4, RISK_LEVEL))
    return both.withColumn("active", F.array_compact(F.array(*names)))


def usable_rules(rules: DataFrame) -> DataFrame:
    """Enabled and automation-safe rules with defaults filled in."""
    named = F.when(F.size("auto_factors") > 0, C("auto_factors")).otherwise(F.array("factor"))
    return (
        rules.filter(F.coalesce("enabled", F.lit(True)) & F.coalesce("automation_safe", F.lit(True)))
        .filter(F.coalesce(F.length("rule_id"), F.lit(0)) > 0)
        .withColumns({
            "factors": named,
            "priority": F.coalesce("priority", F.lit(0)),
            "source": F.coalesce("source", F.lit(V.DEFAULT_RULE_SOURCE)),
            "version": F.coalesce("version", "document_version", F.lit("unknown")),
            "review_mode": F.coalesce("review_mode", F.lit("auto")),
            "boundary_notes": F.coalesce("boundary_notes", "contraindication", F.lit("")),
            "text": F.coalesce("advice", F.lit("")),
        })
    )


#: What a suggestion carries of its rule, besides its text and domain.
PROVENANCE = [
    "rule_id", "source", "version", "rule_class", "priority", "review_mode", "target_population", "boundary_notes",
    "source_doc", "source_section", "evidence_level",
]
_RULE = ["pos", "factors", "risk_levels", "text", "domain", *PROVENANCE]


def rule_list(rules: DataFrame) -> DataFrame:
    """One row with all usable rules in document order; a rules document is itself read as one row."""
    return usable_rules(rules).agg(F.sort_array(F.collect_list(F.struct(*_RULE))).alias("rules"))


def matching_rules(rules: DataFrame) -> DataFrame:
    """One row per situation: ``matches``, the rules that apply, with the factors they share with it.

    Of rules sharing an id the first in the document stays.
    """
    listed = situations(rules.sparkSession).crossJoin(F.broadcast(rule_list(rules)))  # one row on that side
    applies = lambda r: F.coalesce(F.arrays_overlap(C("active"), r["factors"]), F.lit(False)) & F.coalesce(
        F.array_contains(r["risk_levels"], C("level")), F.lit(False))
    found = listed.select(*SITUATION, "active", F.filter("rules", applies).alias("found"))
    ids = found.withColumn("ids", F.transform("found", lambda r: r["rule_id"]))
    first = F.filter("found", lambda r, k: F.array_position("ids", r["rule_id"]) == k + 1)
    match = lambda r: F.struct(
        *[r[name].alias(name) for name in _RULE if name not in ("factors", "risk_levels")],
        F.sort_array(F.array_intersect(r["factors"], C("active"))).alias("matched_factors"))
    return ids.select(*SITUATION, "active", F.transform(first, match).alias("matches"))


def _best(matches: Column) -> Column:
    """The rule of the highest priority, of equal ones the first in the document; null of none."""
    return F.array_max(F.transform(matches, lambda r: F.struct(r["priority"].alias("priority"), (-r["pos"]).alias("order"), r.alias("rule"))))["rule"]


def _about(factor: str) -> Callable[[Column], Column]:
    return lambda rule: F.array_contains(rule["matched_factors"], factor)


def best_by_factor(matches: DataFrame) -> DataFrame:
    """Add ``best``: for each active factor with an action rule, the best one."""
    acts = F.filter("matches", lambda r: F.coalesce(r["rule_class"], F.lit("")) != FOLLOW_UP)
    found = matches.withColumn("acts", acts).withColumns({f"best_{name}": _best(F.filter("acts", _about(name))) for name in FACTORS})
    each = [F.when(C(f"best_{name}").isNotNull(), F.struct(F.lit(name).alias("factor"), C(f"best_{name}").alias("rule"))) for name in FACTORS]
    return found.withColumn("best", F.array_compact(F.array(*each))).drop("acts")


def _literal_map(values: dict) -> Column:
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def _suggestion(rule: Column | None, text: Column, domain: Column, **fallback: str) -> Column:
    """Text and domain with what the rule carries; without a rule only id, source and version are known."""
    types = {"priority": "int"}
    carried = []
    for name in PROVENANCE:
        value = rule[name] if rule is not None else F.lit(None).cast(types.get(name, "string"))
        carried.append((F.coalesce(value, F.lit(fallback[name])) if name in fallback else value).alias(name))
    shared = rule["matched_factors"] if rule is not None else F.lit(None).cast("array<string>")
    return F.struct(domain.alias("domain"), text.alias("text"), F.lit(True).alias("automation_safe"), *carried, shared.alias("matched_factors"))


def plan_table(rules: DataFrame, version: str) -> DataFrame:
    """One row per situation: follow-up rule, actions, suggestions, focus sentence, guidance, warning.

    At most three actions by fixed factor priority; a factor without a rule is skipped, except body weight, which has a
    default. Suggestions are the follow-up rule, with the level's guidance as its text, and then the actions.
    """
    found = best_by_factor(matching_rules(rules)).withColumns({
        "follow": _best(F.filter("matches", lambda r: F.coalesce(r["rule_class"], F.lit("")) == FOLLOW_UP)),
        "follow_up": grading.follow_up_text(C("level")),
    })
    ranked = sorted(FACTORS, key=lambda name: -V.FACTOR_PRIORITY[name])
    actions = []
    for name in ranked:
        rule, known = C(f"best_{name}"), F.array_contains("active", name)
        if name == "bmi":
            action = _suggestion(rule, F.lit(V.FACTOR_ACTIONS[name]), F.lit(name),
                                 rule_id=V.BMI_DEFAULT_RULE, source=V.BMI_DEFAULT_SOURCE, version=version)
            actions.append(F.when(known, action))
        else:
            actions.append(F.when(known & rule.isNotNull(), _suggestion(rule, F.lit(V.FACTOR_ACTIONS[name]), F.lit(name))))
    general = _suggestion(None, F.lit(V.GENERAL_TEXT), F.lit("general"), rule_id=V.GENERAL_RULE, source=V.GENERAL_SOURCE, version=version)
    follow = F.when(C("follow").isNotNull(), F.array(_suggestion(C("follow"), C("follow_up"), C("follow.domain"))))
    short = _literal_map(V.FACTOR_SHORT_NAMES)
    focus = F.transform("chosen", lambda a: F.element_at(short, a["domain"]))
    planned = found.withColumn("chosen", F.slice(F.array_compact(F.array(*actions)), 1, V.MAX_ACTIONS)).withColumns({
        "actions": F.when(F.size("chosen") > 0, C("chosen")).otherwise(F.array(general)),
        "focus_summary": F.when(F.size("chosen") > 0, F.concat(
            F.lit(V.FOCUS_PREFIX), F.array_join(focus, V.FOCUS_SEPARATOR), F.lit(V.FOCUS_SUFFIX))).otherwise(V.FOCUS_NONE),
    })
    return planned.select(
        *SITUATION, C("follow.rule_id").alias("follow_up_rule"), "actions",
        F.when(follow.isNull(), C("actions")).otherwise(F.concat(follow, C("actions"))).alias("suggestions"), "focus_summary", "follow_up",
        F.lit(V.EMERGENCY_WARNING).alias("emergency_warning"), F.lit(version).alias("knowledge_version"),
    )


def with_situation(df: DataFrame, level: Column) -> DataFrame:
    """Add flags and level; an unknown level counts as the lowest.

    Neither column can be null, so the lookup join adds no null filter. Such a
    filter would be pushed below the score and compute it a second time.
    """
    return df.withColumns({"factor_mask": factor_mask(), "level": F.coalesce(level, F.lit(1))})


def attach(df: DataFrame, by_situation: DataFrame) -> DataFrame:
    """Look up every record's situation; the table has at most 640 rows."""
    return df.join(F.broadcast(by_situation), SITUATION, "left")


def attach_matches(df: DataFrame, matches: DataFrame, keep: list[str]) -> DataFrame:
    """All matching rules of every record, one row each."""
    return attach(df.select(*keep, *SITUATION), matches.select(*SITUATION, "matches")).select(*keep, F.inline("matches"))
