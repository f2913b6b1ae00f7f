"""Rule matching and advice plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading
from pulsegrid.operators import advice
from pulsegrid.plans.checks import quote, with_parts
from pulsegrid.plans.grading_queries import FACTOR_SQL, LEVEL, case_text
from pulsegrid.plans.registry import query
from pulsegrid.plans.scoring_base import SCORED_PARTS, scored_residents
from pulsegrid.sources.rules import DEMO_RULES, DEMO_VERSION, rules_frame

C = F.col


def graded_records(spark, sf_dir):
    level = grading.level_code(grading.overall_probability(C("heart_probability"), C("stroke_probability")))
    return advice.with_situation(scored_residents(spark, sf_dir), level).select("resident_id", *advice.SITUATION)


def demo_rules(spark):
    return rules_frame(spark, DEMO_RULES, DEMO_VERSION)


def _list(values) -> str:
    return "[" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _rule_row(pos: int, rule: dict) -> str:
    factors = rule.get("auto_factors") or [rule["factor"]]
    rule_class = quote(rule["rule_class"]) if "rule_class" in rule else "CAST(NULL AS VARCHAR)"
    return (
        f"({pos}, {quote(rule['rule_id'])}, {_list(factors)}, {_list(rule['risk_levels'])}, "
        f"{quote(rule.get('source', V.DEFAULT_RULE_SOURCE))}, {quote(rule.get('version', DEMO_VERSION))}, "
        f"{rule_class}, {rule.get('priority', 0)}, {rule.get('enabled', True)}, {rule.get('automation_safe', True)}, "
        f"{quote(rule.get('boundary_notes', rule.get('contraindication', '')))}, {quote(rule.get('source_doc', ''))})"
    )


_FACTOR_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END" for name, test in FACTOR_SQL.items()
) + ", CASE WHEN l >= 4 THEN 'risk_level' END], lambda x : x IS NOT NULL)"

RULE_PARTS = [*SCORED_PARTS, f"""
rules(pos, rule_id, factors, levels, source, version, rule_class, priority, enabled, safe, notes, doc) AS (
  VALUES {", ".join(_rule_row(pos, rule) for pos, rule in enumerate(DEMO_RULES))}
), graded AS (
  SELECT resident_id, l, {_FACTOR_LIST} AS active FROM (SELECT *, {LEVEL} AS l FROM scored) q
), hits AS (
  SELECT resident_id, l, r.*, list_sort(list_filter(active, lambda x : list_contains(factors, x))) AS matched,
    row_number() OVER (PARTITION BY resident_id, rule_id ORDER BY pos) AS nth
  FROM graded g JOIN rules r ON enabled AND safe AND list_has_any(active, factors) AND list_contains(levels, l)
), matches AS (SELECT * FROM hits WHERE nth = 1)""", """
best AS (
  SELECT resident_id, factor, rule_id, source, version, notes, doc FROM (
    SELECT *, row_number() OVER (PARTITION BY resident_id, factor ORDER BY priority DESC, pos) AS n FROM (
      SELECT resident_id, rule_id, source, version, priority, pos, notes, doc, unnest(matched) AS factor FROM matches
      WHERE rule_class IS DISTINCT FROM 'follow_up') u
    WHERE factor <> 'risk_level') v
  WHERE n = 1
)"""]


@query("j01_matching_rules", with_parts(RULE_PARTS, """
SELECT resident_id, rule_id, CAST(pos AS INTEGER) AS pos, array_to_string(matched, '|') AS matched_factors,
  CAST(priority AS INTEGER) AS priority, source, version FROM matches"""))
def matching_rules(spark, sf_dir):
    found = advice.attach_matches(graded_records(spark, sf_dir), advice.matching_rules(demo_rules(spark)), ["resident_id"])
    return found.select(
        "resident_id", "rule_id", "pos", F.array_join("matched_factors", "|").alias("matched_factors"), "priority",
        "source", "version")


@query("u03_factor_sets", with_parts(RULE_PARTS[:2] + [RULE_PARTS[2]], """
SELECT resident_id, array_to_string(list_filter(active, lambda x : list_contains(['diabetes', 'cholesterol', 'hypertension'], x)), '|') AS metabolic,
  array_to_string(list_filter(active, lambda x : x <> 'risk_level'), '|') AS personal FROM graded"""))
def factor_sets(spark, sf_dir):
    """Set intersection and difference within a record."""
    level = grading.level_code(grading.overall_probability(C("heart_probability"), C("stroke_probability")))
    active = grading.active_factors(level)
    metabolic = F.array(*[F.lit(name) for name in ("diabetes", "cholesterol", "hypertension")])
    return scored_residents(spark, sf_dir).select(
        "resident_id",
        F.array_join(F.array_intersect(active, metabolic), "|").alias("metabolic"),
        F.array_join(F.array_except(active, F.array(F.lit("risk_level"))), "|").alias("personal"),
    )


@query("w04_first_rule_per_id", with_parts(RULE_PARTS, """
SELECT rule_id, CAST(pos AS INTEGER) AS pos, count(*) AS residents FROM matches GROUP BY rule_id, pos"""))
def first_rule_per_id(spark, sf_dir):
    """How many residents each rule reaches, after duplicates of an id are dropped."""
    found = advice.attach_matches(graded_records(spark, sf_dir), advice.matching_rules(demo_rules(spark)), ["resident_id"])
    return found.groupBy("rule_id", "pos").agg(F.count(F.lit(1)).alias("residents"))


@query("w05_best_rule_per_factor", with_parts(RULE_PARTS, "SELECT resident_id, factor, rule_id, source, version FROM best"))
def best_rule_per_factor(spark, sf_dir):
    best = advice.best_by_factor(advice.matching_rules(demo_rules(spark)))
    found = advice.attach(graded_records(spark, sf_dir), best.select(*advice.SITUATION, "best"))
    return found.select("resident_id", F.inline("best")).select("resident_id", "factor", "rule.rule_id", "rule.source", "rule.version")


_ACTIONS = f"""
wanted AS (SELECT resident_id, l, unnest(list_filter(active, lambda x : x <> 'risk_level')) AS factor FROM graded
), ranked AS (
  SELECT w.resident_id, w.factor, coalesce(b.rule_id, '{V.BMI_DEFAULT_RULE}') AS rule_id,
    coalesce(b.source, '{V.BMI_DEFAULT_SOURCE}') AS source, coalesce(b.version, '{DEMO_VERSION}') AS version, b.notes, b.doc,
    row_number() OVER (PARTITION BY w.resident_id ORDER BY {case_text('w.factor', {f"'{n}'": str(p).zfill(3) for n, p in V.FACTOR_PRIORITY.items()})} DESC) AS position
  FROM wanted w LEFT JOIN best b ON w.resident_id = b.resident_id AND w.factor = b.factor
  WHERE b.rule_id IS NOT NULL OR w.factor = 'bmi'
), actions AS (SELECT * FROM ranked WHERE position <= 3)"""


def _texts(value: str, texts: dict) -> str:
    return case_text(value, {f"'{name}'": text for name, text in texts.items()})


@query("w06_action_plan", with_parts([*RULE_PARTS, _ACTIONS], f"""
SELECT g.resident_id, coalesce(f.rule_id, '') AS follow_up_rule,
  coalesce(f.rule_id || '|', '') || coalesce(a.rule_ids, '{V.GENERAL_RULE}') AS suggestions,
  CASE WHEN f.rule_id IS NULL THEN '' ELSE {case_text('l', V.FOLLOW_UP_GUIDANCE)} || '|' END || coalesce(a.texts, {quote(V.GENERAL_TEXT)}) AS suggestion_texts,
  CASE WHEN f.rule_id IS NULL THEN '' ELSE f.notes || ';' || f.doc || '|' END || coalesce(a.evidence, ';') AS provenance,
  coalesce(a.rule_ids, '{V.GENERAL_RULE}') AS rule_ids, coalesce(a.texts, {quote(V.GENERAL_TEXT)}) AS texts,
  coalesce(a.sources, {quote(V.GENERAL_SOURCE)}) AS sources,
  CASE WHEN a.focus IS NULL THEN {quote(V.FOCUS_NONE)}
       ELSE {quote(V.FOCUS_PREFIX)} || a.focus || {quote(V.FOCUS_SUFFIX)} END AS focus_summary,
  {case_text('l', V.FOLLOW_UP_GUIDANCE)} AS follow_up
FROM graded g LEFT JOIN (
  SELECT resident_id, string_agg(rule_id, '|' ORDER BY position) AS rule_ids,
    string_agg({_texts('factor', V.FACTOR_ACTIONS)}, '|' ORDER BY position) AS texts,
    string_agg(source, '|' ORDER BY position) AS sources, string_agg(coalesce(notes, '') || ';' || coalesce(doc, ''), '|' ORDER BY position) AS evidence,
    string_agg({_texts('factor', V.FACTOR_SHORT_NAMES)}, '{V.FOCUS_SEPARATOR}' ORDER BY position) AS focus
  FROM actions GROUP BY resident_id) a ON g.resident_id = a.resident_id
LEFT JOIN (SELECT resident_id, rule_id, notes, doc FROM matches WHERE rule_class = 'follow_up' QUALIFY row_number() OVER (PARTITION BY resident_id ORDER BY priority DESC, pos) = 1) f
  ON g.resident_id = f.resident_id"""))
def action_plan(spark, sf_dir):
    plans = advice.plan_table(demo_rules(spark), DEMO_VERSION)
    found = advice.attach(graded_records(spark, sf_dir), plans)

    def joined(field, items="actions"):
        return F.array_join(F.transform(items, lambda a: a[field]), "|")

    evidence = F.transform("suggestions", lambda s: F.concat(F.coalesce(s["boundary_notes"], F.lit("")), F.lit(";"), F.coalesce(s["source_doc"], F.lit(""))))

    return found.select(
        "resident_id", F.coalesce("follow_up_rule", F.lit("")).alias("follow_up_rule"),
        joined("rule_id").alias("rule_ids"), joined("text").alias("texts"), joined("source").alias("sources"),
        "focus_summary", "follow_up", joined("rule_id", "suggestions").alias("suggestions"),
        joined("text", "suggestions").alias("suggestion_texts"), F.array_join(evidence, "|").alias("provenance"),
    )
