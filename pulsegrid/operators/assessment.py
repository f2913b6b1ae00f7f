"""One assessment from text to plan, for any number of records.

Text fields are validated; valid records are brought to their normal form, scored by the two registered models, graded,
explained by the contributions of either model and their merged factors, and given a plan from the rules. A record that is
not valid keeps its reasons and has a null result. Scores and contributions are worked out once for all records that the
trees cannot tell apart (``operators/cells.py``) and looked up; everything else is column expressions of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading
from pulsegrid.operators import advice, attribution, cells, explanation, training
from pulsegrid.session import durable

C = F.col
MODELS = {"heart": "heart_", "stroke": "stroke_"}


def _scope() -> Column:
    return F.struct(
        F.lit(V.SCOPE_TYPE).alias("type"), F.lit(V.SCOPE_LABEL).alias("label"), F.lit(V.SCOPE_DISCLAIMER).alias("disclaimer"),
        F.array(*[F.lit(name) for name in contract.FEATURES]).alias("probability_features"), F.lit(False).alias("auxiliary_indicators_affect_probability"),
    )


def validated(records: DataFrame) -> DataFrame:
    """Records with numbers beside their texts, ``missing_fields``, ``invalid_fields`` (field to reason) and ``valid``."""
    optional = [name for name in contract.OPTIONAL_RANGES if name in records.columns]
    absent = {name: F.lit(None).cast("string") for name in contract.FEATURES if name not in records.columns}
    checked = grading.with_numbers(records.withColumns(absent)).withColumns({
        "missing_fields": grading.missing_fields(), "invalid_fields": grading.invalid_fields(optional)})
    return checked.withColumn("valid", (F.size("missing_fields") == 0) & (F.size("invalid_fields") == 0))


def assess(
    records: DataFrame, key: str, models: dict[str, training.RiskModel], trees: dict[str, attribution.Trees], rules: DataFrame, knowledge_version: str,
) -> DataFrame:
    """``key``, valid, missing_fields, invalid_fields and the ``result`` struct of every record; keys are unique."""
    checked = validated(records)
    normal = grading.normal_record(checked.columns)
    numbers = [name for name in checked.columns if name.startswith("number_")]
    # stored: a filter on the verdict would otherwise read every text again for each of its checks
    checked = durable(checked.select(key, "valid", "missing_fields", "invalid_fields", *numbers), "checked")
    rows = checked.filter("valid").select(key, *[value.alias(name) for name, value in normal.items()])
    cuts = {target: attribution.tree_cuts(trees[target]) for target in MODELS}
    scored = training.with_cells(rows, models, cuts)
    for target, prefix in MODELS.items():
        scores = training.cell_scores(scored, models[target], cuts[target])
        explained = attribution.explained_cells(scores, trees[target], f"{prefix}shapley_")
        table = durable(scores.join(explained, "cell"), "assessed-cells")
        scored = cells.attach(scored, table.withColumnRenamed("cell", f"cell_{target}"), f"cell_{target}")
        scored = explanation.rank_contributions(scored, {name: C(f"{prefix}shapley_{name}") for name in contract.FEATURES}, prefix)
    scored = explanation.combine_models(scored, MODELS)
    heart, stroke = C("heart_probability"), C("stroke_probability")
    graded = advice.with_situation(scored, grading.level_code(grading.overall_probability(heart, stroke)))
    graded = graded.withColumn("final_category", grading.final_category(heart, stroke))
    planned = advice.attach(graded, advice.plan_table(rules, knowledge_version))
    level = F.struct(C("level").alias("code"), grading.level_name(C("level")).alias("name"), grading.level_color(C("level")).alias("color"))
    plan = F.struct("suggestions", "actions", "focus_summary", "follow_up", "emergency_warning")
    present = list(normal)
    result = F.struct(
        C("final_category").alias("predicted_label"), "final_category", level.alias("risk_level"),
        grading.summary_text(C("final_category"), C("level")).alias("risk_summary"), grading.highlights(present).alias("key_highlights"),
        grading.insights(present).alias("indicator_insights"), plan.alias("intervention_plan"),
        F.array(*[F.lit(name) for name in contract.FEATURES]).alias("required_fields"),
        C("heart_label").alias("heart_predicted_label"), C("stroke_label").alias("stroke_predicted_label"),
        heart.alias("heart_predicted_probability"), stroke.alias("stroke_predicted_probability"),
        grading.probability_percent(heart).alias("heart_probability_percent"), grading.probability_percent(stroke).alias("stroke_probability_percent"),
        explanation.factor_list("heart_").alias("heart_explanation"), explanation.factor_list("stroke_").alias("stroke_explanation"),
        explanation.combined_list(MODELS).alias("combined_summary"), C("knowledge_version").alias("intervention_knowledge_version"),
        F.array_distinct(F.transform("suggestions", lambda s: s["source"])).alias("intervention_sources"), _scope().alias("model_scope"),
    )
    done = planned.select(key, result.alias("result"))
    verdicts = checked.select(key, "valid", "missing_fields", "invalid_fields")
    # results come back by key: the rows of one key stay together, and keys are unique
    return verdicts.join(done, key, "left")
