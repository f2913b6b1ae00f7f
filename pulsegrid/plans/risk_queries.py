"""Training, scoring, calibration, explanation, full grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.functions import fixed_values as V
from pulsegrid.functions import grading
from pulsegrid.functions.grading import DEMO_WEIGHTS
from pulsegrid.functions.numeric import round_exact
from pulsegrid.operators import advice, assessment, attribution, explanation, registry, training
from pulsegrid.plans.advice_queries import RULE_PARTS, _ACTIONS, demo_rules
from pulsegrid.plans.checks import CLEAN as CLEAN_TRAINING
from pulsegrid.plans.checks import fixed, quote, with_parts, with_residents
from pulsegrid.plans.grading_queries import CATEGORY, LEVEL, PAYLOAD, SUMMARY, VERDICT_SQL, case_text, payload
from pulsegrid.plans.model_queries import model_sizes_sql
from pulsegrid.plans.registry import query
from pulsegrid.plans.scoring_base import SCORED_PARTS, complete_residents, scored_residents
from pulsegrid.session import durable, shared_path
from pulsegrid.sources.files import file_hashes
from pulsegrid.sources.rules import DEMO_VERSION
from pulsegrid.sources.tables import residents

C = F.col
#: Folders of registered models by session, data folder and learner; the models themselves are read from there.
_REGISTERED: dict[tuple, str] = {}


def rare_stroke():
    """A stroke label of about two percent, so that oversampling has work to do."""
    return ((C("label_stroke") == 1) & (C("alcohol") == 1) & (C("diabetes") == 1)).cast("int")


def training_rows(spark, sf_dir):
    source = residents(spark, sf_dir).withColumn("label_stroke", rare_stroke())
    return cleaning.training_table(cleaning.clean(source))


def model_folder(spark, sf_dir, learner=training.BOOSTED):
    """Both models of a learner, trained, registered and activated once per session and data folder; with the run log."""
    key = (spark.sparkContext.applicationId, sf_dir, learner)
    if key not in _REGISTERED:
        root = shared_path(spark, f"models-{learner}")
        models, log = training.train_models(durable(training_rows(spark, sf_dir), "training"), learner)
        training.append_runs(spark, log, f"{root}/runs")
        registry.activate(spark, root, registry.register(spark, models, root, f"two {learner} models, isotonic calibration"))
        _REGISTERED[key] = root
    return _REGISTERED[key]


def fitted(spark, sf_dir, learner=training.BOOSTED):
    return registry.load_active(spark, model_folder(spark, sf_dir, learner))[0]


# -- models -----------------------------------------------------------------------

def _sized(models) -> list[tuple]:
    return [
        (target, m.estimator.getNumTrees, len(contract.FEATURES), int(m.metrics["test_rows"]), int(m.metrics["test_positives"]), m.added_rows,
         sum(int(m.metrics[c]) for c in ("true_negative", "false_positive", "false_negative", "true_positive")) == m.metrics["test_rows"],
         m.metrics["roc_auc"] > 0.8, 0 <= m.metrics["brier_score"] < 0.25)
        for target, m in models.items()
    ]


_SIZES = "target string, trees int, features int, test_rows long, test_positives long, added_rows long, all_tested boolean, ranks boolean, calibrated boolean"


@query("m03_forest_models", model_sizes_sql(200))
def forest_models(spark, sf_dir):
    """The two-forest strategy: one balanced forest per outcome, on held-out rows."""
    return spark.createDataFrame(_sized(fitted(spark, sf_dir, training.FOREST)), _SIZES)


@query("m03_forest_model")
def forest_model(spark, sf_dir):
    """Quality of the heart forest on held-out rows."""
    model = fitted(spark, sf_dir, training.FOREST)["heart"]
    return spark.createDataFrame([("heart", model.metrics["roc_auc"], model.metrics["pr_auc"], model.threshold)],
                                 "target string, roc_auc double, pr_auc double, threshold double")


@query("m04_boosted_sizes", model_sizes_sql(50))
def boosted_sizes(spark, sf_dir):
    return spark.createDataFrame(_sized(fitted(spark, sf_dir)), _SIZES)


@query("m04_boosted_models")
def boosted_models(spark, sf_dir):
    models = fitted(spark, sf_dir)
    rows = [(t, m.metrics["roc_auc"], m.metrics["pr_auc"], m.metrics["brier_score"], m.threshold, m.added_rows)
            for t, m in models.items()]
    return spark.createDataFrame(
        rows, "target string, roc_auc double, pr_auc double, brier_score double, threshold double, added_rows long")


# The best monotone fit at a score is the largest, over all starts at or below it,
# of the smallest mean over all ends at or above it.
_ISOTONIC = f"""
SELECT score AS stroke_probability, {fixed('max(low)', 6)} AS calibrated FROM (
  SELECT a.i AS start, b.i AS i, b.score, min((b.p - a.p0) / CAST(b.n - a.n0 AS DOUBLE)) OVER (
    PARTITION BY a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS low
  FROM prefix a JOIN prefix b ON b.i >= a.i) q
GROUP BY score"""

_PREFIX = """
prefix AS (
  SELECT stroke_probability AS score, row_number() OVER w AS i,
    CAST(sum(sum(label_stroke)) OVER w AS BIGINT) AS p, CAST(sum(count(*)) OVER w AS BIGINT) AS n,
    CAST(sum(sum(label_stroke)) OVER w - sum(label_stroke) AS BIGINT) AS p0,
    CAST(sum(count(*)) OVER w - count(*) AS BIGINT) AS n0
  FROM scored GROUP BY stroke_probability WINDOW w AS (ORDER BY stroke_probability ROWS UNBOUNDED PRECEDING)
)"""


@query("m05_isotonic_calibration", with_parts([*SCORED_PARTS, _PREFIX], _ISOTONIC))
def isotonic_calibration(spark, sf_dir):
    scored = scored_residents(spark, sf_dir).select(
        C("stroke_probability").alias("raw_probability"), "label_stroke", F.lit(1.0).alias("weight"))
    points = durable(training.calibration_points(scored, "label_stroke", "weight"), "calibration")
    fit = training.calibrated(training.fit_calibrator(points), points, "calibrated")
    return fit.select(
        C("raw_probability").alias("stroke_probability"), round_exact(C("calibrated"), 6).alias("calibrated"))


def rows_to_score(spark, sf_dir):
    """Ids and features; stored, so that making them and finding their cells are not one stage too large to be compiled."""
    return durable(training_rows(spark, sf_dir).select("resident_id", *contract.FEATURES), "rows-to-score")


@query("m06_batch_scores")
def batch_scores(spark, sf_dir):
    models = fitted(spark, sf_dir)
    return training.score_both(rows_to_score(spark, sf_dir), models).select(
        "resident_id", "heart_probability", "heart_label", "stroke_probability", "stroke_label")


@query("m07_threshold_labels", with_parts(SCORED_PARTS, """
SELECT resident_id, CAST(heart_probability >= 0.5 AS INTEGER) AS heart_label,
  CAST(stroke_probability >= 0.2 AS INTEGER) AS stroke_label FROM scored"""))
def threshold_labels(spark, sf_dir):
    return scored_residents(spark, sf_dir).select(
        "resident_id", training.predicted_label(C("heart_probability"), 0.5).alias("heart_label"),
        training.predicted_label(C("stroke_probability"), 0.2).alias("stroke_label"))


def _with_contributions(spark, sf_dir, learner, target):
    """Imputed rows with ``shapley_`` columns, and the trees they come from."""
    model = fitted(spark, sf_dir, learner)[target]
    trees = attribution.tree_arrays(spark, model.estimator, shared_path(spark, "trees"))
    filled = durable(model.imputer.transform(training_rows(spark, sf_dir)).select("resident_id", *contract.FEATURES), "filled")
    return attribution.cell_contributions(filled, trees, "shapley_"), trees, model


@query("m08_tree_contributions")
def tree_contributions(spark, sf_dir):
    """Shapley contributions of the boosted stroke model, top factors per resident."""
    explained, _, _ = _with_contributions(spark, sf_dir, training.BOOSTED, "stroke")
    ranked = explanation.rank_contributions(explained, {name: C(f"shapley_{name}") for name in contract.FEATURES})
    return explanation.factor_rows(ranked, ["resident_id"]).select(
        "resident_id", "place", "feature", "contribution", "impact_percent")


@query("m08_forest_contributions", with_residents("""
SELECT resident_id, target, 9 AS features, TRUE AS adds_up FROM residents, (VALUES ('heart'), ('stroke')) t(target)"""))
def forest_contributions(spark, sf_dir):
    """Both forests explained in full depth: on every row the contributions and the expected output add up to the forest's."""
    rows = None
    for target in training.TARGETS:
        explained, trees, model = _with_contributions(spark, sf_dir, training.FOREST, target)
        scored = training.raw_probability(model.estimator, explained)
        total = sum((C(f"shapley_{name}") for name in contract.FEATURES), F.lit(trees.expected))
        known = sum((C(f"shapley_{name}").isNotNull().cast("int") for name in contract.FEATURES), F.lit(0))
        part = scored.select("resident_id", F.lit(target).alias("target"), known.alias("features"), (F.abs(total - C("raw_probability")) < 1e-9).alias("adds_up"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("m09_feature_importance")
def feature_importance(spark, sf_dir):
    models = fitted(spark, sf_dir)
    return training.feature_importance(spark, models["heart"]).unionByName(
        training.feature_importance(spark, models["stroke"]))


@query("m09_importance_shares", """
SELECT target, feature, TRUE AS is_share, TRUE AS adds_up FROM (VALUES ('heart'), ('stroke')) t(target), (VALUES """ + ", ".join(
    f"('{name}')" for name in contract.FEATURES) + ") f(feature)")
def importance_shares(spark, sf_dir):
    """Importances of the forests are shares of one."""
    models = fitted(spark, sf_dir, training.FOREST)
    rows = training.feature_importance(spark, models["heart"]).unionByName(training.feature_importance(spark, models["stroke"]))
    sums = rows.groupBy("target").agg(F.sum("importance").alias("total"))
    return rows.join(F.broadcast(sums), "target").select(
        "target", "feature", C("importance").between(0, 1).alias("is_share"), (F.abs(C("total") - 1) < 1e-9).alias("adds_up"))


def _repeated(spark, sf_dir):
    _, log = training.train_models(
        durable(training_rows(spark, sf_dir), "training"), rounds=2, run_label="repeated")
    return training.append_runs(spark, log, shared_path(spark, "runs"))


@query("m10_repeated_rounds")
def repeated_rounds(spark, sf_dir):
    """Two rounds; the models of the last one are kept, both are logged."""
    return _repeated(spark, sf_dir).select("run_label", "round", "target", "roc_auc", "oversampled_rows")


@query("m10_best_rounds", """
SELECT target, 'repeated_round1' AS run_label, 1 AS best_round, TRUE AS is_best FROM (VALUES ('heart'), ('stroke')) t(target)""")
def best_rounds(spark, sf_dir):
    """Rounds of one seed measure alike, so the first is the best; every logged measure is at most its measure."""
    runs = _repeated(spark, sf_dir)
    best = registry.best_rounds(runs)
    most = runs.groupBy("target").agg(F.max("roc_auc").alias("most"))
    return best.join(F.broadcast(most), "target").select("target", "run_label", "best_round", (C("roc_auc") == C("most")).alias("is_best"))


@query("m11_run_log")
def run_log(spark, sf_dir):
    """Logged measures beside the registration rows of the active version."""
    root = model_folder(spark, sf_dir)
    runs = spark.read.schema(training.RUN_SCHEMA).parquet(f"{root}/runs")
    _, registered = registry.load_active(spark, root)
    return runs.join(F.broadcast(registered.select("target", "estimator", "features")), "target")


@query("m11_registration", """
SELECT target, 'GBTClassificationModel' AS estimator, 'two boosted models, isotonic calibration' AS strategy, '""" + "|".join(contract.FEATURES) + """' AS features,
  TRUE AS is_active, TRUE AS is_dated, TRUE AS hashes_match, TRUE AS threshold_in_range, TRUE AS runtime_known
FROM (VALUES ('heart'), ('stroke')) t(target)""")
def registration(spark, sf_dir):
    """The active version's manifest: feature contract, dates, runtime, and a SHA-256 of every artifact that still holds."""
    root = model_folder(spark, sf_dir)
    version = registry.active_version(spark, root)
    rows = registry.manifest(spark, root, version)
    listed = rows.select("target", F.inline("artifacts"))
    files_now = file_hashes(spark, f"{root}/versions/{version}", recursive=True)
    found = listed.join(files_now.select("path", F.col("sha256").alias("now")), F.endswith(C("path"), F.concat(F.lit("/"), C("target"), F.lit("/"), C("file"))))
    matches = found.groupBy("target").agg(F.count("*").alias("n"), F.bool_and(C("sha256") == C("now")).alias("same"))
    return rows.join(F.broadcast(matches), "target").select(
        "target", "estimator", "strategy", F.array_join("features", "|").alias("features"), (C("version") == version).alias("is_active"),
        (C("created_at") <= F.current_timestamp()).alias("is_dated"), (C("same") & (C("n") == F.size("artifacts"))).alias("hashes_match"),
        C("threshold").between(0, 1).alias("threshold_in_range"), (F.size("runtime") > 3).alias("runtime_known"))


@query("a07_chained_imputation")
def chained_imputation(spark, sf_dir):
    """Gaps filled by chained regressions, then set to legal values."""
    from pulsegrid.operators.imputation import fit_chained_imputer

    rows = durable(training_rows(spark, sf_dir), "training")
    filled = fit_chained_imputer(rows).transform(rows)
    return cleaning.legal_features(filled, keep_missing=False)


# -- explanations -------------------------------------------------------------------

_MEANS = "means AS (SELECT " + ", ".join(
    f"{fixed(f'avg({n})', 4)} AS mean_{n}" for n in contract.FEATURES) + " FROM complete)"


def _contribution_sql(target: str) -> str:
    weights = DEMO_WEIGHTS[target]
    parts = {n: f"({weights[n]!r}::DOUBLE) * (CAST({n} AS DOUBLE) - mean_{n})" for n in contract.FEATURES}
    total = " + ".join(f"abs({c})" for c in parts.values())
    rows = []
    for position, (name, c) in enumerate(parts.items()):
        if name in V.CODE_LABELS:
            label = case_text(name, V.CODE_LABELS[name])
        else:
            label = "printf('%.1f', bmi)" if name == "bmi" else f"CAST({name} AS VARCHAR)"
        rows.append(
            f"SELECT resident_id, {position} AS position, '{name}' AS feature, {quote(V.FEATURE_NAMES[name])} AS "
            f"feature_label, {label} AS value_label, {fixed(c, 6)} AS contribution, "
            f"{fixed(f'abs({c}) / ({total}) * 100', 2)} AS impact_percent FROM complete, means")
    return f"""
{target}_all AS ({" UNION ALL ".join(rows)}
), {target}_top AS (
  SELECT *, row_number() OVER (PARTITION BY resident_id, contribution > 0
    ORDER BY abs(contribution) DESC, position) AS place FROM {target}_all WHERE contribution <> 0
  QUALIFY place <= 3
)"""


_EXPLAIN_PARTS = [SCORED_PARTS[0], _MEANS, _contribution_sql("heart"), _contribution_sql("stroke")]


def explained(spark, sf_dir, targets=("heart", "stroke")):
    df = complete_residents(spark, sf_dir).select("resident_id", *contract.FEATURES)
    baseline = explanation.mean_features(df)
    for target in targets:
        df = explanation.rank_contributions(
            df, explanation.linear_contributions(DEMO_WEIGHTS[target], baseline), f"{target}_")
    return df


@query("m08_linear_contributions", with_parts(_EXPLAIN_PARTS[:3], """
SELECT resident_id, feature, contribution, impact_percent FROM heart_all"""))
def linear_contributions(spark, sf_dir):
    return explanation.contribution_rows(explained(spark, sf_dir, ["heart"]), ["resident_id"], "heart_")


@query("w02_top_factors", with_parts(_EXPLAIN_PARTS[:3], """
SELECT resident_id, CAST(place AS INTEGER) AS place, CASE WHEN contribution > 0 THEN 'increase' ELSE 'decrease' END AS
  direction, feature, feature_label, value_label, contribution, impact_percent FROM heart_top"""))
def top_factors(spark, sf_dir):
    return explanation.factor_rows(explained(spark, sf_dir, ["heart"]), ["resident_id"], "heart_")


BOTH_MODELS = {"heart": "heart_", "stroke": "stroke_"}
_MERGED = """
merged AS (
  SELECT resident_id, feature, position, sum(contribution) AS c, sum(impact_percent) AS i,
    string_agg(source, '|' ORDER BY source) AS sources
  FROM (SELECT *, 'heart' AS source FROM heart_top UNION ALL SELECT *, 'stroke' AS source FROM stroke_top) u
  GROUP BY resident_id, feature, position
)"""


@query("j04_merged_factors", with_parts([*_EXPLAIN_PARTS, _MERGED], f"""
SELECT resident_id, feature, {fixed('c', 6)} AS contribution, {fixed('i', 2)} AS impact_percent, sources FROM merged"""))
def merged_factors(spark, sf_dir):
    merged = explanation.combine_models(explained(spark, sf_dir), BOTH_MODELS)
    return explanation.merged_rows(merged, ["resident_id"], BOTH_MODELS)


@query("w03_combined_factors", with_parts([*_EXPLAIN_PARTS, _MERGED], f"""
SELECT resident_id, CAST(place AS INTEGER) AS place, CASE WHEN c > 0 THEN 'increase' ELSE 'decrease' END AS direction,
  feature, {fixed('c', 6)} AS contribution, {fixed('i', 2)} AS impact_percent, sources
FROM (SELECT *, row_number() OVER (PARTITION BY resident_id, c > 0 ORDER BY abs(c) DESC, position) AS place
  FROM merged WHERE c <> 0) q WHERE place <= 4"""))
def combined_factors(spark, sf_dir):
    merged = explanation.combine_models(explained(spark, sf_dir), BOTH_MODELS)
    return explanation.combined_rows(merged, ["resident_id"], BOTH_MODELS)


# -- everything about one record ------------------------------------------------------

@query("m12_graded_residents", with_parts([*RULE_PARTS, _ACTIONS], f"""
SELECT s.resident_id, final_category, level_code, {case_text('level_code', {c: n for c, n, _ in V.RISK_LEVELS})} AS
  level_name, risk_summary, coalesce(a.rule_ids, '{V.GENERAL_RULE}') AS rule_ids,
  {case_text('level_code', V.FOLLOW_UP_GUIDANCE)} AS follow_up
FROM (SELECT *, {SUMMARY} AS risk_summary, c AS final_category, l AS level_code FROM (
  SELECT *, {CATEGORY} AS c, {LEVEL} AS l FROM scored) z) s
LEFT JOIN (SELECT resident_id, string_agg(rule_id, '|' ORDER BY position) AS rule_ids FROM actions GROUP BY ALL) a
  ON s.resident_id = a.resident_id"""))
def graded_residents(spark, sf_dir):
    heart, stroke = C("heart_probability"), C("stroke_probability")
    graded = advice.with_situation(
        scored_residents(spark, sf_dir), grading.level_code(grading.overall_probability(heart, stroke)))
    plans = advice.plan_table(demo_rules(spark), DEMO_VERSION)
    full = advice.attach(graded, plans).withColumns({
        "final_category": grading.final_category(heart, stroke), "level_name": grading.level_name(C("level"))})
    return full.select(
        "resident_id", "final_category", C("level").alias("level_code"), "level_name",
        grading.summary_text(C("final_category"), C("level")).alias("risk_summary"),
        F.array_join(F.transform("actions", lambda a: a["rule_id"]), "|").alias("rule_ids"), "follow_up")


@query("m12_assessments", with_parts([PAYLOAD], f"""
SELECT resident_id, valid, missing_fields, invalid_fields, valid AS has_result, valid AS graded, valid AS explained, valid AS planned FROM ({VERDICT_SQL}) v"""))
def assessments(spark, sf_dir):
    """Text records assessed end to end by the registered models; what the models decide must fit together on every row."""
    models = fitted(spark, sf_dir)
    trees = {target: attribution.tree_arrays(spark, model.estimator, shared_path(spark, "trees")) for target, model in models.items()}
    records = durable(payload(spark, sf_dir), "records")
    found = assessment.assess(records, "resident_id", models, trees, demo_rules(spark), DEMO_VERSION)
    r = lambda field: C(f"result.{field}")
    heart, stroke = r("heart_predicted_probability"), r("stroke_predicted_probability")
    graded = (r("risk_level.code") == grading.level_code(F.greatest(heart, stroke))) & (r("final_category") == grading.final_category(heart, stroke)) & heart.between(0, 1) & stroke.between(0, 1)
    explained = (F.size(r("heart_explanation")) > 0) & F.forall(r("combined_summary"), lambda f: F.size(f["sources"]) > 0) & (F.size(r("key_highlights")) > 0)
    planned = (F.size(r("intervention_plan.suggestions")) > 0) & r("intervention_plan.follow_up").isNotNull() & (F.size(r("intervention_sources")) > 0)
    no = F.lit(False)
    return found.select(
        "resident_id", "valid", F.array_join("missing_fields", ";").alias("missing_fields"), F.array_join(F.map_keys("invalid_fields"), ";").alias("invalid_fields"),
        C("result").isNotNull().alias("has_result"), F.coalesce(graded, no).alias("graded"), F.coalesce(explained, no).alias("explained"), F.coalesce(planned, no).alias("planned"))


@query("m06_score_labels", with_residents("SELECT resident_id, TRUE AS in_range, TRUE AS labels_follow FROM residents"))
def score_labels(spark, sf_dir):
    """On every row both probabilities lie in [0, 1] and both labels follow from the registered thresholds."""
    models = fitted(spark, sf_dir)
    scored = training.score_both(rows_to_score(spark, sf_dir), models)
    follow = [C(f"{t}_label") == (C(f"{t}_probability") >= F.lit(m.threshold)).cast("int") for t, m in models.items()]
    return scored.select("resident_id", (C("heart_probability").between(0, 1) & C("stroke_probability").between(0, 1)).alias("in_range"), (follow[0] & follow[1]).alias("labels_follow"))


@query("a07_imputed_cells", with_parts([CLEAN_TRAINING], f"""
SELECT resident_id, TRUE AS complete, TRUE AS known_kept, {" + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in contract.FEATURES)} AS filled FROM clean"""))
def imputed_cells(spark, sf_dir):
    """Every gap is filled, every known value is kept; the numbers of filled cells per row."""
    from pulsegrid.operators.imputation import fit_chained_imputer

    rows = durable(training_rows(spark, sf_dir), "training")
    given = rows.withColumns({f"given_{n}": C(n) for n in contract.FEATURES})
    filled = fit_chained_imputer(rows).transform(given)
    complete = F.forall(F.array(*[C(n).cast("double") for n in contract.FEATURES]), lambda x: x.isNotNull() & ~F.isnan(x))
    kept = F.forall(F.array(*[F.coalesce(C(f"given_{n}").cast("double") == C(n).cast("double"), C(f"given_{n}").isNull()) for n in contract.FEATURES]), lambda x: x)
    gaps = sum((C(f"given_{n}").isNull().cast("int") for n in contract.FEATURES), F.lit(0))
    return filled.select("resident_id", complete.alias("complete"), kept.alias("known_kept"), gaps.alias("filled"))
