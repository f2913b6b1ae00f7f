"""Two calibrated risk models: split, impute, oversample, fit, calibrate, choose a threshold, evaluate."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import contract
from pulsegrid.operators import attribution, cells, evaluation, splitting
from pulsegrid.operators.imputation import ChainedImputer, fit_chained_imputer
from pulsegrid.session import durable, shared_path

C = F.col
TARGETS = {"heart": "label_heart", "stroke": "label_stroke"}
FOREST, BOOSTED = "forest", "boosted"
FOREST_DEPTH = 10
FOREST_LEAF_ROWS = 5
BOOST_ROUNDS = 50
BOOST_DEPTH = 4
BOOST_STEP = 0.2
DEFAULT_THRESHOLD = 0.5
# The calibrator is fitted on scores to six decimals, so its table never exceeds 10^6 + 1 rows; scored rows keep theirs whole.
CALIBRATION_DIGITS = 6
FITS_AT_ONCE = 4


@dataclass
class RiskModel:
    """A fitted model of one outcome."""

    target: str
    imputer: ChainedImputer
    estimator: object
    calibrator: IsotonicRegressionModel
    threshold: float
    added_rows: int = 0
    metrics: dict | None = None


def new_estimator(learner: str, label: str, trees: int | None = None):
    shared = {"featuresCol": "features", "labelCol": label, "weightCol": "fit_weight", "seed": contract.SEED}
    if learner == FOREST:
        return RandomForestClassifier(
            numTrees=trees or contract.FOREST_TREES, maxDepth=FOREST_DEPTH, minInstancesPerNode=FOREST_LEAF_ROWS,
            featureSubsetStrategy="sqrt", **shared)
    return GBTClassifier(maxIter=trees or BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, **shared)


def class_weight(df: DataFrame, label: str) -> Column:
    """Weight that gives both classes the same total."""
    counts = splitting.label_counts(df, label)
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, rows in counts.items():
        weight = F.when(C(label) == value, total / (len(counts) * rows)).otherwise(weight)
    return weight


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=contract.FEATURES, outputCol="features").transform(df)


def fit_estimator(estimator, rows: DataFrame, label: str):
    """Fit the trees on the cells of the rows, whose number does not grow with the table."""
    cuts = cells.candidate_cuts(rows)
    return _fit_cells(estimator, cells.cells(rows, cuts, label), cuts, label)


def _fit_cells(estimator, found: DataFrame, cuts: list[list[float]], label: str):
    return cells.fit_forest(estimator, found, cuts, label) if isinstance(estimator, RandomForestClassifier) else cells.fit_boosted(estimator, found, cuts)


def raw_probability(estimator, df: DataFrame) -> DataFrame:
    """Add ``raw_probability`` of the positive class."""
    scored = estimator.transform(assemble(df))
    return scored.withColumn("raw_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def calibration_points(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Weighted mean label at each raw probability, to CALIBRATION_DIGITS; this holds all that isotonic regression uses."""
    return df.groupBy(F.round("raw_probability", CALIBRATION_DIGITS).alias("raw_probability")).agg(
        F.sum(weight).alias("weight"),
        (F.sum(C(weight) * C(label)) / F.sum(weight)).alias("mean_label"),
    )


def fit_calibrator(points: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(
        featuresCol="raw_probability", labelCol="mean_label", weightCol="weight", predictionCol="calibrated",
    ).fit(points)


def calibrated(model_calibrator: IsotonicRegressionModel, df: DataFrame, output: str) -> DataFrame:
    """Monotone probabilities; values outside the fitted range take the nearest end."""
    return model_calibrator.transform(df).withColumnRenamed("calibrated", output)


def predicted_label(probability: Column, threshold: float) -> Column:
    return (probability >= F.lit(float(threshold))).cast("int")


@dataclass
class Prepared:
    """What every fit of one outcome starts from, bounded by the bins: all rounds share it."""

    target: str
    learner: str
    imputer: ChainedImputer
    cuts: list[list[float]]
    fit: DataFrame  # cells of the fit part
    held: DataFrame  # cells of the calibration and test parts
    sizes: dict


def prepare(df: DataFrame, target: str, learner: str = BOOSTED, key: str = "resident_id") -> Prepared:
    """Split, oversample and impute a training table, and count its cells.

    Only the fit part is oversampled and only it is seen by the imputer; the
    calibration and test parts keep their natural rates.
    """
    label = TARGETS[target]
    needed = df.select(key, *contract.FEATURES, label, "sample_weight")
    parted = durable(splitting.stratified_split(needed, label, key).drop("split_key"), f"split-{target}")
    fit = parted.filter(C("split") == "fit")
    added = 0
    if target == "stroke":
        fit, added = splitting.oversample(fit.withColumn("split_key", splitting.hash_key(key, contract.SEED)), label)
    fit = durable(fit.select(*contract.FEATURES, label, "sample_weight"), f"fit-{target}")
    imputer = fit_chained_imputer(fit)
    weight = C("sample_weight") * (class_weight(fit, label) if learner == FOREST else F.lit(1.0))
    rows = imputer.transform(fit).withColumn("fit_weight", weight)
    rows = durable(rows.select(*contract.FEATURES, label, "fit_weight"), f"rows-{target}")
    cuts = cells.candidate_cuts(rows)
    found = cells.cells(rows, cuts, label)
    held = imputer.transform(parted.filter(C("split") != "fit").select("split", label, "sample_weight", *contract.FEATURES))
    held = cells.numbered(held, cuts, "cell").groupBy("cell", "split", label, "sample_weight").agg(F.count(F.lit(1)).alias("rows"))
    held = durable(held, f"held-{target}")
    rate = found.agg(F.sum(C(label) * C("rows")).alias("positives"), F.sum("rows").alias("rows")).first()
    test = held.filter(C("split") == "test").agg(F.sum("rows").alias("rows"), F.sum(C(label) * C("rows")).alias("positives")).first()
    return Prepared(target, learner, imputer, cuts, found, held, {
        "added": added, "rate": rate.positives / rate.rows, "test_rows": test.rows or 0, "test_positives": test.positives or 0})


def fit_prepared(prepared: Prepared, trees: int | None = None) -> RiskModel:
    """Fit, calibrate and evaluate one model; held-out rows are scored once for all of a cell."""
    target, label, sizes = prepared.target, TARGETS[prepared.target], prepared.sizes
    estimator = _fit_cells(new_estimator(prepared.learner, label, trees), prepared.fit, prepared.cuts, label)
    held = cells.with_values(attribution.spread(prepared.held), prepared.cuts, "cell").withColumn("weight", C("sample_weight") * C("rows"))
    scored = durable(
        raw_probability(estimator, held).select("split", label, "weight", "rows", "raw_probability"), f"scored-{target}")
    calibrator = fit_calibrator(calibration_points(scored.filter(C("split") == "calibrate"), label, "weight"))
    scored = calibrated(calibrator, scored, "probability")

    threshold = DEFAULT_THRESHOLD
    if target == "stroke":
        points = durable(
            evaluation.score_points(scored.filter(C("split") == "calibrate"), label, "probability", "rows"), "points")
        threshold = evaluation.decision_threshold(points).first().threshold
    model = RiskModel(target, prepared.imputer, estimator, calibrator, float(threshold), sizes["added"])
    test = scored.filter(C("split") == "test").withColumn(
        "predicted", predicted_label(C("probability"), model.threshold))
    measures = evaluation.evaluate(test, label, "predicted", "probability", "rows").first().asDict()
    model.metrics = {
        **measures, "decision_threshold": round(model.threshold, 6), "train_positive_rate": round(sizes["rate"], 6),
        "test_positive_rate": measures["positive_rate"], "oversampled_rows": sizes["added"],
        "test_rows": sizes["test_rows"], "test_positives": sizes["test_positives"],
    }
    return model


def train_target(
    df: DataFrame, target: str, learner: str = BOOSTED, key: str = "resident_id", trees: int | None = None,
) -> RiskModel:
    """Fit one outcome on a training table."""
    return fit_prepared(prepare(df, target, learner, key), trees)


def train_models(
    df: DataFrame, learner: str = BOOSTED, rounds: int = 1, run_label: str = "run", trees: int | None = None,
) -> tuple[dict[str, RiskModel], list[dict]]:
    """Train both outcomes; with several rounds the last one is kept, and every round is logged.

    Rows are read once for all rounds. Fits are many short jobs, so a few run side by side.
    """
    if rounds <= 0:
        raise ValueError("rounds must be greater than 0")
    runs = [(number, target) for number in range(1, rounds + 1) for target in TARGETS]
    threaded = inheritable_thread_target(df.sparkSession)
    with ThreadPool(min(len(runs), FITS_AT_ONCE)) as pool:
        prepared = dict(zip(TARGETS, pool.map(threaded(lambda target: prepare(df, target, learner)), TARGETS, chunksize=1), strict=True))
        trained = pool.map(threaded(lambda run: fit_prepared(prepared[run[1]], trees)), runs, chunksize=1)
    models = {target: model for (_, target), model in zip(runs, trained, strict=True)}
    log = [
        {"run_label": f"{run_label}_round{number}" if rounds > 1 else run_label, "round": number, "target": target, "learner": learner, **model.metrics}
        for (number, target), model in zip(runs, trained, strict=True)]
    return models, log


def model_cuts(spark: SparkSession, estimator) -> list[list[float]]:
    """The cuts of every feature in fitted trees, from their saved table of nodes."""
    path = shared_path(spark, "nodes")
    estimator.write().save(path)
    split = C("nodeData")["split"]
    found = spark.read.parquet(f"{path}/data").filter(split["featureIndex"] >= 0).select(
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("cut")).distinct().collect()
    return [sorted(row.cut for row in found if row.feature == f) for f in range(len(contract.FEATURES))]


def with_cells(df: DataFrame, models: dict[str, RiskModel], cuts: dict[str, list[list[float]]]) -> DataFrame:
    """Rows with ``cell_{target}``, the number of the cell in which a model's trees see them; stored. Features stay as given."""
    kept = {name: f"given_{name}" for name in contract.FEATURES}
    found = df.withColumns({alias: C(name) for name, alias in kept.items()})
    for target, model in models.items():
        found = cells.numbered(model.imputer.transform(found), cuts[target], f"cell_{target}").withColumns(
            {name: C(alias) for name, alias in kept.items()})
    return durable(found.drop(*kept.values()), "cells-of-rows")


def cell_scores(rows: DataFrame, model: RiskModel, cuts: list[list[float]]) -> DataFrame:
    """``cell``, probability and label of every cell of the rows; stored."""
    name = f"{model.target}_probability"
    known = durable(rows.select(C(f"cell_{model.target}").alias("cell")).distinct(), "cells")
    scored = raw_probability(model.estimator, cells.with_values(attribution.spread(known), cuts, "cell"))
    scored = calibrated(model.calibrator, scored, name).withColumn(f"{model.target}_label", predicted_label(C(name), model.threshold))
    return durable(scored.select("cell", name, f"{model.target}_label"), "cell-scores")


def score_target(df: DataFrame, model: RiskModel) -> DataFrame:
    """Add probability and label of one outcome, row by row; the feature columns stay as given."""
    kept = {name: f"given_{name}" for name in contract.FEATURES}
    given = df.withColumns({alias: C(name) for name, alias in kept.items()})
    scored = raw_probability(model.estimator, model.imputer.transform(given))
    name = f"{model.target}_probability"
    scored = calibrated(model.calibrator, scored, name)
    back = {feature: C(alias) for feature, alias in kept.items()}
    return (
        scored.withColumns(back).drop(*kept.values(), "raw_probability")
        .withColumn(f"{model.target}_label", predicted_label(C(name), model.threshold))
        .select(*df.columns, name, f"{model.target}_label")
    )


def score_both(df: DataFrame, models: dict[str, RiskModel]) -> DataFrame:
    """Two probabilities and two labels per row, for any number of rows; worked out once for the rows of a cell."""
    cuts = {target: model_cuts(df.sparkSession, models[target].estimator) for target in TARGETS}
    if not all(map(cells.countable, cuts.values())):
        for target in TARGETS:
            df = score_target(df, models[target])
        return df
    scored = with_cells(df, {target: models[target] for target in TARGETS}, cuts)
    added = []
    for target in TARGETS:
        table = cell_scores(scored, models[target], cuts[target])
        scored = cells.attach(scored, table.withColumnRenamed("cell", f"cell_{target}"), f"cell_{target}")
        added += table.columns[1:]
    return scored.select(*df.columns, *added)


def feature_importance(spark: SparkSession, model: RiskModel) -> DataFrame:
    values = model.estimator.featureImportances.toArray()
    rows = [(model.target, name, float(value)) for name, value in zip(contract.FEATURES, values, strict=True)]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


RUN_SCHEMA = T.StructType([
    T.StructField("run_label", T.StringType()), T.StructField("round", T.IntegerType()),
    T.StructField("target", T.StringType()), T.StructField("learner", T.StringType()),
    *[T.StructField(name, T.DoubleType()) for name in (
        "accuracy", "f1_score", "f2_score", "precision", "recall", "specificity", "balanced_accuracy",
        "positive_rate", "pr_auc", "brier_score", "roc_auc", "decision_threshold", "train_positive_rate",
        "test_positive_rate")],
    *[T.StructField(name, T.LongType()) for name in (
        "true_negative", "false_positive", "false_negative", "true_positive", "oversampled_rows")],
])


def append_runs(spark: SparkSession, log: list[dict], path: str) -> DataFrame:
    """Append one row per trained model to the run log and return the log."""
    names = [field.name for field in RUN_SCHEMA.fields]
    rows = [tuple(entry[name] for name in names) for entry in log]
    spark.createDataFrame(rows, RUN_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Artifacts of one outcome in a folder that must be new."""
    model.estimator.write().save(f"{path}/estimator")
    model.calibrator.write().save(f"{path}/calibrator")
    model.imputer.table(spark).write.mode("errorifexists").parquet(f"{path}/imputer")


def load_model(
    spark: SparkSession, path: str, target: str, estimator: str, threshold: float, added_rows: int = 0, metrics: dict | None = None,
) -> RiskModel:
    loaders = {
        "GBTClassificationModel": GBTClassificationModel,
        "RandomForestClassificationModel": RandomForestClassificationModel,
    }
    size = len(contract.FEATURES) + 1
    maps = np.zeros((1 << (size - 1), size, size))
    maps[:, 0, 0] = 1.0
    for entry in spark.read.parquet(f"{path}/imputer").collect():
        maps[entry.mask, 1:] = np.array(entry.lines)
    return RiskModel(
        target, ChainedImputer(list(contract.FEATURES), maps, 0), loaders[estimator].load(f"{path}/estimator"),
        IsotonicRegressionModel.load(f"{path}/calibrator"), threshold, added_rows, metrics)
