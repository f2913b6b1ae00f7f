"""Quality measures of binary risk scores.

Ranking measures need running totals by descending score. Rows are first reduced
to one point per distinct score; the points are cut into slices of similar size
by score, totals are carried from slice to slice, and only the points of one
slice are sorted together.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions.numeric import count_if, round_exact
from pulsegrid.session import durable

C = F.col
SLICE_POINTS = 200_000
MAX_SLICES = 4096


def _share(part: Column, whole: Column) -> Column:
    """Ratio that is 0 for an empty denominator."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def _counted(condition: Column, rows: str | None) -> Column:
    """Rows where the condition is true; ``rows`` names a column with the number of rows that one stands for."""
    return count_if(condition) if rows is None else F.coalesce(F.sum(F.when(condition, C(rows))), F.lit(0))


def confusion(df: DataFrame, label: str, predicted: str, rows_in: str | None = None) -> DataFrame:
    """One row with the four cells and the measures that follow from them."""
    y, p = C(label), C(predicted)
    cells = df.agg(
        _counted((y == 0) & (p == 0), rows_in).alias("true_negative"),
        _counted((y == 0) & (p == 1), rows_in).alias("false_positive"),
        _counted((y == 1) & (p == 0), rows_in).alias("false_negative"),
        _counted((y == 1) & (p == 1), rows_in).alias("true_positive"),
    )
    tn, fp, fn, tp = (C(n) for n in ("true_negative", "false_positive", "false_negative", "true_positive"))
    rows = tn + fp + fn + tp
    measures = {
        "accuracy": _share(tp + tn, rows),
        "f1_score": _share(2 * tp, 2 * tp + fn + fp),
        "f2_score": _share(5 * tp, 5 * tp + 4 * fn + fp),
        "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn),
        "specificity": _share(tn, tn + fp),
    }
    plain = cells.withColumns(measures).withColumns({
        "balanced_accuracy": (C("recall") + C("specificity")) / 2,
        "positive_rate": _share(tp + fn, rows),
    })
    digits = {name: 4 for name in [*measures, "balanced_accuracy"]} | {"positive_rate": 6}
    return plain.withColumns({name: round_exact(C(name), d) for name, d in digits.items()})


def brier(df: DataFrame, label: str, probability: str, rows_in: str | None = None) -> DataFrame:
    error = C(probability) - C(label)
    square = error * error
    mean = F.avg(square) if rows_in is None else F.sum(square * C(rows_in)) / F.sum(F.when(square.isNotNull(), C(rows_in)))
    return df.agg(round_exact(mean, 4).alias("brier_score"))


def score_points(df: DataFrame, label: str, probability: str, rows_in: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score.

    The measures below read the points several times: store them first.
    """
    return (
        df.filter(C(probability).isNotNull() & C(label).isNotNull())
        .groupBy(C(probability).alias("score"))
        .agg(_counted(C(label) == 1, rows_in).alias("pos"), _counted(C(label) == 0, rows_in).alias("neg"))
    )


def _with_slice(points: DataFrame) -> DataFrame:
    """Number slices of similar size, highest scores first."""
    slices = min(math.ceil(points.count() / SLICE_POINTS), MAX_SLICES)
    if slices <= 1:
        return points.withColumn("slice", F.lit(0))
    shares = [i / slices for i in range(1, slices)]
    inner = sorted(set(points.approxQuantile("score", shares, 0.25 / slices)))
    cutter = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="score", outputCol="cell")
    return cutter.transform(points).withColumn("slice", (-C("cell")).cast("int")).drop("cell")


def running_totals(points: DataFrame) -> DataFrame:
    """Add ``tp`` and ``fp``: positives and negatives at or above each score."""
    sliced = _with_slice(points)
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "slice",
        F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    within = Window.partitionBy("slice").orderBy(C("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(F.broadcast(carried), "slice")
        .select(
            "score", "pos", "neg",
            (C("p_before") + F.sum("pos").over(within)).alias("tp"),
            (C("n_before") + F.sum("neg").over(within)).alias("fp"),
        )
    )


def ranking_measures(points: DataFrame) -> DataFrame:
    """Average precision (step form) and ROC area with half credit for ties.

    A single class leaves the ROC area undefined (null); no positives give
    average precision 0.
    """
    pos, neg, tp, fp = (C(n).cast("double") for n in ("pos", "neg", "tp", "fp"))
    sums = running_totals(points).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(pos * tp / (tp + fp)).alias("steps"),
        F.sum(neg * ((tp - pos) + 0.5 * pos)).alias("pairs"),
    )
    both = (C("positives") * C("negatives").cast("double"))
    return sums.select(
        round_exact(F.when(C("positives") > 0, C("steps") / C("positives")).otherwise(0.0), 4).alias("pr_auc"),
        round_exact(F.when(both > 0, C("pairs") / both), 4).alias("roc_auc"),
    )


def decision_threshold(points: DataFrame, minimum_recall: float = contract.STROKE_MIN_RECALL) -> DataFrame:
    """The score with the highest precision among those with enough recall.

    Of equal precisions the lowest score wins; without a candidate it is 0.5.
    """
    positives = points.agg(F.sum("pos").alias("n")).first().n or 0
    curve = running_totals(points)
    allowed = curve.filter(C("tp").cast("double") / F.nullif(F.lit(positives), F.lit(0)) >= minimum_recall)
    precision = C("tp").cast("double") / (C("tp") + C("fp")).cast("double")
    best = allowed.agg(F.max_by("score", F.struct(precision, -C("score"))).alias("found"))
    return best.select(F.coalesce("found", F.lit(0.5)).alias("threshold"))


def evaluate(df: DataFrame, label: str, predicted: str, probability: str, rows_in: str | None = None) -> DataFrame:
    """One row with every measure; ``rows_in`` names a column with the number of rows that one stands for."""
    points = durable(score_points(df, label, probability, rows_in), "score-points")
    ranking = ranking_measures(points).first()
    roc_auc = F.lit(ranking.roc_auc).cast("double")
    measured = confusion(df, label, predicted, rows_in).withColumn("pr_auc", F.lit(ranking.pr_auc))
    score = brier(df, label, probability, rows_in).first().brier_score
    return measured.withColumns({"roc_auc": roc_auc, "brier_score": F.lit(score).cast("double")})
