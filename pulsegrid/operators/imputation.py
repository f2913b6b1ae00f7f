"""Chained-equation imputation fitted from one pass of sufficient statistics.

Every imputed value is a linear function of the row's known values, and the
function depends only on which values are missing: at most 2^9 patterns. So the
rounds of regressions need no further passes. One aggregation yields, for each
pattern, the sums and the sums of products of the known values (55 numbers), and
the fits run on those small tables. A second aggregation over the rows with
gaps measures how far each round still moved, which decides the last round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import contract
from pulsegrid.functions.numeric import add_all

C = F.col
MAX_ROUNDS = 10
TOLERANCE = 1e-3
PRIOR = 1e-6
RIDGE_STEPS = 300
RIDGE_TOLERANCE = 1e-3
# Typical values, taken off before sums of products are formed to keep digits.
ORIGIN = {"age": 57.0, "bmi": 25.0}


def _shifted(name: str) -> Column:
    return C(name).cast("double") - F.lit(ORIGIN.get(name, 0.0))


def missing_mask(names: list[str]) -> Column:
    """Which values are missing, one bit per column."""
    return add_all([C(name).isNull().cast("int") * (1 << k) for k, name in enumerate(names)])


def pattern_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """Count, sums and sums of products of the known values for each missing pattern."""
    known = [F.coalesce(_shifted(name), F.lit(0.0)) for name in names]
    vector = [F.lit(1.0), *known]
    aggregates = [
        F.sum(vector[i] * vector[j]).alias(f"s_{i}_{j}") for i in range(len(vector)) for j in range(i, len(vector))]
    largest = [F.max(F.abs(C(name).cast("double"))).alias(f"m_{k}") for k, name in enumerate(names)]
    return df.groupBy(missing_mask(names).alias("mask")).agg(*aggregates, *largest)


def _ridge(gram: np.ndarray, column: int) -> np.ndarray:
    """Regression of one column on the others from the moment matrix, ridge strength by evidence.

    ``gram`` is the moment matrix of (1, x1 … xn). Returns coefficients in the
    same layout: intercept first, 0 at the column itself.
    """
    size = gram.shape[0]
    others = [k for k in range(1, size) if k != column]
    rows = gram[0, 0]
    mean = gram[0] / rows
    centred = gram - rows * np.outer(mean, mean)
    xx, xy, yy = centred[np.ix_(others, others)], centred[others, column], centred[column, column]
    values, vectors = np.linalg.eigh(xx)
    values = np.clip(values, 0.0, None)
    turned = vectors.T @ xy

    def solve(noise: float, strength: float) -> tuple[np.ndarray, float]:
        weights = vectors @ (turned / (values + strength / noise))
        return weights, max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)

    noise, strength = 1.0 / (max(yy, 0.0) / rows + np.finfo(float).eps), 1.0
    previous = None
    for _ in range(RIDGE_STEPS):
        weights, error = solve(noise, strength)
        used = np.sum(noise * values / (strength + noise * values))
        strength = (used + 2 * PRIOR) / (weights @ weights + 2 * PRIOR)
        noise = (rows - used + 2 * PRIOR) / (error + 2 * PRIOR)
        if previous is not None and np.sum(np.abs(previous - weights)) < RIDGE_TOLERANCE:
            break
        previous = weights
    weights, _ = solve(noise, strength)
    result = np.zeros(size)
    result[others] = weights
    result[0] = mean[column] - weights @ mean[others]
    return result


@dataclass
class ChainedImputer:
    """Fitted imputer: for every missing pattern, a linear map from the known values."""

    names: list[str]
    maps: np.ndarray
    rounds: int
    changes: list[float] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficients by pattern, at most 2^9 rows."""
        rows = [
            (mask, [[float(v) for v in line] for line in self.maps[mask, 1:]]) for mask in range(self.maps.shape[0])]
        schema = T.StructType([
            T.StructField("mask", T.IntegerType()),
            T.StructField("lines", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ])
        return spark.createDataFrame(rows, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill the gaps; known values stay as they are, all features become doubles."""
        vector = F.array(F.lit(1.0), *[F.coalesce(_shifted(name), F.lit(0.0)) for name in self.names])

        def filled(position: int, name: str) -> Column:
            # reached only for rows with a gap in this column
            products = F.zip_with(C("lines")[position], vector, lambda a, b: a * b)
            value = F.aggregate(products, F.lit(ORIGIN.get(name, 0.0)), lambda a, b: a + b)
            return F.when(C(name).isNull(), value).otherwise(C(name).cast("double"))

        # rows without gaps look nothing up, so no coefficients are carried with them
        joined = df.withColumn("mask", F.nullif(missing_mask(self.names), F.lit(0))).join(
            F.broadcast(self.table(df.sparkSession)), "mask", "left")
        kept = [name for name in df.columns if name not in self.names]
        return joined.select(*kept, *[filled(k, name).alias(name) for k, name in enumerate(self.names)]).select(
            *df.columns)


def _start_maps(masks: int, size: int, means: np.ndarray) -> np.ndarray:
    """Known values map to themselves, missing ones to the column mean."""
    maps = np.zeros((masks, size, size))
    maps[:, 0, 0] = 1.0
    for mask in range(masks):
        for k in range(1, size):
            if mask >> (k - 1) & 1:
                maps[mask, k, 0] = means[k]
            else:
                maps[mask, k, k] = 1.0
    return maps


def fit_chained_imputer(df: DataFrame, names: list[str] | None = None) -> ChainedImputer:
    """Fit on ``df`` only; pass the fit subset so that nothing leaks from held-out rows."""
    names = names or contract.FEATURES
    size, masks = len(names) + 1, 1 << len(names)
    moments = np.zeros((masks, size, size))
    largest = 0.0
    for row in pattern_moments(df, names).collect():
        for i in range(size):
            for j in range(i, size):
                moments[row.mask, i, j] = moments[row.mask, j, i] = row[f"s_{i}_{j}"]
        largest = max([largest, *[row[f"m_{k}"] for k in range(len(names)) if row[f"m_{k}"] is not None]])

    has = np.array([[not mask >> k & 1 for k in range(len(names))] for mask in range(masks)])
    counts = np.array([moments[has[:, k], 0, 0].sum() for k in range(len(names))])
    sums = np.array([moments[has[:, k], 0, k + 1].sum() for k in range(len(names))])
    means = np.concatenate([[1.0], np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0)])

    maps = _start_maps(masks, size, means)
    history = [maps.copy()]
    order = np.argsort(-counts, kind="stable")
    for _ in range(MAX_ROUNDS):
        for k in order:
            if counts[k] == 0:
                continue
            seen = has[:, k] & (moments[:, 0, 0] > 0)
            gram = np.einsum("pij,pjk,plk->il", maps[seen], moments[seen], maps[seen], optimize=True)
            line = _ridge(gram, k + 1)
            gaps = ~has[:, k]
            others = maps[gaps].copy()
            others[:, k + 1, :] = 0.0
            maps[gaps, k + 1, :] = np.einsum("j,pjk->pk", line, others)
        history.append(maps.copy())

    changes = _round_changes(df, names, history)
    limit = TOLERANCE * largest
    last = next((r for r, change in enumerate(changes, start=1) if change < limit), MAX_ROUNDS)
    return ChainedImputer(names, history[last], last, changes)


def _round_changes(df: DataFrame, names: list[str], history: list[np.ndarray]) -> list[float]:
    """Largest change of any filled value in each round, from one pass over the rows with gaps."""
    spark = df.sparkSession
    rows = []
    for mask in range(1, history[0].shape[0]):
        gaps = [k + 1 for k in range(len(names)) if mask >> k & 1]
        steps = [
            (r, [float(v) for v in history[r][mask, k] - history[r - 1][mask, k]])
            for r in range(1, len(history)) for k in gaps
        ]
        rows.append((mask, steps))
    schema = T.StructType([
        T.StructField("mask", T.IntegerType()),
        T.StructField("steps", T.ArrayType(T.StructType([
            T.StructField("round", T.IntegerType()), T.StructField("line", T.ArrayType(T.DoubleType()))]))),
    ])
    vector = [F.lit(1.0), *[F.coalesce(_shifted(name), F.lit(0.0)) for name in names]]
    moved = F.abs(add_all([C("step.line")[k] * part for k, part in enumerate(vector)]))
    by_round = (
        df.select(missing_mask(names).alias("mask"), *names).filter(C("mask") > 0)
        .join(F.broadcast(spark.createDataFrame(rows, schema)), "mask")
        .withColumn("step", F.explode("steps"))
        .groupBy(C("step.round").alias("round")).agg(F.max(moved).alias("moved"))
    )
    found = {row["round"]: row.moved for row in by_round.collect()}
    return [found.get(r, 0.0) for r in range(1, len(history))]
