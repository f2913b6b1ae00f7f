"""Training rows as weighted cells: all that a tree of binned features sees of a table, however many rows it has.

Every feature is cut at candidates between neighbouring values (at most ``BINS`` - 1, of a bounded sample of rows, as Spark's own
trees take them). Rows of the same bins, label and weight are one cell that counts them. Boosted trees fitted on cells are those
of the rows, since a tree adds up weights. A forest draws every row Poisson(1) times for each tree, so it draws a cell of n rows
Poisson(n) times: the same distribution. Fitted nodes are written in place of bins with their cuts, so models read plain features.

There are at most as many cells as rows, and no more than the bins of the features allow: of known features 2 x 32 x 32 x 288 here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.session import durable, shared_path

C = F.col
BINS = 32
#: Rows that the candidate cuts are taken from; all others only choose among them.
CUT_ROWS = 10_000
#: Cells of a task of the boosted fit.
TASK_CELLS = 20_000
#: Cells of a table that is broadcast; a row of it holds a number and at most ten values.
BROADCAST_CELLS = 400_000
BIN = [f"bin_{name}" for name in contract.FEATURES]


def cuts_of(values: np.ndarray, weight: np.ndarray) -> list[float]:
    """Midpoints between neighbouring values, at most BINS - 1, that split the weight about evenly."""
    distinct, place = np.unique(values, return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) < BINS:
        return middle.tolist()
    mass = np.bincount(place, weight)
    stride = mass.sum() / BINS
    found, below, target = [], mass[0], stride
    for k in range(1, len(distinct)):
        upto = below + mass[k]
        if abs(below - target) < abs(upto - target):
            found.append(float(middle[k - 1]))
            target += stride
        below = upto
    return found


def candidate_cuts(rows: DataFrame) -> list[list[float]]:
    """Cuts of every feature; a value lies left of a cut that it does not exceed."""
    count = rows.count()
    sampled = rows.sample(CUT_ROWS / count, contract.SEED) if count > CUT_ROWS else rows
    found = sampled.select(*[C(name).cast("double") for name in contract.FEATURES], "fit_weight").toArrow()
    weight = found["fit_weight"].to_numpy()
    return [cuts_of(found[name].to_numpy(), weight) if count else [] for name in contract.FEATURES]


def with_bins(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Add the bin of every feature: the number of its cuts that lie below the value."""
    cut = {name: found for name, found in zip(contract.FEATURES, cuts, strict=True) if len(found)}
    binned = rows.withColumns({f"bin_{name}": F.lit(0.0) for name in contract.FEATURES if name not in cut})
    if not cut:
        return binned
    return Bucketizer(  # a bucket begins with its lower end, a bin ends with its upper one
        inputCols=list(cut), outputCols=[f"bin_{name}" for name in cut],
        splitsArray=[[-np.inf, *np.nextafter(found, np.inf).tolist(), np.inf] for found in cut.values()],
    ).transform(binned)


def countable(cuts: list[list[float]]) -> bool:
    """Whether the combinations of bins can be numbered."""
    return math.prod(len(found) + 1 for found in cuts) < 1 << 62


def numbered(rows: DataFrame, cuts: list[list[float]], name: str) -> DataFrame:
    """Add ``name``, the number of the combination of bins."""
    number = F.lit(0).cast("bigint")
    for column, found in zip(BIN, cuts, strict=True):
        number = number * (len(found) + 1) + C(column).cast("bigint")
    return with_bins(rows, cuts).withColumn(name, number).drop(*BIN)


def bins_of(numbers: DataFrame, cuts: list[list[float]], name: str) -> DataFrame:
    """Add the bins that a number stands for."""
    added, step = {}, 1
    for column, found in zip(reversed(BIN), reversed(cuts), strict=True):
        added[column] = F.expr(f"({name} div {step}) % {len(found) + 1}").cast("int")
        step *= len(found) + 1
    return numbers.withColumns(added)


def with_values(numbers: DataFrame, cuts: list[list[float]], name: str) -> DataFrame:
    """Add the features, each with a value of its bin: trees that split at the cuts treat it like every other of the bin."""
    ends = [F.array(*[F.lit(float(cut)) for cut in [*found, found[-1] + 1 if len(found) else 0.0]]) for found in cuts]
    return bins_of(numbers, cuts, name).withColumns(
        {feature: F.get(end, C(column)) for feature, end, column in zip(contract.FEATURES, ends, BIN, strict=True)}).drop(*BIN)


def attach(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Rows with the columns of a stored table of cells, one row a cell; a table of counted size is broadcast, a larger one shuffled."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_CELLS else table, name)


def cells(rows: DataFrame, cuts: list[list[float]], label: str) -> DataFrame:
    """Bins, label, ``fit_weight`` of a row and ``rows``, the number of rows; stored."""
    binned = with_bins(rows, cuts)
    keys = [*[C(name).cast("tinyint").alias(name) for name in BIN], label, "fit_weight"]
    return durable(binned.select(*keys).groupBy(*BIN, label, "fit_weight").agg(F.count(F.lit(1)).alias("rows")), "cells")


def fit_boosted(estimator, found: DataFrame, cuts: list[list[float]]) -> GBTClassificationModel:
    """Boosted trees of the cells, with cuts in place of bins."""
    spark = found.sparkSession
    tasks = min(found.count() // TASK_CELLS + 1, spark.sparkContext.defaultParallelism)
    weighted = found.withColumn("fit_weight", C("fit_weight") * C("rows")).repartition(tasks)
    model = estimator.fit(VectorAssembler(inputCols=BIN, outputCol="features").transform(weighted))
    path = shared_path(spark, "boosted")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    split = C("nodeData")["split"]
    ends = F.array(*[F.array(*[F.lit(cut) for cut in found]).cast("array<double>") for found in cuts])
    at = F.floor(F.get(split["leftCategoriesOrThreshold"], 0)).cast("int")
    plain = F.when(split["featureIndex"] >= 0, F.array(F.get(F.get(ends, split["featureIndex"]), at))).otherwise(split["leftCategoriesOrThreshold"])
    nodes = stored.withColumn("nodeData", C("nodeData").withField("split.leftCategoriesOrThreshold", plain))
    _replace_nodes(nodes, path)
    return GBTClassificationModel.load(path)


def _replace_nodes(nodes: DataFrame, path: str) -> None:
    """Write the nodes over those of a saved ensemble."""
    durable(nodes, "nodes").coalesce(1).write.mode("overwrite").parquet(f"{path}/data")


# -- forests ---------------------------------------------------------------------------------

_NODES = "tree int, id int, prediction double, impurity double, negative double, positive double, drawn long, gain double, left int, right int, feature int, cut double"
_NODE_DATA = (
    "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def _gini(negative: np.ndarray, positive: np.ndarray) -> np.ndarray:
    total = np.maximum(negative + positive, np.finfo(float).tiny)
    return 1.0 - (negative / total) ** 2 - (positive / total) ** 2


def grow_tree(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, leaf_rows: int, seed) -> pd.DataFrame:
    """One tree of a forest on a bootstrap of the rows that the cells (columns of ``bins``) count, level by level.

    A node tries a root of the features, takes the cut of the largest Gini gain with ``leaf_rows`` drawn rows on either side, and
    neighbouring leaves of one class are merged, as in Spark's forests.
    """
    rng = np.random.default_rng(seed)
    features, width = len(bins), bins.max(axis=1, initial=0).astype(int) + 1
    tried = max(1, int(np.ceil(np.sqrt(features))))
    drawn = rng.poisson(rows)
    kept = drawn > 0
    x, drawn = bins[:, kept], drawn[kept]
    mass = np.stack([np.where(label[kept] == value, drawn * weight[kept], 0.0) for value in (0, 1)])
    place, first, levels = np.zeros(len(drawn), np.int64), 0, []
    nodes = 1
    for level in range(depth + 1):
        negative, positive = (np.bincount(place, part, nodes) for part in mass)
        impurity, total = _gini(negative, positive), np.maximum(negative + positive, np.finfo(float).tiny)
        best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        open_ = (impurity > 1e-12) & (level < depth)
        picks = np.zeros((nodes, features), bool)
        np.put_along_axis(picks, np.argsort(rng.random((nodes, features)), axis=1)[:, :tried], True, axis=1)
        picks &= open_[:, None]
        for f in range(features):
            asked = np.flatnonzero(picks[:, f])
            if width[f] < 2 or not asked.size:
                continue
            turn = np.full(nodes, -1)
            turn[asked] = np.arange(asked.size)
            slot = turn[place]
            use = np.flatnonzero(slot >= 0)
            at = slot.take(use) * width[f] + x[f].take(use)
            sums = [np.bincount(at, part.take(use), asked.size * width[f]).reshape(-1, width[f]).cumsum(1) for part in (*mass, drawn)]
            (low0, low1, low), (high0, high1, high) = [s[:, :-1] for s in sums], [s[:, -1:] - s[:, :-1] for s in sums]
            gain = impurity[asked, None] - ((low0 + low1) * _gini(low0, low1) + (high0 + high1) * _gini(high0, high1)) / total[asked, None]
            gain = np.where((low >= leaf_rows) & (high >= leaf_rows), gain, 0.0)
            top = gain.argmax(1)
            gain = gain[np.arange(asked.size), top]
            better = gain > best[asked]
            best[asked[better]], feature[asked[better]], cut[asked[better]] = gain[better], f, top[better]
        split = feature >= 0
        left = np.full(nodes, -1)
        left[split] = first + nodes + 2 * np.arange(split.sum())
        levels.append(pd.DataFrame({
            "prediction": (positive > negative).astype(float), "impurity": impurity, "negative": negative, "positive": positive,
            "drawn": np.bincount(place, drawn, nodes).astype(np.int64), "gain": np.where(split, best, -1.0), "left": left,
            "right": np.where(split, left + 1, -1), "feature": feature, "cut": cut}))
        if not split.any():
            break
        on = np.flatnonzero(split[place])
        if len(on) < len(place):
            x, drawn, mass, place = x.take(on, axis=1), drawn.take(on), mass.take(on, axis=1), place.take(on)
        above = x[feature[place], np.arange(len(place))] > cut[place]
        place = left[place] - first - nodes + above
        first, nodes = first + nodes, 2 * int(split.sum())
    return _merged(pd.concat(levels, ignore_index=True))


def _merged(nodes: pd.DataFrame) -> pd.DataFrame:
    """Without splits between leaves of one class; numbered anew, parents first."""
    left, right, predicted = (nodes[name].to_numpy().copy() for name in ("left", "right", "prediction"))
    for k in range(len(nodes) - 1, -1, -1):
        if left[k] >= 0 and left[left[k]] < 0 and left[right[k]] < 0 and predicted[left[k]] == predicted[right[k]]:
            left[k] = right[k] = -1
    reached = np.zeros(len(nodes), bool)
    reached[0] = True
    for k in range(len(nodes)):
        if reached[k] and left[k] >= 0:
            reached[left[k]] = reached[right[k]] = True
    number = np.append(np.cumsum(reached) - 1, -1)  # -1 stays
    leaf = left < 0
    nodes = nodes.assign(id=number[:-1], left=number[left], right=number[right], feature=np.where(leaf, -1, nodes["feature"]), gain=np.where(leaf, -1.0, nodes["gain"]))
    return nodes[reached]


def fit_forest(estimator, found: DataFrame, cuts: list[list[float]], label: str) -> RandomForestClassificationModel:
    """A forest of the cells: every tree grows in one task from the table of cells, which is bounded, and its own draws."""
    spark = found.sparkSession
    table = found.toArrow()
    x = np.stack([table[name].to_numpy().astype(np.uint8) for name in BIN])
    held = spark.sparkContext.broadcast((x, table[label].to_numpy(), table["fit_weight"].to_numpy(), table["rows"].to_numpy()))
    trees, depth, leaf_rows = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    ends = [np.array(list_) for list_ in cuts]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                nodes = grow_tree(*held.value, depth, leaf_rows, [contract.SEED, int(tree)])
                feature, cut = nodes["feature"].to_numpy(), nodes["cut"].to_numpy(dtype=float)
                for f, list_ in enumerate(ends):
                    cut[feature == f] = list_[cut[feature == f].astype(int)]
                yield nodes.assign(tree=int(tree), cut=cut)[[field.split()[0] for field in _NODES.split(", ")]]

    grown = spark.range(0, trees, 1, trees).mapInPandas(grow, _NODES)
    node = F.struct(
        "id", "prediction", "impurity", F.array("negative", "positive"), "drawn", "gain", "left", "right",
        F.struct("feature", F.when(C("feature") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>")), F.lit(-1)),
    ).cast(_NODE_DATA)
    path = shared_path(spark, "forest")
    # two rows make an ensemble of as many trees with the same settings; its nodes are then replaced
    either = [(Vectors.dense([float(value)] * len(BIN)), value, 1.0) for value in (0, 1)]
    estimator.fit(spark.createDataFrame(either, ["features", label, "fit_weight"]).coalesce(1)).write().save(path)
    _replace_nodes(grown.select(C("tree").alias("treeID"), node.alias("nodeData")), path)
    held.destroy()
    return RandomForestClassificationModel.load(path)
