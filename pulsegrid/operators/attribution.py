"""Path-dependent Shapley contributions of tree ensembles, for trees of any depth.

With some features known, a tree's output is the mean of its leaves, weighted at
splits on unknown features by the training share of either side. A leaf then
contributes to feature f

    value * (met_f - share_f) * sum over subsets of the others of their weights,

and that sum is the integral over y in [0, 1] of the polynomial
``prod_j (y * met_j + (1 - y) * share_j)`` over the other features of its path.
Gauss-Legendre nodes integrate a polynomial of this degree exactly, so the
product is carried down the tree at a few nodes, one factor an edge, and the
leaves' sums are carried up: an edge costs the same whatever the depth, and no
table of subsets is needed. A feature that is split on again replaces its factor.

The trees are flat arrays made once on the driver (their size is bounded by the
number of trees and the depth) and shipped with the task; rows are read in Arrow
batches, every edge is applied to the whole batch at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.operators import cells
from pulsegrid.session import durable

#: Rows that go through a tree together: their products fit a processor's cache.
BATCH = 4_096


@dataclass(frozen=True)
class Trees:
    """All nodes of an ensemble. ``feature`` is -1 at leaves; ``share``: of the parent's training weight; ``value`` holds the
    leaves' outputs, already times the tree's weight."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def expected(self) -> float:
        """Training mean of the raw output: what contributions start from."""
        return sum(_mean(self, root) for root in self.roots)


def _mean(trees: Trees, root: int) -> float:
    total, pending = 0.0, [(root, 1.0)]
    while pending:
        node, weight = pending.pop()
        if trees.feature[node] < 0:
            total += weight * trees.value[node]
        else:
            pending += [(child, weight * trees.share[child]) for child in (trees.left[node], trees.right[node])]
    return total


def tree_arrays(spark: SparkSession, estimator, path: str) -> Trees:
    """Of a fitted forest (share of the positive class) or boosted ensemble (margin), from its saved table of nodes."""
    estimator.write().overwrite().save(path)
    forest = "Forest" in type(estimator).__name__
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("cut"),
        F.aggregate(node["impurityStats"], F.lit(0.0), lambda total, x: total + x).alias("all"), node["impurityStats"][0].alias("first"),
        node["impurityStats"][1].alias("second"), node["prediction"].alias("prediction"),
    ).toPandas().sort_values(["tree", "id"], kind="stable")
    tree, ident = nodes["tree"].to_numpy(), nodes["id"].to_numpy()
    roots = np.flatnonzero(ident == 0)
    begin = np.zeros(tree.max() + 1, np.int64)
    begin[tree[roots]] = roots
    inner = nodes["left"].to_numpy() >= 0
    left, right = (np.where(inner, begin[tree] + nodes[side].to_numpy(), -1) for side in ("left", "right"))
    weight = nodes["all" if forest else "first"].to_numpy()
    share = np.ones(len(nodes))
    for side in (left, right):
        share[side[inner]] = weight[side[inner]] / weight[inner]
    scale = np.array(estimator.treeWeights, dtype=float) / (sum(estimator.treeWeights) if forest else 1.0)
    value = nodes["second"].to_numpy() / weight if forest else nodes["prediction"].to_numpy()
    return Trees(roots, np.where(inner, nodes["feature"].to_numpy(), -1), nodes["cut"].to_numpy(dtype=float), left, right, share, value * scale[tree])


def contributions(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Contribution of every feature (column) to the output for every row of ``x``."""
    rows, features = x.shape
    nodes = min(features, int(np.unique(trees.feature[trees.feature >= 0]).size) or 1) // 2 + 1
    y, weight = np.polynomial.legendre.leggauss(nodes)
    y, weight = ((y + 1) / 2)[:, None], weight / 2
    columns = [np.ascontiguousarray(x[:, f]) for f in range(features)]
    out = np.zeros((features, rows))
    whole = np.ones((nodes, 1)), np.zeros((nodes, 1)), True, 1.0  # factor, (met - share) / factor, met, share of a feature not split on yet

    def visit(node: int, product: np.ndarray, known: dict) -> np.ndarray:
        f = trees.feature[node]
        if f < 0:
            return trees.value[node] * product
        low = columns[f] <= trees.cut[node]
        factor, credit, met, share = known.get(f, whole)
        above = product / factor
        total = np.zeros_like(product)
        for child, side in ((trees.left[node], low), (trees.right[node], ~low)):
            follow, now = share * trees.share[child], met & side
            missed = (1 - y) * follow
            new = np.where(now, missed + y, missed)
            gain = np.where(now, (1 - follow) / (missed + y), -follow / missed)
            part = visit(child, above * new, {**known, f: (new, gain, now, follow)})
            out[f] += weight @ (part * (gain - credit))
            total += part
        return total

    for root in trees.roots:
        visit(root, np.ones((nodes, rows)), {})
    return out.T


#: Rows of a task: every edge of every tree is applied to each, so a task takes far fewer rows than a scan does.
TASK_ROWS = 20_000


def spread(stored: DataFrame) -> DataFrame:
    """A stored table dealt to all tasks, in parts of about TASK_ROWS rows, however few files it stands in."""
    parts = max(stored.count() // TASK_ROWS, stored.sparkSession.sparkContext.defaultParallelism)
    return stored.repartition(int(parts))


def tree_contributions(df: DataFrame, trees: Trees, prefix: str) -> DataFrame:
    """Add ``{prefix}{feature}``: the exact contributions to the ensemble's raw output."""
    names = contract.FEATURES
    output = [f"{prefix}{name}" for name in names]
    fields = [f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema.fields]
    schema = ", ".join(fields + [f"`{name}` double" for name in output])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            parts = [contributions(trees, x[k : k + BATCH]) for k in range(0, len(x), BATCH)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield batch.assign(**{name: found[:, k] for k, name in enumerate(output)})

    return df.mapInPandas(explain, schema)


# -- by cells: rows of the same bins have the same contributions ---------------------------------

#: Leaves whose tables are added together.
LEAVES = 2_048
#: Slabs above which cells are explained one by one.
MAX_SLABS = 4_096


def leaf_boxes(trees: Trees, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value of every leaf, and for each feature the share of its splits on the path and the ends of what meets them."""
    node, found = np.asarray(trees.roots), []
    share, low, high = np.ones((len(node), features)), np.full((len(node), features), -np.inf), np.full((len(node), features), np.inf)
    while node.size:
        leaf = trees.feature[node] < 0
        found.append((trees.value[node[leaf]], share[leaf], low[leaf], high[leaf]))
        node, share, low, high = node[~leaf], share[~leaf], low[~leaf], high[~leaf]
        at, f, cut, parts = np.arange(len(node)), trees.feature[node], trees.cut[node], []
        for child, ends, side in ((trees.left[node], high, np.minimum), (trees.right[node], low, np.maximum)):
            follow, bound = share.copy(), ends.copy()
            follow[at, f] *= trees.share[child]
            bound[at, f] = side(bound[at, f], cut)
            parts.append((child, follow, *((low, bound) if ends is high else (bound, high))))
        node, share, low, high = (np.concatenate(both) for both in zip(*parts))
    return tuple(np.concatenate(all_) for all_ in zip(*found))


def slab_contributions(boxes: tuple, values: list[np.ndarray]) -> np.ndarray:
    """Contributions of every feature (first axis) at every combination of the features' values.

    What the trees give with some features known is a table with a place for "unknown" beside a feature's values; a leaf adds a
    product of one factor a feature to it. Along the two longest axes only the ends of a leaf's box are noted and summed up
    afterwards. The mean over subsets of features is then taken axis by axis at the quadrature nodes.
    """
    leaf, share, low, high = boxes
    features = len(values)
    wide = sorted(range(features), key=lambda f: -len(values[f]))[:2]
    small = [f for f in range(features) if f not in wide]
    lengths = [len(values[f]) + 1 for f in small]
    sizes = [len(values[f]) + 2 for f in wide]  # one place behind the last value, for ends that are not reached
    table = np.zeros((int(np.prod(sizes)), int(np.prod(lengths, dtype=int))))
    places = list(table)
    ends = [(np.searchsorted(values[f], low[:, f], "right"), np.searchsorted(values[f], high[:, f], "right")) for f in wide]
    ends = [(first, np.maximum(first, last)) for first, last in ends]  # empty where two splits contradict
    for k in range(0, len(leaf), LEAVES):
        part = slice(k, k + LEAVES)
        dense = leaf[part, None]
        for f in small:
            met = (low[part, f, None] < values[f]) & (values[f] <= high[part, f, None])
            axis = np.concatenate([share[part, f, None], met], axis=1)
            dense = (dense[:, :, None] * axis[:, None, :]).reshape(len(dense), -1)
        marks = [[*zip(share[part, f], *(end[part] for end in pair), strict=True)] for f, pair in zip(wide, ends, strict=True)]
        for add, first, second in zip(dense, marks[0], marks[-1], strict=True):
            for at, line in ((0, add * first[0]), (1 + first[1], add), (1 + first[2], -add)):
                if len(wide) == 1:
                    places[at] += line
                    continue
                by = at * sizes[1]
                places[by] += line * second[0]
                places[by + 1 + second[1]] += line
                places[by + 1 + second[2]] -= line
    table = table.reshape(*sizes, *lengths)
    for axis in range(len(wide)):
        inner = (slice(None),) * axis
        table[(*inner, slice(1, None))] = table[(*inner, slice(1, None))].cumsum(axis)
        table = table[(*inner, slice(0, -1))]
    order = [*wide, *small]
    y, weight = np.polynomial.legendre.leggauss(features // 2 + 1)
    out = np.zeros((features, *[len(values[f]) for f in order]))
    for at, by in zip((y + 1) / 2, weight / 2):
        for f in range(features):
            rest = table
            for axis in reversed(range(features)):
                inner = (slice(None),) * axis
                unknown, known = rest[(*inner, slice(0, 1))], rest[(*inner, slice(1, None))]
                rest = known - unknown if order[axis] == f else at * known + (1 - at) * unknown
            out[f] += by * rest
    return np.transpose(out, [0, *[1 + order.index(f) for f in range(features)]])


def tree_cuts(trees: Trees) -> list[np.ndarray]:
    """The cuts of every feature."""
    return [np.unique(trees.cut[trees.feature == f]) for f in range(len(contract.FEATURES))]


def explained_cells(known: DataFrame, trees: Trees, prefix: str) -> DataFrame:
    """``cell`` and its contributions for distinct numbers of cells of the trees' cuts; stored.

    Combinations of bins are dealt by those of the features with more than two bins, but for the two with most: a slab.
    """
    names = contract.FEATURES
    cuts = tree_cuts(trees)
    ends = [np.append(cut, np.inf) for cut in cuts]  # what stands for a bin: its upper end
    wide = sorted(range(len(names)), key=lambda f: -len(ends[f]))[:2]
    fixed = [f for f in range(len(names)) if len(ends[f]) > 2 and f not in wide]
    slab = [F.col(cells.BIN[f]) for f in fixed]
    known = durable(cells.bins_of(known.select("cell"), cuts, "cell").withColumn("slab", F.concat_ws("-", *slab)), "cells")
    slabs = known.select("slab").distinct().count()
    output = [f"{prefix}{name}" for name in names]
    if slabs > MAX_SLABS:
        explained = tree_contributions(cells.with_values(spread(known.select("cell")), cuts, "cell"), trees, prefix)
        return durable(explained.select("cell", *output), "explained")
    held = known.sparkSession.sparkContext.broadcast(leaf_boxes(trees, len(names)))

    def explain(batch: pd.DataFrame) -> pd.DataFrame:
        at = batch[cells.BIN].to_numpy().T.copy()
        values = list(ends)
        for f in fixed:
            values[f], at[f] = ends[f][at[f, :1]], 0
        found = slab_contributions(held.value, values)[:, *at]
        return batch[["cell"]].assign(**dict(zip(output, found)))

    schema = ", ".join(["cell bigint"] + [f"`{name}` double" for name in output])
    return durable(known.repartition(max(slabs, 1), "slab").groupBy("slab").applyInPandas(explain, schema), "explained")


def cell_contributions(df: DataFrame, trees: Trees, prefix: str) -> DataFrame:
    """``tree_contributions`` of a stored table, worked out once for all rows of the same bins."""
    cuts = tree_cuts(trees)
    if not cells.countable(cuts):
        return tree_contributions(df, trees, prefix)
    numbered = cells.numbered(df, cuts, "cell")
    explained = explained_cells(numbered.select("cell").distinct(), trees, prefix)
    return cells.attach(numbered, explained, "cell").select(*df.columns, *[f"{prefix}{name}" for name in contract.FEATURES])
