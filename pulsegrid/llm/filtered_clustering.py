"""Centroid clustering in whole numbers, filtered by leading rotated coordinates and residual norms.

Vectors are turned to integers once and stored with their first coordinates in a rotated basis (principal axes of a
bounded sample) and the norm of the rest. For a centroid c and a vector x

    |P(x - c)|^2 + (rest(x) - rest(c))^2  <=  |x - c|^2,

whatever orthonormal basis P comes from. A round takes, per vector, the centroid of the least bound, measures it in
integers, and measures another centroid only if its bound, less a margin for rounding, is not above the best distance
so far. Every decision is made on integers, so the basis, the sample and the partitioning never change a result.

A round is one pass over the stored table; tasks add up components per centroid, so what is shuffled is a few hundred
numbers a task. Centroids are the only thing that passes the driver.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite one are left
out. Repeated rows are vectors of their own. A vector without vec_id is clustered but never a first centroid while
others are left. With fewer vectors than centroids every vector is one; no vectors give no rows. Other columns are not
read. A component beyond +-131,072 is an error: its distances do not fit the contract's long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pulsegrid.session import durable

#: Components are below this after scaling: 64 squares of differences of two such numbers fit 63 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Settings:
    """components: of a vector; scale: integers per unit; centroids, rounds: of the clustering; leading: rotated coordinates kept;
    sample: vectors, at most, that the principal axes are taken from (only speed depends on them)."""

    components: int = 64
    scale: int = 1024
    centroids: int = 8
    rounds: int = 10
    leading: int = 8
    sample: int = 4_096


@dataclass(frozen=True)
class Basis:
    """Principal axes of the sample, as columns."""

    axes: np.ndarray

    def parts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of what they leave."""
        lead = vectors @ self.axes
        rest = (vectors * vectors).sum(1) - (lead * lead).sum(1)
        return lead, np.sqrt(np.maximum(rest, 0))


def kept_vectors(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """(vec_id, values) of the vectors that take part, as integers."""
    value = F.col("embedding")
    whole = (F.size(value) == settings.components) & ~F.exists(value, lambda x: x.isNull())
    kept = embeddings.filter(F.coalesce(whole, F.lit(False)))
    if isinstance(embeddings.schema["embedding"].dataType.elementType, (FloatType, DoubleType)):
        kept = kept.filter(~F.exists(value, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * settings.scale))
    fits = F.forall(value, lambda x: F.abs(x.cast("double")) * settings.scale < LARGEST)
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large for distances of type long")).cast("array<bigint>"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("values"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors of the least hashes, in hash order."""
    name = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "values").limit(settings.centroids).collect()
    return np.array([row["values"] for row in rows], np.int64).reshape(-1, settings.components)


def principal_axes(vectors: DataFrame, rows: int, settings: Settings) -> Basis:
    """From the vectors that a hash of their values picks: about ``sample``, all if there are fewer."""
    share = min(1.0, settings.sample / max(rows, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id", "values"), F.lit(1_000_000_007)) < int(share * 1_000_000_007) + 1)
    taken = picked.limit(2 * settings.sample).select("values").collect()
    sample = np.array([row["values"] for row in taken], np.float64).reshape(-1, settings.components)
    if len(sample) < 2:
        return Basis(np.eye(settings.components)[:, : settings.leading])
    centred = sample - sample.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    return Basis(np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")[: settings.leading]]))


def with_parts(vectors: DataFrame, basis: Basis, settings: Settings) -> DataFrame:
    """The stored table: (vec_id, values, lead, rest)."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = basis.parts(_matrix(batch["values"], settings.components).astype(np.float64))
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * lead.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["values"], pa.ListArray.from_arrays(pa.array(bounds), pa.array(lead.ravel())), pa.array(rest)],
                names=["vec_id", "values", "lead", "rest"],
            )

    return vectors.mapInArrow(rotate, "vec_id long, values array<long>, lead array<double>, rest double")


def nearest(values: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number on ties), its squared distance, and how many distances were measured."""
    spot, left = basis.parts(centroids.astype(np.float64))
    bound = ((lead[:, None, :] - spot[None]) ** 2).sum(2) + (rest[:, None] - left[None]) ** 2
    scale = (values.astype(np.float64) ** 2).sum(1)[:, None] + (centroids.astype(np.float64) ** 2).sum(1)[None]
    bound -= 1e-6 * scale + 1e-6  # rounding; that of a small residual norm is of the order of 1e-8
    every = np.arange(len(values))
    cluster = bound.argmin(1)
    distance = ((values - centroids[cluster]) ** 2).sum(1)
    measured = len(values)
    tried = cluster.copy()
    for k in range(len(centroids)):
        rows = every[(bound[:, k] <= distance) & (tried != k)]
        if len(rows):
            exact = ((values[rows] - centroids[k]) ** 2).sum(1)
            better = (exact < distance[rows]) | ((exact == distance[rows]) & (k < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = k, exact[better]
            measured += len(rows)
    return cluster.astype(np.int32), distance, measured


def next_centroids(stored: DataFrame, centroids: np.ndarray, basis: Basis, settings: Settings) -> np.ndarray:
    """Exact floors of the clusters' means; a centroid without vectors stays."""
    width = settings.components

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            values = _matrix(batch["values"], width)
            cluster, _, _ = nearest(values, _matrix(batch["lead"], basis.axes.shape[1]), batch["rest"].to_numpy(), centroids, basis)
            for k in np.unique(cluster):
                rows = cluster == k
                counts[k] += rows.sum()
                sums[k] += values[rows].sum(0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"],
        )

    parts = stored.mapInArrow(add_up, "cluster int, n long, sums array<long>")
    single = parts.select("cluster", "n", F.posexplode("sums").alias("component", "part"))
    totals = single.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    moved = centroids.copy()
    for row in totals:
        moved[row["cluster"], row["component"]] = row["total"] // row["n"]
    return moved


def assigned(stored: DataFrame, centroids: np.ndarray, basis: Basis, settings: Settings) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch["values"], settings.components)
            cluster, distance, _ = nearest(values, _matrix(batch["lead"], basis.axes.shape[1]), batch["rest"].to_numpy(), centroids, basis)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """The last assignment (vec_id, cluster, distance), stored, and the final centroids."""
    vectors = durable(kept_vectors(embeddings, settings), "vectors")
    centroids = first_centroids(vectors, settings)
    if not len(centroids):
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, centroids
    basis = principal_axes(vectors, vectors.count(), settings)
    stored = durable(with_parts(vectors, basis, settings), "rotated")
    for _ in range(settings.rounds):
        centroids = next_centroids(stored, centroids, basis, settings)
    return durable(assigned(stored, centroids, basis, settings), "assigned"), centroids


def report(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's row per vector."""
    rows, centroids = cluster(embeddings, settings)
    # sums of squared distances of all rows may pass 63 bits on the way
    sums = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia, of_cluster, prints = F.lit(sum(sums.values())).cast("long"), F.lit(0).cast("long"), F.lit("")
    for k, centroid in enumerate(centroids):
        mine = F.col("cluster") == k
        of_cluster = F.when(mine, F.lit(sums.get(k, 0)).cast("long")).otherwise(of_cluster)
        prints = F.when(mine, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()).otherwise(prints)
    return rows.select(
        "vec_id", "cluster", "distance", of_cluster.alias("cluster_inertia"), inertia.alias("inertia"), prints.alias("centroid_sha256"),
    )
