"""Approximate nearest neighbours by cosine: lists of rotated vectors in column blocks, scanned adaptively.

1. Rows of one vector are one entry that carries its smallest ids, so a vector that a third of all rows share is
   stored, probed and compared once.
2. A bounded sample (``sample`` vectors a query can wait for the driver to look at) gives, per number of components, a
   random rotation, list centroids, and the number of lists to probe: the fewest that find ``recall`` of the sample's
   own neighbours, measured against brute force. The index itself holds every entry.
3. Entries are rotated, scaled to length 1 and stored per list in column blocks of ``columns`` coordinates. Lists are
   cut by hash into blocks of about ``block`` entries, the queries of a list into blocks of ``queries``; a task gets one
   block of each, so hot lists spread over many tasks and no task holds a whole list.
4. Inside a block a query reads one column block after another. After d of D coordinates an entry stays only while
   partial * D / d <= (1 + epsilon / sqrt(d))^2 * r^2: the hypothesis that it lies within r is not rejected yet. r is the
   query's k-th distance so far; it starts from ``seeds`` vectors of the sample.
5. Survivors, and the nearest seeds, are scored on the original vectors in double precision; the best are ranked per
   query. As the seeds are entries too, no query has fewer neighbours than there are candidates or ``neighbours``.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows
without vec_id. Of several vectors under one id the least stands for it. Neighbours have the query's number of
components. A query alone in its space has no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType
from pyspark.sql.window import Window

from pulsegrid.session import durable


@dataclass(frozen=True)
class Settings:
    """neighbours: wanted; every: ids divisible by it are queries; sample: vectors the index is fitted on; recall: that probing
    reaches on the sample; most_lists: per number of components; columns: coordinates in a column block; epsilon: of the test;
    block, queries: about so many entries and queries meet in a task; seeds: sample vectors that give a first distance."""

    neighbours: int = 5
    every: int = 50
    sample: int = 16_384
    recall: float = 0.97
    most_lists: int = 1_024
    columns: int = 16
    epsilon: float = 2.5
    block: int = 4_096
    queries: int = 1_024
    seeds: int = 2_048

    @property
    def wanted(self) -> int:
        """Neighbours and the query itself."""
        return self.neighbours + 1


@dataclass(frozen=True)
class Space:
    """The index of vectors of one number of components."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    seeds: np.ndarray
    seed_vectors: np.ndarray
    seed_ids: list[list[int]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that squares neither overflow nor vanish."""
    scaled = evened(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def evened(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def squared(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Squared distances between rows of length 1."""
    return np.maximum(2 - 2 * (ours @ theirs.T), 0)


# --- fitting ---------------------------------------------------------------------------------------------------------

def _centroids(vectors: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    centroids = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(vectors, max(1, len(vectors) // 2_048))])
        order = np.argsort(nearest, kind="stable")
        starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        sums = np.add.reduceat(vectors[order], starts)
        some = nearest[order][starts]
        centroids[some] = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return centroids


def _probes(vectors: np.ndarray, centroids: np.ndarray, settings: Settings) -> int:
    """The fewest lists a query has to probe so that ``recall`` of the sample's neighbours are in them."""
    tests = vectors[np.linspace(0, len(vectors) - 1, min(256, len(vectors))).astype(int)]
    near = squared(tests, vectors)
    near = np.argsort(near, axis=1, kind="stable")[:, 1 : settings.wanted]
    of_list = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(vectors, max(1, len(vectors) // 2_048))])
    place = np.argsort(np.argsort(-(tests @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, of_list[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(settings.recall * len(needed)))]) + 1 if len(needed) else 1


def fit(entries: DataFrame, settings: Settings) -> dict[int, Space]:
    """A space for each number of components among the sampled entries; the sample is what a hash of the id picks."""
    total = entries.count()
    share = int(min(1.0, settings.sample / max(total, 1)) * 1_000_000_007) + 1
    picked = entries.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000_007)) < share)
    rows = picked.limit(2 * settings.sample).select("vec_id", "ids", "embedding").collect()
    by_width: dict[int, list] = {}
    for row in sorted(rows):
        by_width.setdefault(len(row["embedding"]), []).append(row)
    spaces = {}
    for width, taken in by_width.items():
        sample = unit(np.array([row["embedding"] for row in taken], np.float64))
        seeds = [row["ids"] for row in taken[: settings.seeds]], evened(np.array([row["embedding"] for row in taken[: settings.seeds]], np.float64))
        rotation, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
        expected = total * len(sample) / len(rows)
        lists = max(1, min(settings.most_lists, len(sample) // 16, int(math.sqrt(expected))))
        centroids = _centroids(sample, lists)
        spaces[width] = Space(rotation, centroids, _probes(sample, centroids, settings), sample[: settings.seeds].astype(np.float32), seeds[1], seeds[0])
    return spaces


# --- the index and the queries --------------------------------------------------------------------------------------

def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one a vec_id."""
    value = F.col("embedding")
    good = (F.size(value) > 0) & ~F.exists(value, lambda x: x.isNull()) & F.col("vec_id").isNotNull()
    rows = embeddings.filter(F.coalesce(good, F.lit(False)))
    if isinstance(embeddings.schema["embedding"].dataType.elementType, (FloatType, DoubleType)):
        rows = rows.filter(~F.exists(value, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.filter(F.exists(value, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), value.cast("array<double>").alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def entries_of(rows: DataFrame, settings: Settings) -> DataFrame:
    """Distinct vectors: the least id, the ``wanted`` smallest ids, the vector. Spark limits the ranks before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= settings.wanted)
    return few.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each number of components in a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, values[(ends[rows] - width)[:, None] + np.arange(width)]


def _column_blocks(rotated: np.ndarray, columns: int) -> list[list[bytes]]:
    """Per row, the column blocks as bytes of 32-bit floats."""
    cut = [np.ascontiguousarray(rotated[:, at : at + columns].astype(np.float32)) for at in range(0, rotated.shape[1], columns)]
    return [[block[i].tobytes() for block in cut] for i in range(len(rotated))]


def indexed(entries: DataFrame, spaces: dict[int, Space], settings: Settings) -> DataFrame:
    """Every entry in its list: (width, list, ids, embedding, columns)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_width(batch["embedding"]):
                space, vectors = spaces.get(vectors.shape[1]), unit(vectors)
                lists = (vectors @ space.centroids.T).argmax(1) if space else np.zeros(len(rows), np.int64)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), vectors.shape[1], np.int32)), pa.array(lists.astype(np.int32)), batch["ids"].take(taken),
                    batch["embedding"].take(taken), pa.array(_column_blocks(vectors @ space.rotation if space else vectors, settings.columns), pa.list_(pa.binary())),
                ], names=["width", "list", "ids", "embedding", "columns"])

    return entries.select("ids", "embedding").mapInArrow(place, "width int, list int, ids array<long>, embedding array<double>, columns array<binary>")


def routed(queries: DataFrame, spaces: dict[int, Space], settings: Settings) -> DataFrame:
    """Each query at the lists it probes: (width, list, query, embedding, columns, near); ``near`` is a squared distance that
    ``wanted`` entries keep."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_width(batch["embedding"]):
                width, vectors = vectors.shape[1], unit(vectors)
                space, near, lists = spaces.get(width), np.full(len(rows), np.inf), [[0]] * len(rows)
                if space:
                    lists = list(np.argsort(-(vectors @ space.centroids.T), axis=1, kind="stable")[:, : space.probes].astype(np.int32))
                    if len(space.seeds) >= settings.wanted:
                        near = np.partition(squared(vectors, space.seeds), settings.wanted - 1, axis=1)[:, settings.wanted - 1]
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), width, np.int32)), pa.array(lists, pa.list_(pa.int32())), batch["query"].take(taken),
                    batch["embedding"].take(taken), pa.array(_column_blocks(vectors @ space.rotation if space else vectors, settings.columns), pa.list_(pa.binary())),
                    pa.array(near),
                ], names=["width", "lists", "query", "embedding", "columns", "near"])

    schema = "width int, lists array<int>, query long, embedding array<double>, columns array<binary>, near double"
    return queries.mapInArrow(route, schema).withColumn("list", F.explode("lists")).drop("lists")


def seeded(queries: DataFrame, spaces: dict[int, Space], settings: Settings) -> DataFrame:
    """(query, ids, score) of the nearest seeds."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["query"].to_pylist()
            for rows, vectors in _by_width(batch["embedding"]):
                space, out = spaces.get(vectors.shape[1]), []
                if not space:
                    continue
                near, vectors = squared(unit(vectors), space.seeds), evened(vectors)
                few = min(settings.wanted, len(space.seeds))
                for i, best in enumerate(np.argpartition(near, few - 1, axis=1)[:, :few]):
                    for k, value in zip(best, cosines(space.seed_vectors[best], vectors[i])):
                        out.append({"query": names[rows[i]], "ids": space.seed_ids[k], "score": value})
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return queries.select("query", "embedding").mapInArrow(score, "query long, ids array<long>, score double")


_FOUND = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of rows with a query, row by row, so that the block a row stands in doesn't show in the last bit."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


# --- the scan --------------------------------------------------------------------------------------------------------

#: Above the rounding of 32-bit coordinates of vectors of length 1.
SLACK = 1e-5


def scan(query: list[np.ndarray], blocks: list[np.ndarray], near: float, settings: Settings) -> tuple[np.ndarray, int]:
    """Numbers of the entries that may be within the ``wanted`` nearest, and how many coordinates were read.

    ``blocks`` hold a column block each, a row a coordinate; distances grow block by block over the entries left.
    """
    total = sum(len(block) for block in blocks)
    alive, partial, seen, read = np.arange(blocks[0].shape[1]), np.zeros(blocks[0].shape[1], np.float32), 0, 0
    for block, part in zip(blocks, query):
        apart = (block if len(alive) == block.shape[1] else block[:, alive]) - part[:, None]
        partial = partial + np.einsum("ij,ij->j", apart, apart)
        read += apart.size
        seen += len(block)
        if seen == len(block) and len(alive) > 4 * settings.wanted:  # the most promising ones give a distance at once
            first = np.argpartition(partial, settings.wanted - 1)[: settings.wanted]
            whole = sum(((b[:, first] - p[:, None]) ** 2).sum(0) for b, p in zip(blocks, query))
            near = min(near, float(whole.max()) + SLACK)
        stretch = (1 + settings.epsilon / math.sqrt(seen)) ** 2 if seen < total else 1.0
        stay = partial * (total / seen) <= near * stretch + SLACK
        alive, partial = alive[stay], partial[stay]
        if not len(alive):
            break
    return alive, read


def _blocks(columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Column blocks of some rows: for each, coordinates by rows."""
    rows = columns.to_pylist()
    return [np.ascontiguousarray(np.frombuffer(b"".join(row[k] for row in rows), np.float32).reshape(len(rows), -1).T) for k in range(len(rows[0]))]


def _scanner(settings: Settings):
    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        width = len(entries["embedding"][0])
        ours, theirs = (t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for t in (entries, queries))
        ours, theirs = evened(ours), evened(theirs)
        blocks, asked = _blocks(entries["columns"]), _blocks(queries["columns"])
        first = np.array([ids[0].as_py() for ids in entries["ids"]])
        near, names = queries["near"].to_numpy(), queries["query"].to_pylist()
        of_query, of_entry, scores = [], [], []
        for i, name in enumerate(names):
            rows, _ = scan([part[:, i] for part in asked], blocks, near[i], settings)
            if len(rows):
                score = cosines(ours[rows], theirs[i])
                best = np.lexsort((first[rows], -score))[: settings.wanted]
                of_query += [name] * len(best)
                of_entry += list(rows[best])
                scores += list(score[best])
        ids = entries["ids"].combine_chunks().take(pa.array(of_entry, pa.int64()))
        return pa.Table.from_arrays([pa.array(of_query, pa.int64()), ids, pa.array(scores, pa.float64())], schema=_FOUND)

    return search


def _dealt(index: DataFrame, asked: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks of each list. The counts have a row a list, at most ``most_lists`` a sampled space and one for others."""
    sizes = index.groupBy("width", "list").agg(F.ceil(F.count("*") / settings.block).alias("blocks"))
    wanted = asked.groupBy("width", "list").agg(F.ceil(F.count("*") / settings.queries).alias("groups"))
    cut = durable(sizes.join(wanted, ["width", "list"]), "lists")
    entries = index.join(cut, ["width", "list"]).withColumn("block", F.pmod(F.xxhash64("embedding"), F.col("blocks")))
    entries = entries.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    queries = asked.join(cut, ["width", "list"]).withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ("width", "list", "block", "group")
    return entries.select(*keys, "ids", "embedding", "columns"), queries.select(*keys, "query", "embedding", "columns", "near")


def nearest(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the contract's rows."""
    rows = durable(valid(embeddings), "vectors")
    entries = durable(entries_of(rows, settings), "entries")
    asking = rows.filter(F.col("vec_id") % settings.every == 0)
    distinct = durable(asking.groupBy("embedding").agg(F.min("vec_id").alias("query")), "queries")
    spaces = fit(entries, settings)
    index, asked = durable(indexed(entries, spaces, settings), "index"), durable(routed(distinct, spaces, settings), "routes")
    left, right = _dealt(index, asked, settings)
    keys = ("width", "list", "block", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scanner(settings), "query long, ids array<long>, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.unionByName(seeded(distinct, spaces, settings)).select("query", F.explode("ids").alias("vec_id"), "score")
    best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    best = best.filter(F.col("rank") <= settings.wanted).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"),
    )
    answers = distinct.join(best, "query").select("embedding", "best")
    own = asking.select(F.col("vec_id").alias("query_id"), "embedding").join(answers, "embedding")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, settings.neighbours)
    ranked = own.select("query_id", F.posexplode(others).alias("place", "b"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
