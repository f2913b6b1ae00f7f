"""Best-fit packing with conflicts: documents into sequences of fixed length.

A bin never holds two documents of one source or of one cluster of copies. A
document longer than a bin is cut: full pieces fill bins alone, the rest is
packed like any document. Pieces are dealt by a hash of their id to shards of
bounded size, each packed in one task: longest first, into the bin with the
least room that still holds the piece and carries neither its source nor its
cluster (the search goes on from bin to bin in the order of their room), else
into a new one.

A cluster is a component of near-duplicates where the caller knows it, else the
documents with the same words, letter case aside. Null sources conflict with
nothing; a null or empty text has no words, makes no piece and is reported with
a null bin. Repeated rows are pieces of one cluster, so they go to different
bins; they are counted before they are dealt, and each copy by its number, so
neither the layout of the files nor a row that a third of all rows repeat decides
a shard. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textblocks
from pulsegrid.session import durable


@dataclass(frozen=True)
class Settings:
    """capacity: words in a bin; shard: pieces packed together, on average."""

    capacity: int = 2048
    shard: int = 5000


def pieces(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, cluster, piece, first_word, length; one row of length 0 for a text without words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textblocks.blocks(batch["text"]):
                data = textblocks.LOWER[data]
                start, end, rows = textblocks.words(data, offsets)
                hashes = textblocks.word_hashes(data, start, end)
                counts = np.diff(rows)
                place = np.arange(len(hashes)) - np.repeat(rows[:-1], counts)
                cluster = np.zeros(len(counts), np.uint64)
                some = np.flatnonzero(counts)
                if len(some):
                    cluster[some] = np.add.reduceat(textblocks.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), rows[:-1][some])
                parts = np.maximum(1, -(-counts // settings.capacity))
                row = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = piece * settings.capacity
                length = np.minimum(counts[row] - begin, settings.capacity)
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].cast(pa.int64()).take(at), batch["source"].take(at), pa.array(cluster.view(np.int64)[row]),
                    pa.array(piece), pa.array(begin), pa.array(length),
                ], names=["doc_id", "source", "cluster", "piece", "first_word", "length"])

    schema = "doc_id long, source string, cluster long, piece long, first_word long, length long"
    return documents.select("doc_id", F.col("source").cast("string"), "text").mapInArrow(cut, schema)


def fill(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, pieces in the order given; sources and clusters as numbers, -1 for none."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (length, -1))
        while at < len(room) and (source_bits[room[at][1]] & source_bit or cluster_bits[room[at][1]] & cluster_bit):
            at += 1
        if at < len(room):
            left, where = room.pop(at)
        else:
            left, where = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[where] |= source_bit
        cluster_bits[where] |= cluster_bit
        bins.append(where)
        offsets.append(capacity - left)
        if left > length:
            insort(room, (left - length, where))
    return bins, offsets


#: Copies of a row that are numbered together.
COPIES = 1_000


def numbered(rows: DataFrame) -> DataFrame:
    """Every row with a number among the rows that are the same in all columns."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES).cast("long"))))
    last = F.least(F.col("_n"), (F.col("_block") + 1) * COPIES) - 1
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("_block") * COPIES, last))).drop("_n", "_block")


def pack(documents: DataFrame, settings: Settings = Settings(), clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, length, bin and offset (null for texts without words).

    ``bin`` names the shard in its upper half. ``clusters`` (doc_id, component_id) names groups of near-duplicates; of
    rows without one there the words decide.
    """
    rows = pieces(documents, settings)
    if clusters is not None:
        known = clusters.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        rows = rows.join(known, "doc_id", "left").withColumn("cluster", F.when(F.col("component_id").isNotNull(), F.xxhash64("component_id", F.lit("component"))).otherwise(F.col("cluster")))
        rows = rows.drop("component_id")
    rows = durable(rows, "pieces")
    some = numbered(rows.filter(F.col("length") > 0))
    shards = max(1, math.ceil(rows.filter(F.col("length") > 0).count() / settings.shard))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "length", "copy"), F.lit(shards)).cast("int")

    def packed(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("copy", "ascending")]
        table = table.sort_by(order)

        def numbers(column: str, once: bool) -> list[int]:
            codes = table[column].combine_chunks().dictionary_encode()
            values = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy().astype(np.int64)
            if once:  # what occurs once conflicts with nothing
                values[(values >= 0) & (np.bincount(values[values >= 0], minlength=1)[values] == 1)] = -1
                _, values[values >= 0] = np.unique(values[values >= 0], return_inverse=True)
            return values.tolist()

        bins, offsets = fill(table["length"].to_pylist(), numbers("source", True), numbers("cluster", True), settings.capacity)
        base = (table["shard"][0].as_py() << 32) if table.num_rows else 0
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"], "first_word": table["first_word"], "length": table["length"],
            "bin": pa.array([base + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64()),
        })

    schema = "doc_id long, piece long, first_word long, length long, bin long, offset long"
    placed = some.withColumn("shard", shard).groupBy("shard").applyInArrow(packed, schema)
    none = rows.filter(F.col("length") == 0).select(
        "doc_id", "piece", "first_word", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"),
    )
    return placed.unionByName(none)
