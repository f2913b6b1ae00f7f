"""Language identification by compression.

For each language a zstandard dictionary of raw content is made from a bounded
sample of labelled texts. A text, lower-cased and with a blank for all that is
no letter, is cut into pieces that are compressed with every dictionary; the
language whose dictionary gives the fewest bytes is chosen. Where the best two are close the choice is marked as rejected: the
prediction stands, with a low score.

A null text, or one without a letter, is ``und`` with score 0, as is every text
if nothing could be learned. Rows without id or language are not learned from.
Ties go to the language with most texts learned from, then to the first in
alphabetical order. Rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import first_by_hash

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """The classifier is fitted on a bounded sample: ``sample_docs`` texts per language, in the order of a hash of their
    id, up to ``dictionary_bytes`` in all, of at most ``languages`` languages (more are an error). ``piece_bytes`` are
    compressed at a time; texts below ``short_bytes`` at the level ``short_level``, where a byte more or less matters.
    A margin below ``least_margin`` is rejected."""

    sample_docs: int = 300
    dictionary_bytes: int = 400 << 10
    languages: int = 400
    piece_bytes: int = 8 << 10
    level: int = 3
    short_bytes: int = 2000
    short_level: int = 12
    least_margin: float = 0.01


NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return NO_LETTER.sub(" ", text.lower())


def held_out(fold: int = 2, folds: int = 4) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo ``folds``, is ``fold``. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def fit(documents: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionary content by language, most learned language first, from rows that are not held out."""
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(settings.languages + 1).collect()}
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages")
    chosen = first_by_hash(rows.select("doc_id", "lang"), "lang", settings.sample_docs)
    ids = sorted({r["doc_id"] for r in chosen.collect()})
    texts: dict[str, list[tuple[int, str]]] = {n: [] for n in counts}
    if ids:
        part = F.expr(f"decode(substring(encode(text, 'UTF-8'), 1, {settings.dictionary_bytes}), 'UTF-8')")
        for r in rows.filter(F.col("doc_id").isin(ids)).select("doc_id", "lang", part.alias("text")).collect():
            texts[r["lang"]].append((r["doc_id"], r["text"]))
    content = {n: letters("\n".join(t for _, t in sorted(texts[n]))).encode()[: settings.dictionary_bytes] for n in counts}
    return {n: content[n] for n in sorted(content, key=lambda n: (-counts[n], n)) if len(content[n]) >= 8}


def predict(documents: DataFrame, content: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: how much smaller the best coding is than the next) and ``rejected``."""
    names = list(content)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coders(level: int) -> list[zstandard.ZstdCompressor]:
            made = []
            for n in names:
                words = zstandard.ZstdCompressionDict(content[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_dict_id=False))
            return made

        usual, short = coders(settings.level), coders(settings.short_level)
        for batch in batches:
            found, scores, rejected = [], [], []
            for text in batch["text"]:
                text = text.as_py()
                if not names or text is None or not LETTER.search(text):
                    found.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                data = letters(text).encode()
                used = short if len(data) < settings.short_bytes else usual
                pieces = [data[i : i + settings.piece_bytes] for i in range(0, len(data), settings.piece_bytes)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in used])
                order = np.argsort(sizes, kind="stable")
                margin = 1.0 if len(names) == 1 else 1 - sizes[order[0]] / sizes[order[1]]
                found.append(names[order[0]])
                scores.append(float(1 - 2 ** (-margin / settings.least_margin)))
                rejected.append(bool(margin < settings.least_margin))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(classify, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return predict(documents, fit(documents, settings), settings)
