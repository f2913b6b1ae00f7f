"""Benchmark decontamination: items found in documents up to a share of edited words.

An item is cut into overlapping segments, and a document has a window of the
same number of words at every word. A CGK random walk turns such a window into
a string of symbols: at each step it notes the word it stands on and moves on
or stays, as a random bit for (step, word) says. Few edits between two windows
become few differing symbols. Each table notes some symbols, drawn at random
places of the walk; windows and segments that agree in a table are candidates.
A candidate is verified on the whole item: the least edit distance (in words)
between the item and any passage around the place must be at most
``edits`` times its words.

Segments stand in for windows of the whole item: a walk over a long item meets
all its edits, one over a segment only those inside it, and one segment that
agrees is enough, as the whole item is verified.

A window with few words of the items' vocabulary is not walked: a segment with
its share of the item's edits keeps more. (Edits that crowd into one segment may
keep it from being walked, but then the item's others have fewer.) Every
candidate is verified; places already covered by a match of the item are not
verified again. Items are used in slices of bounded size, one pass over the
documents each, so the items a task holds are bounded.

Words are runs of non-blanks, A-Z lower-cased. Null or empty items and texts
match nothing; null ids are reported as null; repeated rows are reported alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textblocks


@dataclass(frozen=True)
class Settings:
    """edits: largest distance, as a share of the item's words. walks and tables (per walk): a segment with two edits in
    sixteen words agrees in one of the twelve tables with probability over 0.9, and an item has a segment every ``stride``
    words; shorter segments, which may be all of an item, get ``short_walks`` more. slice_bytes: text of the items used in one pass."""

    edits: float = 0.15
    segment: int = 16
    stride: int = 8
    walks: int = 4
    short_walks: int = 2
    tables: int = 3
    slice_bytes: int = 32 << 20


@dataclass(frozen=True)
class Shape:
    """One kind of window: its words, the steps walked and the places noted in each table."""

    words: int
    steps: int
    places: np.ndarray  # tables x symbols
    walks: int


def shape(words: int, settings: Settings) -> Shape:
    """Windows of up to three words are taken as they are; longer ones are walked for a quarter more steps than words."""
    steps = words if words < 4 else words + words // 4
    noted = min(words, 6)
    draw = np.random.default_rng(words)
    walks = 1 if words < 4 else settings.walks if words >= settings.segment else settings.walks + settings.short_walks
    return Shape(words, steps, np.array([np.sort(draw.permutation(steps)[:noted]) for _ in range(settings.tables)]), walks)


def walk(symbols: np.ndarray, at: np.ndarray, ends: np.ndarray, form: Shape, seed: int) -> np.ndarray:
    """One key per table for the window beginning at each place; beyond its row's end a window reads zeros."""
    bits = textblocks.mix(symbols ^ np.uint64(0x5851F42D4C957F2D * (seed + 1) & 0xFFFFFFFFFFFFFFFF))
    keys = np.zeros((len(form.places), len(at)), np.uint64)
    pointer = at.copy()
    for step in range(form.steps):
        inside = pointer < ends
        safe = np.minimum(pointer, len(symbols) - 1)
        noted = (form.places == step).any(1)
        if noted.any():
            symbol = np.where(inside, symbols[safe], np.uint64(0))
            for table in np.flatnonzero(noted):
                keys[table] = textblocks.mix(keys[table] * np.uint64(0x9E3779B97F4A7C15) + symbol)
        if form.words < 4:
            pointer = pointer + 1
        else:
            pointer = pointer + ((bits[safe] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
    return keys ^ textblocks.mix(np.arange(1, len(keys) + 1, dtype=np.uint64) + np.uint64(64 * seed))[:, None]


@dataclass(frozen=True)
class Index:
    """Items of one slice: ids, words, vocabulary, and by shape the sorted keys with the item and place of each."""

    ids: list[int | None]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    shapes: list[tuple[Shape, np.ndarray, np.ndarray, np.ndarray]]


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in textblocks.blocks(texts):
        data = textblocks.LOWER[data]
        start, end, rows = textblocks.words(data, offsets)
        yield first, textblocks.word_hashes(data, start, end), rows


def index(ids: list[int | None], texts: list[str], settings: Settings) -> Index:
    words: list[np.ndarray] = []
    for _, hashes, rows in _words(pa.array(texts, pa.string())):
        words += [hashes[rows[i] : rows[i + 1]] for i in range(len(rows) - 1)]
    some = [i for i, w in enumerate(words) if len(w)]
    ids, words = [ids[i] for i in some], [words[i] for i in some]
    lengths = np.array([len(w) for w in words], np.int64)
    all_words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    sizes = np.select([lengths >= settings.segment, lengths >= settings.segment // 2, lengths >= 4], [settings.segment, settings.segment // 2, 4], lengths)
    shapes = []
    for size in np.unique(sizes):
        form = shape(int(size), settings)
        item = np.flatnonzero(sizes == size)
        # places every stride words, and the last one
        many = (lengths[item] - size) // settings.stride + 1
        place = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * settings.stride
        pairs = np.unique(np.r_[np.c_[np.repeat(item, many), place], np.c_[item, lengths[item] - size]], axis=0)
        at, end = begin[pairs[:, 0]] + pairs[:, 1], (begin + lengths)[pairs[:, 0]]
        keys = np.concatenate([walk(all_words, at, end, form, seed) for seed in range(form.walks)]).ravel()
        order = np.argsort(keys, kind="stable")
        of = order % len(pairs)
        shapes.append((form, keys[order], pairs[of, 0], pairs[of, 1]))
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    return Index(ids, words, vocabulary, shapes)


def _known(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), bool)
    return vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes


def candidates(hashes: np.ndarray, rows: np.ndarray, items: Index, settings: Settings) -> set[tuple[int, int, int]]:
    """(row, item, place of the item's first word in the row) of windows that agree with a segment in some table."""
    found: set[tuple[int, int, int]] = set()
    inside = np.concatenate([[0], np.cumsum(_known(hashes, items.vocabulary))])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    ends = rows[1:][row]
    for form, keys, item_of, place_of in items.shapes:
        at = np.arange(len(hashes))
        # of a segment's words all but the edited ones stand in the window; an edit costs two at most
        least = form.words - 2 * int(np.ceil(settings.edits * form.words * 0.75)) if form.words >= 4 else form.words
        upto = np.minimum(at + form.words, ends)
        at = at[(inside[upto] - inside[at] >= least)]
        if not len(at):
            continue
        for seed in range(form.walks):
            for key in walk(hashes, at, ends[at], form, seed):
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for hit in np.flatnonzero(high > low):
                    for k in range(low[hit], high[hit]):
                        found.add((int(row[at[hit]]), int(item_of[k]), int(at[hit] - rows[row[at[hit]]] - place_of[k])))
    return found


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``text`` with the least word edit distance to the item; ties: the first end."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), steps.copy()
    for word in item:
        change = np.concatenate([[np.iinfo(np.int32).max], cost[:-1] + (text != word)])
        drop = cost + 1
        now = np.minimum(change, drop)
        start = np.where(change <= drop, np.concatenate([[0], begin[:-1]]), begin)
        packed = (now - steps) * (n + 2) + steps  # an insertion comes from the best place to the left
        origin = np.minimum.accumulate(packed) % (n + 2)
        cost, begin = now[origin] + steps - origin, start[origin]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(hashes: np.ndarray, rows: np.ndarray, items: Index, settings: Settings) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, distance) of verified passages, each place once."""
    covered: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for r, i, place in sorted(candidates(hashes, rows, items, settings)):
        item = items.words[i]
        allowed = int(settings.edits * len(item))
        text = hashes[rows[r] : rows[r + 1]]
        middle = place + len(item) // 2
        if any(a <= middle < b for a, b in covered[r, i]):
            continue
        reach = 2 * allowed + 2  # the place may be off by the edits before the segment, the passage by those after it
        low, high = max(0, place - reach), min(len(text), place + len(item) + reach)
        distance, start, end = best_passage(item, text[low:high])
        if distance <= allowed:
            covered[r, i].append((low + start, low + end))
            yield r, i, low + start, end - start, distance


def find(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per passage: doc_id, item_id, first_word, n_words and distance."""
    items = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + size // settings.slice_bytes
    schema = "doc_id long, item_id long, first_word long, n_words long, distance long"
    passes = []
    for k in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        known = index([r["item_id"] for r in rows], [r["text"] for r in rows], settings)

        def search(batches: Iterator[pa.RecordBatch], known: Index = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch["doc_id"].cast(pa.int64()), []
                for first, hashes, rows in _words(batch["text"]):
                    out += [(first + r, *rest) for r, *rest in matches(hashes, rows, known, settings)]
                if out:
                    at, item, start, count, distance = zip(*out, strict=True)
                    columns = [ids.take(pa.array(at)), pa.array([known.ids[i] for i in item], pa.int64())]
                    columns += [pa.array(c, pa.int64()) for c in (start, count, distance)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "n_words", "distance"])

        passes.append(documents.select("doc_id", "text").mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, passes)
