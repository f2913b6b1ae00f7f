"""Toxicity: a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

Kernel. Two strings are alike as far as they share three letters in the same
order, up to ``gap`` other characters between neighbours; each other character
costs the factor ``decay`` on either side. So ``idiot``, ``id1iot`` and
``i-d-i-o-t`` are close. The value is divided by what the letters of a string
could reach at most, so long strings do not win by length.

Strings are the units of a sentence: its words, a run of single characters
counting as one word, its runs of two to ``RUN`` words, and the sentence itself.
Blanks are other characters like any, so triples go across words. The score of a
sentence is that of its worst unit, that of a document the score of its worst
sentence. Only the document is labelled: every unit of a clean document is clean,
and of a toxic one the units that look toxic count as toxic; which these are is
decided anew after each fit.

Landmarks are units of the training sentences: those that set toxic from clean
documents apart, longer ones only if their parts do so less, and frequent clean
ones. On the Nystroem features of a unit a linear machine is fitted. Because the
kernel is a product over letter triples, machine and landmarks fold into one
table of triples, and a text is scored by looking up its triples, in blocks of
bounded size. A sentence of fewer than three letters has no triple.

An empty or null text has no word and gets the lowest score of all; without
labels of both kinds every score is 0. Rows are judged one by one; those without
doc_id are scored like others and never learned from.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textblocks
from pulsegrid.llm.common import first_by_hash
from pulsegrid.session import durable

def _letters() -> np.ndarray:
    """By code point: 0 no letter, 1-26 a-z, else the code point of the lower-case letter or mark."""
    out = np.zeros(0x20000, np.int32)
    for point in range(len(out)):
        char = chr(point)
        if char.isalpha() or unicodedata.category(char)[0] == "M":
            out[point] = ord(char.lower()[0])
    out[97:123] = out[65:91] = np.arange(1, 27)
    return out


LETTER = _letters()
BASE = 27
#: Places of the table of triples: those of a-z come first, each with its own; triples with other letters are hashed to the rest.
PLACES = 1 << 17

#: Words of the longest unit below a whole sentence. A triple spans seven characters, so four words at most.
RUN = 4
ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True


@dataclass(frozen=True)
class Settings:
    """The machine is fitted on a bounded sample: at most ``sample_docs`` labelled documents of each label, in the order of
    a hash of their id; of a text longer than ``sample_characters``, passages evenly spread over all of it; and ``clean_words`` of
    their words and as many of their longer units. Probabilities are calibrated on the same documents' whole texts. ``landmarks``: units of
    either kind; toxic ones have at least the share ``least_strength`` of the strongest one's strength, and longer units stand in
    ``least_documents`` toxic documents. A toxic document whose units are all less than ``least_likeness`` like a toxic landmark
    is left out of the first fit."""

    sample_docs: int = 800
    sample_characters: int = 20_000
    landmarks: int = 64
    gap: int = 2
    decay: float = 0.6
    longest_word: int = 60
    clean_words: int = 16_000
    least_strength: float = 0.2
    least_likeness: float = 0.6
    least_documents: int = 3
    rounds: int = 5
    penalty: float = 1e-5
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """table: weight of each letter triple; slope and shift turn the score of the worst unit into a probability."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float
    settings: Settings


def held_out(fold: int = 1, folds: int = 3) -> Column:
    """Rows whose labels are never used: crc32 of the id as text, modulo ``folds``, is ``fold``. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter of every character of UTF-8 bytes, and the byte where it begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int32)
    if len(at) < len(data):
        for least, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            of = np.flatnonzero((point >= least) & (point < (0x100 if more == 3 else least + (0x20 >> (more - 1)))) & (data[at] >= 0xC0))
            value = point[of] & bits
            for k in range(1, more + 1):
                value = (value << 6) | (data[at[of] + k] & 0x3F)
            point[of] = -value  # below 0, so that no later round takes it for a first byte
        point = np.abs(point)
    letter = LETTER[np.minimum(point, len(LETTER) - 1)]
    return np.where(point < len(LETTER), letter, np.where(point < 0x40000, point, 0)), at  # planes 2 and 3 are ideographs


def place_of(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place of each triple of letters in the table."""
    place = (x * BASE + y) * BASE + z
    other = np.flatnonzero((x >= BASE) | (y >= BASE) | (z >= BASE))
    if len(other):
        x, y, z = (a[other].astype(np.uint64) for a in (x, y, z))
        hashed = textblocks.mix((x << np.uint64(42)) | (y << np.uint64(21)) | z)
        place[other] = BASE**3 + (hashed % np.uint64(PLACES - BASE**3)).astype(np.int64)
    return place


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of every character (of a blank, that of the word before it), and per word the number of its sentence and its row.

    Runs of single characters are one word. A sentence ends with a word that ends in a full stop, exclamation or question
    mark, with a line, and with the row.
    """
    start, end, first = textblocks.words(data, offsets)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    single = lead[end] - lead[start] == 1
    joins = np.zeros(len(start), bool)  # this word goes on with the one before
    joins[1:] = single[1:] & single[:-1] & (start[1:] - end[:-1] == 1)
    first = first[:-1][first[:-1] < len(start)]
    joins[first] = False
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    joins[1:] &= (lines[start[1:]] == lines[end[:-1]]) & ~ENDS[data[end[:-1] - 1]]
    opens = np.zeros(len(start), bool)  # this word begins a sentence
    opens[1:] = (lines[start[1:]] > lines[end[:-1]]) | ENDS[data[end[:-1] - 1]]
    opens[first] = True
    begin = np.zeros(lead[-1], np.int32)
    begin[lead[start[~joins]]] = 1
    row = np.searchsorted(offsets[1:], start[~joins], side="right")
    return np.cumsum(begin, dtype=np.int32) - 1, (np.cumsum(opens) - 1)[~joins], row


def triples(codes: np.ndarray, owner: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, int, float]]:
    """For each pair of gaps: the places where a triple of letters of one owner begins, its code, its reach, its weight."""
    n = len(codes)
    letter = (codes > 0) & (owner >= 0)
    wide = codes.astype(np.int64)
    for a in range(1, settings.gap + 2):
        for b in range(1, settings.gap + 2):
            reach = a + b
            if n <= reach:
                continue
            good = letter[:-reach] & letter[a : n - b] & letter[reach:] & (owner[:-reach] == owner[reach:])
            at = np.flatnonzero(good)
            yield at, place_of(wide[at], wide[at + a], wide[at + reach]), reach, settings.decay ** (reach - 2)


def row_scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have words, and the score of the worst unit of each: the sum of its triples' weights over its norm."""
    word, sentence, row = word_bounds(data, offsets)
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    codes, _ = characters(data)
    owner = np.where(word >= 0, sentence[word], -1)
    total, norm = np.zeros((RUN, n + RUN)), np.zeros((RUN, n + RUN))  # by words that a triple goes beyond its first
    for at, code, reach, weight in triples(codes, owner, settings):
        key = np.minimum(word[at + reach] - word[at], RUN - 1) * np.int64(n + RUN) + word[at]
        total += weight * np.bincount(key, table[code], total.size).reshape(total.shape)
        norm += weight**2 * np.bincount(key, minlength=norm.size).reshape(norm.shape)
    np.cumsum(total, axis=0, out=total)
    np.cumsum(norm, axis=0, out=norm)
    value = lambda t, m: t / np.sqrt(np.maximum(m, 1e-12))
    begins = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    best = value(total[0, :n], norm[0, :n])
    whole = value(np.add.reduceat(total[-1, :n], begins), np.add.reduceat(norm[-1, :n], begins))
    best[begins] = np.maximum(best[begins], whole)
    one, two = total[0], norm[0]  # sums of the runs that begin at each word
    for size in range(2, RUN + 1):
        one, two = total[size - 1] + np.r_[one[1:], 0], norm[size - 1] + np.r_[two[1:], 0]
        inside = np.flatnonzero(sentence[size - 1 :] == sentence[: n - size + 1]) if n >= size else np.zeros(0, int)
        best[inside] = np.maximum(best[inside], value(one[inside], two[inside]))
    rows = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return row[rows], np.maximum.reduceat(best, rows)


@dataclass(frozen=True)
class Landmarks:
    """Normalised triple weights of each landmark (a row), at the places of the table that any of them uses."""

    places: np.ndarray
    weights: np.ndarray

    def first(self, count: int) -> Landmarks:
        return Landmarks(self.places, self.weights[:count])


def landmark_table(units: list[str], settings: Settings) -> Landmarks:
    """Looked up by a text's triples, a row is the kernel with that unit."""
    found = []
    for unit in units:
        codes, _ = characters(np.frombuffer(unit.encode(), np.uint8))
        parts = [(code, np.full(len(code), weight)) for _, code, _, weight in triples(codes, np.zeros(len(codes), np.int32), settings)]
        code, weight = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        found.append((code, weight / np.sqrt(max((weight**2).sum(), 1e-12))))
    places = np.unique(np.concatenate([code for code, _ in found]))
    weights = np.zeros((len(units), len(places)), np.float32)
    for row, (code, weight) in zip(weights, found, strict=True):
        np.add.at(row, np.searchsorted(places, code), weight)
    return Landmarks(places, weights)


def kernel(units: list[str], landmarks: Landmarks, settings: Settings) -> np.ndarray:
    """Kernel values of units with every landmark."""
    place = np.full(PLACES, -1, np.int32)
    place[landmarks.places] = np.arange(len(landmarks.places))
    by_code = np.ascontiguousarray(landmarks.weights.T)
    many = len(landmarks.weights)
    parts = [np.zeros((0, many), np.float32)]
    for i in range(0, len(units), 5000):
        encoded = units[i : i + 5000]
        codes, _ = characters(np.frombuffer("".join(encoded).encode(), np.uint8))
        owner = np.repeat(np.arange(len(encoded), dtype=np.int32), [len(u) for u in encoded])
        out, norm = np.zeros((len(encoded), many), np.float32), np.zeros(len(encoded))
        for at, code, _, weight in triples(codes, owner, settings):
            unit, code = owner[at], place[code]
            norm += weight**2 * np.bincount(unit, minlength=len(encoded))
            unit, code = unit[code >= 0], code[code >= 0]
            for k in range(0, len(unit), 100_000):  # a bounded number of landmark rows at once
                u, c = unit[k : k + 100_000], code[k : k + 100_000]
                begins = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                out[u[begins]] += weight * np.add.reduceat(by_code[c], begins, axis=0)
        parts.append(out / np.sqrt(np.maximum(norm, 1e-12))[:, None].astype(np.float32))
    return np.vstack(parts)


def tidy(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*#$%&|_-")


SENTENCE = re.compile(r"(?<=[.!?])[ \t\v\f\r]+|\n+")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower-cased; runs of single characters are one word."""
    found = []
    for part in SENTENCE.split(text.lower()):
        words = re.sub(r"(?<!\S)(\S)((?: \S(?!\S))+)", lambda m: m[1] + m[2].replace(" ", ""), part).split()
        words = [w for w in map(tidy, words) if w]
        if words:
            found.append(words)
    return found


def spread(text: str, most: int, words: int = 40) -> str:
    """A text of at most ``most`` characters; of a longer one, passages (sentences, long ones cut) evenly spread over it."""
    if len(text) <= most:
        return text
    passages = [part[i : i + words] for part in map(str.split, SENTENCE.split(text)) for i in range(0, len(part), words)]
    passages = [" ".join(p)[:most] for p in passages]
    ends = np.cumsum([len(p) + 1 for p in passages])
    share = most / ends[-1]
    taken = np.floor(ends * share / (8 * words))  # one passage whenever its share of about 320 characters is full
    return "\n".join(p for p, now, before in zip(passages, taken, np.r_[0, taken[:-1]]) if now > before)[:most]


def sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic) to learn from: the first of either label by a hash of the id, none of them held out, whole texts.

    A label that stands twice is toxic if either is; of several texts of an id the least is taken.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = durable(first_by_hash(known, "toxic", settings.sample_docs).select("doc_id", "toxic"), "sample")
    rows = documents.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_docs ids
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


@dataclass(frozen=True)
class Units:
    """All units of one size of the sample, the places where they begin: unit number, document, and strength by number."""

    size: int  # words; 0: a sentence longer than RUN
    begin: np.ndarray
    end: np.ndarray
    number: np.ndarray
    document: np.ndarray
    clean_documents: np.ndarray
    toxic_documents: np.ndarray
    strength: np.ndarray
    bad: np.ndarray


def split_units(ids: np.ndarray, sentence: np.ndarray, document: np.ndarray, toxic: np.ndarray, settings: Settings) -> list[Units]:
    """The units of each size. Bad are those found several times as often in toxic documents as in clean ones; a longer one
    only if it is more than twice as strong as each of its parts, as the part carries the evidence otherwise.

    Some labels may be wrong, so a bad unit may point to toxic documents and still stand in some that are called clean.
    """
    n = np.maximum(np.bincount(toxic, minlength=2), 1)
    bounds = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1], True])
    hashes = textblocks.mix(ids.astype(np.uint64) + np.uint64(1))
    key, found, best = hashes, [], np.zeros(len(ids))  # best: strength of the strongest part of the unit that begins here
    for size in (*range(1, RUN + 1), 0):
        if size:
            if size > 1:
                key = textblocks.mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[size - 1 :])
                best = np.maximum(best[:-1], best[1:])
            begin = np.flatnonzero(sentence[: len(key)] == sentence[size - 1 :])
            end, keys, parts = begin + size, key[begin], best[begin]
        else:
            long = np.diff(bounds) > RUN
            begin, end = bounds[:-1][long], bounds[1:][long]
            place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
            sums = np.cumsum(np.r_[np.uint64(0), textblocks.mix(hashes + place.astype(np.uint64))], dtype=np.uint64)
            keys, parts = sums[end] - sums[begin], np.array([best[a : b - RUN + 1].max() for a, b in zip(begin, end, strict=True)])
        if not len(begin):
            break
        _, number = np.unique(keys, return_inverse=True)
        total, where = number.max() + 1, document[begin]
        pair = np.unique(number.astype(np.int64) * len(toxic) + where)
        by = [np.bincount(pair[toxic[pair % len(toxic)] == y] // len(toxic), minlength=total) for y in (0, 1)]
        odds = np.log((by[1] + 0.1) / n[1]) - np.log((by[0] + 0.1) / n[0])
        bad = (odds > np.log(4)) & (by[1] > 0)
        strength = np.where(bad, odds * np.sqrt(by[1]), 0.0)
        if size != 1:
            stronger = np.zeros(total)
            np.maximum.at(stronger, number, parts)
            bad &= (strength > 2 * stronger) & (by[1] >= settings.least_documents)
        found.append(Units(size, begin, end, number, where, by[0], by[1], strength, bad))
        if size:
            best = best.copy()
            best[begin] = np.maximum(best[begin], strength[number])
    return found


def train(texts: list[str], toxic: np.ndarray, settings: Settings) -> tuple[np.ndarray, float] | None:
    """Table and bias of the machine; None if there are not labels of both kinds, or nothing sets them apart."""
    vocabulary: dict[str, int] = {}
    split = [[[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in sentences(t)] for t in texts]
    some = np.array([bool(b) for b in split], bool)
    if len(set(toxic[some].tolist())) < 2:
        return None
    lengths = np.array([len(x) for b in split for x in b])
    ids = np.concatenate([np.array(x, np.int32) for b in split for x in b])
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    document = np.repeat(np.arange(len(split)), [sum(map(len, b)) for b in split])
    del split
    vocabulary = list(vocabulary)
    all_units = split_units(ids, sentence, document, toxic, settings)
    sized = np.array([len(w) for w in vocabulary])
    strongest: dict[str, float] = {}
    bad_places: list[tuple[Units, dict[int, str]]] = []
    clean_lists: list[list[str]] = []
    for units in all_units:
        total = len(units.bad)
        first = np.zeros(total, np.int64)
        first[units.number[::-1]] = np.arange(len(units.number))[::-1]  # the first place of every unit
        name = lambda k, u=units, f=first: " ".join(vocabulary[i] for i in ids[u.begin[f[k]] : u.end[f[k]]])
        usable = np.ones(total, bool)
        if units.size == 1:
            letters = sized[ids[units.begin[first]]]
            usable = (letters >= 3) & (letters <= settings.longest_word)
        names = {int(k): name(k) for k in np.flatnonzero(units.bad & usable)}
        strongest.update({w: float(units.strength[k]) for k, w in names.items()})
        bad_places.append((units, names))
        good = np.flatnonzero(~units.bad & usable & (units.clean_documents > 0))
        good = good[np.lexsort((first[good], -units.clean_documents[good]))]
        most = settings.clean_words if units.size == 1 else settings.clean_words // RUN
        rest = good[most // 2 :]
        rest = rest[np.random.default_rng(0).permutation(len(rest))[: most // 2]]
        clean_lists.append([name(k) for k in np.r_[good[: most // 2], rest]])
    ranked = sorted(strongest, key=lambda w: (-strongest[w], w))
    if not ranked:
        return None
    bad_words = [w for w in ranked if strongest[w] >= settings.least_strength * strongest[ranked[0]]][: settings.landmarks]
    clean = list(dict.fromkeys(w for part in clean_lists for w in part))
    clean_words = [w for part in clean_lists for w in part[: settings.landmarks // 2 if part is clean_lists[0] else settings.landmarks // (2 * RUN)]]
    landmarks = landmark_table(bad_words + clean_words, settings)
    values, vectors = np.linalg.eigh(kernel(bad_words + clean_words, landmarks, settings).astype(float))
    keep = values > 1e-6
    project = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # kernel values -> Nystroem features

    # a unit with next to no likeness to a toxic landmark is never taken for a toxic one, so its features are not kept
    ranked.sort()
    near = [np.flatnonzero(kernel(ranked[i : i + 5000], landmarks.first(len(bad_words)), settings).max(1) >= 0.3) + i for i in range(0, len(ranked), 5000)]
    pool = [ranked[i] for part in near for i in part]
    if not clean or not pool:
        return None
    place = {w: i for i, w in enumerate(pool)}
    groups: dict[int, set[int]] = {}
    for units, names in bad_places:
        at = np.full(len(units.bad), -1)
        for k, w in names.items():
            at[k] = place.get(w, -1)
        at = at[units.number]
        for d, k in set(zip(units.document[at >= 0].tolist(), at[at >= 0].tolist(), strict=True)):
            if toxic[d]:
                groups.setdefault(d, set()).add(k)
    members = [np.array(sorted(groups[d]), int) for d in sorted(groups)]
    clean_k, pool_k = kernel(clean, landmarks, settings), kernel(pool, landmarks, settings)
    clean_x, pool_x = clean_k @ project, pool_k @ project
    guess, least = pool_k[:, : len(bad_words)].max(1), settings.least_likeness  # at first: likeness to a toxic landmark
    weights, bias = np.zeros(project.shape[1]), 0.0
    active = np.arange(len(clean)) % 4 == 0
    for _ in range(settings.rounds):
        witness = np.concatenate([m[guess[m] >= least] for m in members])  # a toxic document without such a word teaches nothing
        if not len(witness):
            break
        x = np.vstack([clean_x[active], pool_x[witness]])
        weights, bias = _machine(x, np.r_[-np.ones(int(active.sum())), np.ones(len(witness))], settings)
        guess, least = pool_x @ weights + bias, 0.0
        active |= clean_x @ weights + bias > -1  # clean units inside the margin join the next fit
    table = np.zeros(PLACES, np.float32)
    table[landmarks.places] = (project @ weights) @ landmarks.weights
    return table, float(bias)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """None if there are not labels of both kinds. The bounded sample is learned from in one task; the driver gets the table of
    triples, and the sampled documents' scores for the calibration."""
    taken = durable(sample(documents, labels, settings), "sample")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a text at a time
                text = spread(batch["text"][row].as_py(), settings.sample_characters)
                one = slice(row, row + 1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][one], pa.array([text]), batch["toxic"][one]], names=["doc_id", "text", "toxic"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "toxic"))))
        found = train([text for _, text, _ in rows], np.array([y for _, _, y in rows], int), settings) if rows else None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([found[0].tobytes()]), pa.array([found[1]])], names=["weights", "bias"])

    short = taken.mapInArrow(shorten, "doc_id long, text string, toxic int")
    learned = short.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not learned:
        return None
    table, bias = np.frombuffer(learned[0]["weights"], np.float32), learned[0]["bias"]

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_worst(batch["text"], table, bias, settings)), batch["toxic"]], names=["doc_id", "worst", "toxic"])

    rows = sorted(taken.mapInArrow(worst, "doc_id long, worst double, toxic int").collect())
    rows = [r for r in rows if r["worst"] > -1.0 - abs(bias)]  # those with words
    slope, shift = _calibrate(np.array([r["worst"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return Model(table, bias, slope, shift, settings)


def _machine(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes of equal weight, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    # a clean document has hundreds of words, each of which may set off a false alarm, so clean words weigh more
    cost = np.where(y > 0, 0.1 / max((y > 0).sum(), 1), 0.9 / max((y < 0).sum(), 1)).astype(np.float32)
    bound = 2 * np.linalg.norm((x * cost[:, None]).T @ x, 2) + settings.penalty
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(200):
        lack = np.maximum(0, 1 - y * (x @ v))
        step = v - (settings.penalty * v - 2 * x.T @ (cost * y * lack)) / bound
        v, w = step + k / (k + 3) * (step - w), step
    return w[:-1].astype(np.float64), float(w[-1])


def _calibrate(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the scores, with the usual softened targets. Scores far beyond the toxic margin, 1, count as 1.5,
    so that documents with the whole of a phrase do not make its words alone look clean."""
    scores = np.minimum(scores, 1.5)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * scores + shift, -30, 30)))
        gradient = np.array([np.sum((p - target) * scores), np.sum(p - target)])
        s = p * (1 - p)
        curve = np.array([[np.sum(s * scores**2), np.sum(s * scores)], [np.sum(s * scores), np.sum(s)]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        slope, shift = slope - float(np.clip(move[0], -2, 2)), shift - float(np.clip(move[1], -2, 2))
    return max(slope, 1e-3), shift


def _worst(texts: pa.Array, table: np.ndarray, bias: float, settings: Settings) -> np.ndarray:
    """Score of the worst unit of every text; a text without words has the lowest, that of no likeness at all."""
    out = np.full(len(texts), -1.0 - abs(bias))
    for first, data, offsets in textblocks.blocks(texts, 1 << 20):
        row, scores = row_scores(data, offsets, table, settings)
        out[first + row] = scores + bias
    return out


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if model is not None:
                worst = _worst(batch["text"], model.table, model.bias, model.settings)
                score = 1 / (1 + np.exp(-np.clip(model.slope * worst + model.shift, -30, 30)))
            least = model.settings.threshold if model else 1.0
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in columns], pa.array(score), pa.array((score >= least).astype(np.int32))], names=[*columns, "score", "predicted"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def report(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return predict(documents, fit(documents, labels, settings))
