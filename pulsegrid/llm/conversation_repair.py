"""Conversation structure repair: the lightest derivation of every conversation, by Knuth's agenda.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. It is repaired by edits: Keep (0), Rerole
to user or assistant (3), Delete (4, required for blank and duplicate rows), Insert of an empty user or assistant row
(3); a truncated row that stays costs 3 more. Among the cheapest edits those whose initials are least win.

* **Items and rules.** An item ``(k, state)`` says that the first k rows can be repaired so that the output stands in
  that state (start, after s, after u, after a). Its rules take the item and one edit of row k, or an insertion, to
  another item. Over pieces of a long conversation the second antecedent is itself a derived item: the lightest
  ``(piece, from, to)``. Weights are pairs (cost, audit), added and appended. Two derivations of one item can't be a
  prefix of one another at equal cost, so appending keeps their order: the functions are superior, an item popped from
  the agenda is final, and the agenda ends when the goal is popped.
* **Long conversations.** Rows are range-partitioned and sorted by conversation and turn, without their texts. A task
  streams them and repairs the conversations that lie inside it; one that reaches the end of its partition, or is
  longer than ``piece`` rows, becomes pieces (lightest derivations between all pairs of states), merged 64 at a time.
  Only the audit, one character a row, ever stands in memory as a whole.
* **Texts** are streamed once, by conversation and turn, behind a row that holds the audit. A sha256 has to read a
  conversation's text in order, so its rows pass one task, in batches, whatever their number.

Defined results: nulls count as one space, in the damage key, the role and the text alike; rows of equal turn are
ordered by role, then by the sha256 of their text; a role that is empty or begins otherwise can't be kept; rows without
conv_id are one conversation. Conversations without rows after the damage have zeros, an empty audit and the hash of
the empty string. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import BLANKS
from pulsegrid.session import durable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
GOALS = (START, AFTER_A)
#: Where one more output row leads: state -> {initial: state}.
STEPS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
LEGAL = {"su", "ua", "au"}
SPOKEN = {"u": "user", "a": "assistant"}
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
Fault = str  # "b" blank, "d" duplicate, "t" truncated, "" none


# --- the agenda ------------------------------------------------------------------------------------------------------

def lightest(start: Iterable[tuple[Weight, tuple[int, int]]], rules: Callable[[int, int], Iterable[tuple[int, int, int, str]]],
             goals: set[tuple[int, int]], all_goals: bool = False) -> dict[tuple[int, int], Weight]:
    """Weights of the goal items derived: the lightest one alone, or all of them.

    ``rules(k, state)`` gives what follows from an item: (k, state, cost added, audit appended).
    """
    agenda = [(cost, audit, item) for (cost, audit), item in start]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    found: dict[tuple[int, int], Weight] = {}
    best: dict[tuple[int, int], Weight] = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        if item in goals:
            found[item] = (cost, audit)
            if not all_goals or len(found) == len(goals):
                break
        for k, state, more, letters in rules(*item):
            target, weight = (k, state), (cost + more, audit + letters)
            if target not in final and (target not in best or weight < best[target]):
                best[target] = weight
                heapq.heappush(agenda, (*weight, target))
    return found


def row_rules(initials: str, faults: list[Fault]) -> Callable[[int, int], Iterator[tuple[int, int, int, str]]]:
    """Rules over single rows; ``initials`` has one character a row."""
    rows = len(faults)

    def rules(k: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        steps = STEPS[state]
        for letter, to in steps.items():
            if letter != "s":
                yield k, to, INSERT, "I"
        if k == rows:
            return
        yield k + 1, state, DELETE, "D"
        fault = faults[k]
        if fault in ("b", "d"):
            return
        stays = TRUNCATED if fault == "t" else 0
        for letter, to in steps.items():
            if letter == initials[k]:
                yield k + 1, to, KEEP + stays, "K"
            elif letter != "s":
                yield k + 1, to, REROLE + stays, "R"

    return rules


def repair_plan(initials: str, faults: list[Fault]) -> Weight:
    """Cost and audit of the cheapest repair of a whole conversation."""
    rows = len(faults)
    found = lightest([((0, ""), (0, START))], row_rules(initials, faults), {(rows, goal) for goal in GOALS})
    return next(iter(found.values()))


Paths = dict[tuple[int, int], Weight]


def piece_paths(initials: str, faults: list[Fault]) -> Paths:
    """The lightest derivation from each state to each state over some rows of a conversation."""
    rows, rules, paths = len(faults), row_rules(initials, faults), {}
    goals = {(rows, state) for state in STATES}
    for origin in STATES:
        # start and after-s can't be reached again: those goals may stay open, and the agenda runs empty
        for (_, state), weight in lightest([((0, ""), (0, origin))], rules, goals, True).items():
            paths[origin, state] = weight
    return paths


def merged_paths(pieces: list[Paths]) -> Paths:
    """The same over consecutive pieces: rules with two antecedents, the way so far and one piece's derived item."""
    def rules(k: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        if k < len(pieces):
            for to in STATES:
                if (state, to) in pieces[k]:
                    yield k + 1, to, *pieces[k][state, to]

    goals, merged = {(len(pieces), state) for state in STATES}, {}
    for origin in STATES:
        for (_, state), weight in lightest([((0, ""), (0, origin))], rules, goals, True).items():
            merged[origin, state] = weight
    return merged


# --- rows and faults, with built-in functions ------------------------------------------------------------------------

def _told(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, copy) after the contract's damage."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _told("role").alias("role"),
        _told("text").alias("text"), (F.crc32(F.concat(_told("conv_id"), F.lit(":"), _told("turn"))) % 20).alias("damage"),
    ).filter(F.col("damage") != 0)
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"),
    )
    return digested(rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")))


def digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("text", 256))


def _turn_key() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))


ORDER = ("turn_key", "role", "digest")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows without texts: key columns, the role's initial, and the first fault.

    A duplicate is a row whose role and text stand at an earlier place of its conversation; the earliest place of each is
    an aggregate combined before its shuffle, so a text repeated in a third of all rows is no hot group. Of rows alike in
    every key the streaming pass tells the first from the others.
    """
    last = F.substring(F.rtrim("text", F.lit(BLANK_CHARACTERS)), -1, 1)
    marked = rows.select(
        "conv_id", _turn_key().alias("turn_key"), "role", "digest", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(BLANKS.replace("[", "[^", 1))).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )
    earliest = marked.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("turn_key").alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return marked.join(earliest, same).withColumn("again", F.col("turn_key") > F.col("earliest")).drop("c", "r", "d", "earliest")


# --- plans -----------------------------------------------------------------------------------------------------------

PIECES = (
    "conv_id long, whole boolean, part int, seq int, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "cost long, audit string, paths array<struct<origin:int, state:int, cost:long, audit:string>>"
)
_PATHS_TYPE = pa.list_(pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), ("n_rows", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()),
    ("audit", pa.string()), ("paths", _PATHS_TYPE),
])


def _listed(paths: Paths) -> list[dict]:
    return [{"origin": p, "state": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in paths.items()]


class _Run:
    """Rows of one conversation as they stream by."""

    def __init__(self, conv_id: int | None, touches_start: bool):
        self.conv_id, self.touches_start, self.seq, self.key = conv_id, touches_start, 0, None
        self.clear()

    def clear(self) -> None:
        self.initials: list[str] = []
        self.faults: list[Fault] = []

    def add(self, key: tuple, initial: str, blank: bool, truncated: bool, again: bool) -> None:
        again, self.key = again or key == self.key, key
        self.initials.append(initial if initial in ("s", "u", "a") else "?")
        self.faults.append("b" if blank else "d" if again else "t" if truncated else "")

    def row(self, whole: bool, part: int) -> dict:
        initials = "".join(self.initials)
        cost, audit = repair_plan(initials, self.faults) if whole else (None, None)
        row = {
            "conv_id": self.conv_id, "whole": whole, "part": part, "seq": self.seq, "n_rows": len(initials), "blank": self.faults.count("b"),
            "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[:1], "last": initials[-1:],
            "cost": cost, "audit": audit, "paths": [] if whole else _listed(piece_paths(initials, self.faults)),
        }
        self.seq += 1
        self.clear()
        return row


def _pieces(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "known", "turn", "role", "digest", "initial", "blank", "truncated", "again")]
            for conv_id, known, turn, role, digest, initial, blank, truncated, again in zip(*columns):
                if run is None or conv_id != run.conv_id:
                    if run is not None:
                        out.append(run.row(run.seq == 0 and not run.touches_start, part))
                    run = _Run(conv_id, run is None)
                elif len(run.faults) == piece:
                    out.append(run.row(False, part))
                run.add((known, turn, role, digest), initial, blank, truncated, again)
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out = []
        if run is not None:
            out.append(run.row(False, part))  # may go on in the next partition
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return stream


def _merge(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda row: row["index"])
    total = {name: sum(row[name] for row in rows) for name in ("n_rows", "blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
    paths = merged_paths([{(p["origin"], p["state"]): (p["cost"], p["audit"]) for p in row["paths"]} for row in rows])
    merged = total | {"conv_id": rows[0]["conv_id"], "index": rows[0]["index"] // FAN, "first": rows[0]["first"], "last": rows[-1]["last"], "paths": _listed(paths)}
    return pa.Table.from_pylist([merged], schema=_MERGED)


FAN = 64
_MERGED = pa.schema([_SCHEMA.field(n) for n in ("conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths")] + [("index", pa.int64())])
_MERGED_DDL = (
    "conv_id long, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "paths array<struct<origin:int, state:int, cost:long, audit:string>>, index long"
)
_PLAN = ("conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _joined_pieces(split: DataFrame) -> DataFrame:
    """Plans of the conversations that came in pieces."""
    # places of the pieces: those of earlier partitions come first; at most a row a conversation and partition is ranked
    parts = split.groupBy("conv_id", "part").agg(F.count("*").alias("pieces"))
    before = F.sum("pieces").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("offset"))
    placed = split.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    level = durable(placed.select(*_MERGED.names[:-1], (F.col("offset") + F.col("seq")).alias("index")), "pieces")
    while True:
        grouped = level.groupBy("conv_id", F.floor(F.col("index") / FAN).cast("long").alias("g"))
        level = durable(grouped.applyInArrow(_merge, _MERGED_DDL), "pieces")
        if level.filter(F.col("index") > 0).isEmpty():
            break
    ends = F.filter("paths", lambda p: (p["origin"] == START) & p["state"].isin(*GOALS))
    best = F.array_min(F.transform(ends, lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    return level.withColumn("best", best).select(*_PLAN[:-2], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def plans(rows: DataFrame, piece: int = 512) -> DataFrame:
    """Per conversation: counts of faults and illegal neighbours, cost and audit of the cheapest repair.

    ``rows`` as ``damaged`` or ``digested`` gives them; ``piece`` is the most rows repaired in one agenda.
    """
    marked = durable(faulty(rows), "marked")
    spread = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    spread = spread.select("conv_id", "turn_key.known", "turn_key.turn", "role", "digest", "initial", "blank", "truncated", "again")
    found = durable(spread.mapInArrow(_pieces(piece), PIECES), "repairs")
    whole, split = found.filter("whole").select(*_PLAN), found.filter(~F.col("whole"))
    return whole.unionByName(_joined_pieces(split))


# --- repaired rows ---------------------------------------------------------------------------------------------------

def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str, str] | None]:
    """Repaired rows (conv_id, place, role, text, edit); None ahead of each conversation."""
    conv_id, audit, at, place, state = None, "", 0, 0, "s"

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = "a" if state == "u" else "u"
            yield conv_id, place, SPOKEN[state], "", "I"
            at, place = at + 1, place + 1

    for batch in batches:
        for new_id, kind, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                conv_id, audit, at, place, state = new_id, text, 0, 0, "s"
                yield None
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = "s" if edit == "K" and role[:1] == "s" else "a" if state == "u" else "u"
                    yield conv_id, place, role if edit == "K" else SPOKEN[state], text, edit
                    place += 1
            yield from inserted()


def _with_audits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order; one task streams a conversation."""
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.select(_turn_key()).schema[0].dataType).alias("turn_key"),
                           F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    bodies = rows.select("conv_id", F.lit(1).alias("kind"), _turn_key().alias("turn_key"), "role", "digest", "text")
    both = heads.unionByName(bodies)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "kind", "role", "text")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    names = ["conv_id", "place", "role", "text", "edit"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in _edited(batches):
            if row is None:
                continue
            out.append(row)
            size += len(row[3]) + 64
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _with_audits(rows, planned).mapInArrow(stream, "conv_id long, place long, role string, text string, edit string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired ``role:text`` rows, joined by line feeds."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, conv_id = [], [], None
        heads = _heads(batches, keys)
        digest = None
        for row in _edited(heads):
            if row is None:
                if digest is not None:
                    hashes.append(digest.hexdigest())
                digest = hashlib.sha256()
            else:
                digest.update((("\n" if row[1] else "") + f"{row[2]}:{row[3]}").encode())
            if len(hashes) >= 10_000:
                done, keys[:] = keys[: len(hashes)], keys[len(hashes) :]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
                hashes = []
        if digest is not None:
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

    return _with_audits(rows, planned).mapInArrow(stream, "conv_id long, repaired_sha256 string")


def _heads(batches: Iterator[pa.RecordBatch], keys: list) -> Iterator[pa.RecordBatch]:
    """The batches as they are; the conversations met are noted in ``keys``."""
    for batch in batches:
        keys.extend(c for c, kind in zip(batch["conv_id"].to_pylist(), batch["kind"].to_pylist()) if kind == 0)
        yield batch


def report(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """The contract's row per original conversation."""
    rows = damaged(conversations)
    planned = durable(plans(rows, piece), "plans")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    parts = [planned.drop("n_rows"), digests(rows, planned), turns]
    result = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in parts:
        part = part.withColumnRenamed("conv_id", "c")
        result = result.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return result.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
