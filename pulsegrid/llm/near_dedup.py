"""Near-duplicates: a chosen-path set similarity join over five-word shingles.

1. Documents with the same shingle set form a class; only one of each class, its
   representative, goes on. Copies are merged before anything is shuffled twice.
2. In each of several independent trees a representative goes to the child named
   by its minwise token. A node whose documents are all linked is done. Nodes of
   up to ``task`` documents are branched on inside a task, larger ones by a
   shuffle: by two minwise tokens, drawn anew for every node, twice, so that a
   pair at the limit of similarity keeps more than one common child on average;
   of a few draws the two that part the node's documents most are taken, as
   tokens of boilerplate part nothing. Before a large node branches, documents
   whose sketches all but equal a pivot's are tied to it.
3. A small node is compared exhaustively by sketches of 64 bytes (a pair at the
   limit fails that with probability below 1e-5). What is passed on are not pairs
   but groups of documents of bounded size, a row a document; a pivot's documents
   are cut into groups that each hold the pivot.
4. Groups are verified on the documents' full sets of 64-bit shingle hashes:
   shared shingles are counted through the group's postings, one document at a
   time, until those left are all in one component.
5. Links are contracted to components by alternating large and small stars. Two
   rounds are made: the first trees link most families, the others then only look
   at nodes whose documents are still in different components.

Nothing is capped: a node that goes on being large after MAX_LEVELS shuffles is
cut into blocks, and every two blocks are compared. What is kept between steps
are tables in the shared folder.

Rows that repeat a doc_id are one document (the smaller set of shingles of its
texts stands for it in classes of its own). A row without a doc_id is linked
with nothing: its component is null and it is kept. Null and empty texts have
empty sets and are linked with nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textblocks
from pulsegrid.llm.common import semi_join
from pulsegrid.session import durable

FUNCTIONS = 64
#: Shuffles that branch large nodes, and branchings inside a task, before all documents of a node are compared.
MAX_LEVELS = 12
PIVOTS = 4

_KEYS = textblocks.mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Settings:
    """words: per shingle; percent: least similarity; trees: in all, ``first_trees`` of them in the first round; node: documents
    outside the largest component of a node that is compared exhaustively; task: documents of a node that a task branches on its own;
    least_sketch, sure_sketch: shares of equal sketch bytes that a pair needs, and that ties a document to a pivot until it
    is verified; group: shingles verified together, about."""

    words: int = 5
    percent: int = 75
    trees: int = 13
    first_trees: int = 2
    node: int = 1_024
    task: int = 16_384
    least_sketch: float = 0.5
    sure_sketch: float = 0.9
    group: int = 2_000_000


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in textblocks.blocks(texts):
        data = textblocks.LOWER[data]
        start, end, rows = textblocks.words(data, offsets)
        yield first, *textblocks.shingle_hashes(textblocks.word_hashes(data, start, end), rows, words)


def sketches(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: the size of its set, a 128-bit fingerprint of it, the trees' first tokens and the sketch."""
    trees = settings.trees

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in _sets(batch["text"], settings.words):
                rows, sizes = len(bounds) - 1, np.diff(bounds)
                some = np.flatnonzero(sizes)
                least = np.zeros((rows, FUNCTIONS), np.uint64)
                prints = np.zeros((rows, 2), np.uint64)
                if len(some):
                    at = bounds[:-1][some]
                    for k in range(FUNCTIONS):
                        least[some, k] = np.minimum.reduceat((values ^ _KEYS[k]) * (_KEYS[FUNCTIONS + k] | np.uint64(1)), at)
                    prints[some, 0] = np.add.reduceat(textblocks.mix(values), at)
                    prints[some, 1] = np.bitwise_xor.reduceat(textblocks.mix(values ^ _KEYS[0]), at)
                least = textblocks.mix(least)
                tokens = (least[:, :trees] & np.uint64(0x7FFFFFFF)).astype(np.int32)
                bytes_ = (least >> np.uint64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(first, rows).cast(pa.int64()), pa.array(sizes), pa.array(prints[:, 0].view(np.int64)),
                    pa.array(prints[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * trees), pa.array(tokens.ravel())),
                    pa.array([row.tobytes() for row in bytes_], pa.binary()),
                ], names=["doc_id", "n_shingles", "print_a", "print_b", "tokens", "sketch"])

    schema = "doc_id long, n_shingles long, print_a long, print_b long, tokens array<int>, sketch binary"
    return documents.select("doc_id", "text").mapInArrow(sketch, schema)


def sets_of(documents: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """(id, set) of the documents named; the set as sorted 64-bit hashes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in _sets(batch["text"], settings.words):
                parts = [values[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(first, len(parts)).cast(pa.int64()), pa.array(parts, pa.binary())], names=["id", "set"],
                )

    rows = semi_join(documents.select(F.col("doc_id").alias("id"), "text"), ids, "id")
    return rows.mapInArrow(collect, "id long, set binary").groupBy("id").agg(F.min("set").alias("set"))


def _fits(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(one, two) * 100 >= np.maximum(one, two) * percent


class _Paths:
    """Branches the documents of one node inside a task and gathers the groups to verify, as arrays of row numbers."""

    def __init__(self, node: int, sizes: np.ndarray, sketch: np.ndarray, part: np.ndarray, settings: Settings):
        self.sizes, self.sketch, self.settings = sizes, sketch, settings
        self.label = np.unique(part, return_inverse=True)[1]
        self.draw = np.random.default_rng(np.uint64(node & 0xFFFFFFFFFFFFFFFF))
        self.groups: list[np.ndarray] = []

    def agreeing(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Equal sketch bytes of every document of ``one`` with every one of ``two``."""
        equal = np.zeros((len(one), len(two)), np.uint8)
        ours, theirs = self.sketch[one], self.sketch[two]
        for k in range(FUNCTIONS):
            equal += ours[:, k, None] == theirs[None, :, k]
        return equal

    def candidates(self, one: np.ndarray, two: np.ndarray, share: float) -> np.ndarray:
        good = self.agreeing(one, two) >= share * FUNCTIONS
        good &= self.label[one][:, None] != self.label[two][None]
        return good & _fits(self.sizes[one][:, None], self.sizes[two][None], self.settings.percent)

    def tie(self, pivot: int, others: np.ndarray) -> None:
        """Groups of a pivot and the documents taken for its own."""
        heaps = np.cumsum(self.sizes[others]) // self.settings.group
        self.groups += [np.r_[pivot, others[heaps == heap]] for heap in np.unique(heaps)]
        self.label[np.isin(self.label, self.label[others])] = self.label[pivot]

    def open(self, rows: np.ndarray) -> np.ndarray:
        """Documents outside the largest component."""
        labels = self.label[rows]
        return rows[labels != np.bincount(labels).argmax()]

    def explore(self, rows: np.ndarray, depth: int = 0) -> None:
        left = self.open(rows)
        for _ in range(2 * PIVOTS):
            if len(left) <= self.settings.node:
                break
            pivot = self.draw.choice(left)
            sure = rows[self.candidates(np.array([pivot]), rows, self.settings.sure_sketch)[0]]
            if len(sure):
                self.tie(pivot, sure)
                left = self.open(rows)
        if not len(left):
            return
        children = [] if len(left) <= self.settings.node or depth == MAX_LEVELS else self.children(rows)
        if not children:
            self.compare(left, rows)
        for child in children:
            self.explore(child, depth + 1)

    def children(self, rows: np.ndarray) -> list[np.ndarray]:
        """Children of two branchings; none if tokens don't part the documents."""
        drawn = []
        for _ in range(6):
            one, two = self.draw.choice(FUNCTIONS, 2, replace=False)
            key = self.sketch[rows, one].astype(np.int64) * 256 + self.sketch[rows, two]
            drawn.append((float((np.bincount(key).astype(np.float64) ** 2).sum()), len(drawn), key))
        out = []
        for together, _, key in sorted(drawn, key=lambda d: d[:2])[:2]:
            if together > 0.8 * len(rows) ** 2:
                return []
            order = np.argsort(key, kind="stable")
            out += [rows[part] for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(part) > 1]
        return out

    def compare(self, left: np.ndarray, rows: np.ndarray) -> None:
        """All pairs of a document outside the largest component with any other, by their sketches."""
        step = max(1, (4 << 20) // len(rows))
        wanted = np.zeros(len(self.label), bool)
        for at in range(0, len(left), step):
            some = left[at : at + step]
            good = self.candidates(some, rows, self.settings.least_sketch)
            wanted[some[good.any(1)]] = True
            wanted[rows[good.any(0)]] = True
        members = np.flatnonzero(wanted)
        if not len(members):
            return
        heap = np.cumsum(self.sizes[members]) // self.settings.group
        heaps = [members[heap == h] for h in np.unique(heap)]
        if len(heaps) == 1:
            self.groups += heaps
        else:  # too much to verify at once: every two heaps
            self.groups += [np.r_[heaps[i], heaps[j]] for i in range(len(heaps)) for j in range(i)]


_GROUPS = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("part", pa.int64())])


def _grouped(ids: np.ndarray, part: np.ndarray, groups: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the groups; a group is named by its documents, so that trees which find the same one name it alike."""
    names = [int(textblocks.mix(ids[g].astype(np.uint64)).sum() ^ np.uint64(len(g))) for g in groups]
    sizes, rows = [len(g) for g in groups], np.concatenate(groups) if groups else np.zeros(0, int)
    name = np.repeat(np.array(names, np.uint64), sizes).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids[rows]), pa.array(part[rows])], schema=_GROUPS)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, FUNCTIONS)
    return [*(batch[c].to_numpy(zero_copy_only=False) for c in ("node", "id", "n", "part")), sketch]


def groups_of(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(group, id, part) of nodes that fit a task: documents that may be similar to one another."""

    def explored(node: np.ndarray, ids: np.ndarray, sizes: np.ndarray, part: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ends = np.r_[begins[1:], len(node)]
        two = begins[ends - begins == 2]  # most nodes hold two documents
        good = (sketch[two] == sketch[two + 1]).sum(1) >= settings.least_sketch * FUNCTIONS
        good &= (part[two] != part[two + 1]) & _fits(sizes[two], sizes[two + 1], settings.percent)
        groups = [np.array([k, k + 1]) for k in two[good]]
        for begin, end in zip(begins, ends):
            if end - begin > 2:
                paths = _Paths(int(node[begin]), sizes[begin:end], sketch[begin:end], part[begin:end], settings)
                paths.explore(np.arange(end - begin))
                groups += [begin + g for g in paths.groups]
        return _grouped(ids, part, groups)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = _columns(batch)
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            whole = len(columns[0]) and int(np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])[-1])  # the last node may go on
            if whole:
                yield explored(*(c[:whole] for c in columns))
            rest = [c[whole:] for c in columns]
        if rest is not None and len(rest[0]):
            yield explored(*rest)

    rows = nodes.select("node", "id", "n", "part", "sketch").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(stream, "group long, id long, part long")


def _open_nodes(rows: DataFrame) -> DataFrame:
    """Rows (node, id, part) of nodes that hold more than one component, with the number of the node's documents."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("part").alias("least"), F.max("part").alias("greatest"))
    return rows.join(nodes.filter(F.col("least") < F.col("greatest")).select("node", "size"), "node")


def _tied(large: DataFrame, settings: Settings) -> DataFrame:
    """Rows of large nodes, each with the pivot it is tied to (or null) and that pivot's component in place of its own."""
    row = F.struct("id", "n", "part", "sketch")
    drawn = [F.min_by(row, F.xxhash64("id", "node", F.lit(k))) for k in range(PIVOTS)]
    pivots = large.groupBy("node").agg(F.array(*drawn).alias("pivots"))

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, sizes, part, sketch = _columns(batch)
            pivot, now = np.zeros(len(ids), np.int64), part.copy()
            of = batch["pivots"].flatten()
            p_ids, p_sizes, p_parts = (of.field(c).to_numpy(zero_copy_only=False).reshape(-1, PIVOTS) for c in ("id", "n", "part"))
            p_sketch = np.frombuffer(b"".join(of.field("sketch").to_pylist()), np.uint8).reshape(-1, PIVOTS, FUNCTIONS)
            free = np.ones(len(ids), bool)
            for k in range(PIVOTS):
                sure = free & ((sketch == p_sketch[:, k]).sum(1) >= settings.sure_sketch * FUNCTIONS)
                sure &= (p_parts[:, k] != part) & _fits(sizes, p_sizes[:, k], settings.percent)
                pivot[sure], now[sure] = p_ids[sure, k], p_parts[sure, k]
                free &= ~sure & (p_ids[:, k] != ids)
            tied = pa.array(pivot, mask=now == part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(ids), pa.array(sizes), pa.array(part), batch["sketch"], batch["size"], tied, pa.array(now)],
                names=["node", "id", "n", "part", "sketch", "size", "pivot", "now"],
            )

    joined = large.join(pivots, "node").select("node", "id", "n", "part", "sketch", "size", "pivots")
    return joined.mapInArrow(tie, "node long, id long, n long, part long, sketch binary, size long, pivot long, now long")


def _pivot_groups(tied: DataFrame) -> DataFrame:
    """(group, id, part): about 64 documents of a pivot each, with the pivot."""
    some = tied.filter(F.col("pivot").isNotNull())
    some = some.withColumn("group", F.xxhash64("node", "pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / 64))))
    pivots = some.select("group", F.col("pivot").alias("id"), F.col("now").alias("part")).distinct()
    return some.select("group", "id", "part").unionByName(pivots)


def _branched(tied: DataFrame) -> DataFrame:
    """Children of large nodes: two minwise tokens, drawn twice for each node; rows (node, id, part, n, sketch)."""
    draw = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(FUNCTIONS)).cast("int")
    token = lambda salt: F.substring("sketch", draw(salt) + 1, F.lit(1))
    children = [F.xxhash64("node", F.lit(k), token(f"{k}-1"), token(f"{k}-2")) for k in range(2)]
    return tied.select(F.explode(F.array(*children)).alias("node"), "id", F.col("now").alias("part"), "n", "sketch")


def _block_pairs(large: DataFrame, settings: Settings) -> DataFrame:
    """Nodes that branching does not part: their documents in blocks, and every two blocks a node of its own."""
    blocks = F.ceil(F.col("size") * 2 / settings.task)
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("node", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))


def _candidates(classes: DataFrame, roots: DataFrame | None, first: int, trees: int, settings: Settings) -> DataFrame:
    """(group, id, part) of trees ``first`` up to ``trees``, stored."""
    rows = classes.select(F.posexplode(F.slice("tokens", first + 1, trees - first)).alias("tree", "token"), "id")
    rows = rows.select(F.xxhash64(F.col("tree") + first, "token").alias("node"), "id")
    if roots is None:
        rows = rows.withColumn("part", F.col("id"))
    else:
        rows = rows.join(roots, "id", "left").select("node", "id", F.coalesce("root", "id").alias("part"))
    nodes = durable(_open_nodes(rows).join(classes.select("id", "n", "sketch"), "id"), "nodes")
    found = groups_of(nodes.filter(F.col("size") <= settings.task), settings)
    large, level = nodes.filter(F.col("size") > settings.task), 0
    while not large.isEmpty():
        if level == MAX_LEVELS:
            found = found.unionByName(groups_of(_block_pairs(large, settings), settings))
            break
        tied = durable(_tied(large, settings), "tied")
        nodes = durable(_open_nodes(_branched(tied)), "nodes")
        found = found.unionByName(_pivot_groups(tied)).unionByName(groups_of(nodes.filter(F.col("size") <= settings.task), settings))
        large, level = nodes.filter(F.col("size") > settings.task), level + 1
    return durable(found, "groups")


# --- verification ----------------------------------------------------------------------------------------------------

def linked(sets: list[np.ndarray], part: np.ndarray, percent: int) -> np.ndarray:
    """Component of each set, as the place of a member: those of one ``part``, and those joined by similar pairs."""
    label = np.unique(part, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, bounds = np.repeat(np.arange(len(sets)), sizes), np.r_[0, np.cumsum(sizes)]
    posting = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    begin = np.cumsum(count) - count
    weight = np.add.reduceat(count[code], bounds[:-1])  # documents that share much come first
    waiting = np.ones(len(sets), bool)
    while True:
        left = np.flatnonzero(waiting & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        one = left[weight[left].argmax()]
        waiting[one] = False
        mine = code[bounds[one] : bounds[one + 1]]
        many = count[mine]
        at = np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(posting[at], minlength=len(sets))
        near = 100 * common >= percent * (sizes[one] + sizes - common)
        label[np.isin(label, label[near])] = label[one]


def verified(documents: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between components that hold a similar pair, from the full sets of each group's documents."""
    groups = groups.dropDuplicates(["group", "id"])
    sets = sets_of(documents, durable(groups.select("id").distinct(), "members"), settings)

    def verify(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        label = linked([np.frombuffer(s.as_buffer(), np.uint64) for s in table["set"]], part, settings.percent)
        a, b = [], []
        for k in np.unique(label):
            parts = np.unique(part[label == k])
            a += parts[1:].tolist()
            b += [int(parts[0])] * (len(parts) - 1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.join(sets, "id").select("group", "part", "set").groupBy("group").applyInArrow(verify, "a long, b long")


def _starred(edges: DataFrame) -> bool:
    """Whether every pointed id has one root and no root is itself pointed elsewhere."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    least, greatest, is_root = F.min("v"), F.max("v"), F.max(F.col("v").isNull())
    state = ends.groupBy("u").agg(least.alias("least"), greatest.alias("greatest"), is_root.alias("is_root"))
    return state.filter((F.col("least") < F.col("greatest")) | (F.col("is_root") & F.col("least").isNotNull())).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id, the root being the least id of its component.

    Alternating stars, until there are only stars left: each id points all larger neighbours to its least neighbour, then all
    smaller ones.
    """
    pointed = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = durable(pointed.filter(F.col("u") != F.col("v")).distinct(), "components")
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(own)


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: these join components, so only the links between different ones are followed."""
    one = roots.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
    two = roots.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = durable(between.filter(F.col("a") != F.col("b")).distinct(), "between")
    if between.isEmpty():
        return roots
    merged = components(between).select(F.col("id").alias("root"), F.col("root").alias("_root"))
    old = roots.join(merged, "root", "left").select("id", F.coalesce("_root", "root").alias("root"))
    new = merged.select(F.col("root").alias("id"), F.col("_root").alias("root")).join(roots.select("id"), "id", "left_anti")
    return durable(old.unionByName(new), "roots")


def link(documents: DataFrame, sketched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Components (id, root) of representatives that are linked."""
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = durable(known.groupBy("print_a", "print_b").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"),
    ).drop("print_a", "print_b"), "classes")
    roots, done = None, 0
    for trees in (settings.first_trees, settings.trees):
        links = durable(verified(documents, _candidates(classes, roots, done, trees, settings), settings), "links")
        roots = contracted(documents.sparkSession.createDataFrame([], "id long, root long") if roots is None else roots, links)
        done = trees
    return roots


def classify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's row per document: doc_id, n_shingles, component_id, kept."""
    sketched = durable(sketches(documents, settings), "sketches")
    roots = link(documents, sketched, settings)
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("id"))
    classes = classes.join(roots, "id", "left").select("print_a", "print_b", F.coalesce("root", "id").alias("component"))
    rows = sketched.select("doc_id", "n_shingles", "print_a", "print_b").join(classes, ["print_a", "print_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)),
    )
