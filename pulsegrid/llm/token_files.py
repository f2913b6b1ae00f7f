"""Token ids in Arrow stream files of equal-length sequences, and reading them back by place.

Documents are range-partitioned by id; each task encodes its documents in order
and writes one stream file: record batches of a fixed number of rows, each row
``ids`` (fixed-size list of 16-bit or 32-bit ids) and ``mask`` (fixed-size list
of booleans, false in the padding of the last row). Every batch but the last
takes the same bytes, so a reader seeks to the batch of a row or token and reads
nothing else, from any store; a memory-mapped file is read without copying. Which document lies where is a table beside the
files; it names only files of tasks that succeeded, so what a lost task left
behind is never read.

A null text is empty (its end id alone is stored). Null ids come first. Repeated
ids keep their rows, ordered by a hash of the text. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm import textblocks
from pulsegrid.session import durable, shared_path

SEQUENCE = 2048
ROWS_PER_BATCH = 64
END_ID = 0
#: Bytes of encoded pieces that a worker remembers, with what Python adds to each; later ones are encoded whenever they occur.
REMEMBERED_BYTES = 100_000_000
PIECE_BYTES = 180

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Last bytes of white space beyond ASCII; after them a text is not cut.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = True


class Encoder:
    """Ids of many texts at once.

    Byte-level tokenizers never join what stands before white space with it, unless that is white space too. So texts
    are cut there, each distinct piece is encoded once, and the ids are put together again: the same ids as for the
    whole text. Strings of added tokens become their tokens, as they do in a whole text; if one of them takes in white
    space, nothing is cut.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cuts = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.room = REMEMBERED_BYTES

    def _pieces(self, distinct: list[str]) -> list[bytes]:
        found = [*map(self.known.get, distinct)]
        missing = [i for i, code in enumerate(found) if code is None]
        if missing:
            new = [distinct[i] for i in missing]
            for i, piece, code in zip(missing, new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                found[i] = array(self.dtype.char, code.ids).tobytes()
                if self.room > 0:
                    self.known[piece] = found[i]
                    self.room -= len(piece) + len(found[i]) + PIECE_BYTES
        return found

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For blocks of rows: the first row, all ids with END_ID after each row, and the rows' lengths."""
        for first, data, offsets in textblocks.blocks(texts, 8 << 20):
            cut = np.zeros(len(data) + 1, bool)
            if len(data) and self.cuts:
                cut[1:-1] = _WHITE[data[1:]] & ~_WHITE[data[:-1]] & ~_MAYBE_WHITE[data[:-1]]
            cut[offsets] = True
            bounds = np.flatnonzero(cut)
            pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
            coded = pieces.dictionary_encode()
            encoded = self._pieces(coded.dictionary.to_pylist())
            sizes = np.array([len(x) // self.dtype.itemsize for x in encoded], np.int64)
            flat = np.frombuffer(b"".join(encoded), self.dtype)
            begins = np.cumsum(sizes) - sizes
            which = coded.indices.to_numpy()
            counts = sizes[which]
            ends = np.cumsum(counts)
            ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - (ends - counts), counts)]
            row_ends = np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)] if len(bounds) > 1 else np.zeros(len(offsets), np.int64)
            yield first, np.insert(ids, row_ends[1:], END_ID), np.diff(row_ends) + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives tasks, and with it the pieces already encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class TokenWriter:
    """One stream file; ids are appended in any portions."""

    def __init__(self, path: str, dtype: np.dtype, sequence: int = SEQUENCE, rows: int = ROWS_PER_BATCH) -> None:
        self.sequence, self.rows, self.dtype = sequence, rows, dtype
        value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        files, place = pa.fs.FileSystem.from_uri(path)
        files.create_dir(os.path.dirname(place), recursive=True)
        self.out = files.open_output_stream(place)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.sequence)
        padded = np.zeros(rows * self.sequence, self.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (padded, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.written += len(ids)
        size = self.sequence * self.rows
        if self.held >= size:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % size
            for at in range(0, whole, size):
                self._write(ids[at : at + size])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.waiting))
        self.stream.close()
        self.out.close()


class TokenFile:
    """Random access to a stream file by seeking: every batch but the last takes the same bytes, which the first one tells.

    Only the batches asked for are read; of a local, memory-mapped file their arrays are views.
    """

    def __init__(self, path: str) -> None:
        files, place = pa.fs.FileSystem.from_uri(path)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(place) if local else files.open_input_file(place)
        self.schema = pa.ipc.read_schema(self.source)
        self.sequence = self.schema.field("ids").type.list_size
        self.begin = self.source.tell()
        self.held: tuple[int, pa.RecordBatch] | None = None
        first = self._next()
        self.size = self.source.tell() - self.begin
        self.rows = first.num_rows
        self.held = 0, first

    def _next(self) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, number: int) -> pa.RecordBatch:
        if self.held is None or self.held[0] != number:
            self.source.seek(self.begin + number * self.size)
            self.held = number, self._next()
        return self.held[1]

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of one sequence."""
        batch, at = self.batch(number // self.rows), number % self.rows
        cut = slice(at * self.sequence, (at + 1) * self.sequence)
        return batch["ids"].values.to_numpy()[cut], batch["mask"].values[cut].to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """The ids from place ``start`` on; a view unless they cross batches."""
        size, parts = self.sequence * self.rows, []
        while count > 0:
            ids = self.batch(start // size)["ids"].values.to_numpy()
            part = ids[start % size : start % size + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.held = None
        self.source.close()


def write(documents: DataFrame, tokenizer: str, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write the files below ``folder`` (shared by all executors); returns the table of places.

    Columns: path, shard (files in ascending order of ids), doc_id, local (place in the file), start (ids of all
    documents before it), n_tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(tokenizer), TaskContext.get().partitionId()
        path, writer = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.arrows", None
        for batch in batches:
            for first, ids, counts in code.encode(batch["text"]):
                writer = writer or TokenWriter(path, code.dtype, sequence)
                local = writer.written + np.cumsum(counts) - counts
                writer.append(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(counts)), pa.array(np.full(len(counts), shard, np.int32)),
                    batch["doc_id"].slice(first, len(counts)).cast(pa.int64()), pa.array(local), pa.array(counts),
                ], names=["path", "shard", "doc_id", "local", "n_tokens"])
        if writer:
            writer.close()

    rows = documents.select("doc_id", "text")
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "path string, shard int, doc_id long, local long, n_tokens long"
    places = durable(rows.mapInArrow(encode, schema), "token-places")
    totals = places.groupBy("shard").agg((F.max(F.col("local") + F.col("n_tokens"))).alias("total"))
    # one row per file: the window is over as many rows as there were tasks
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return places.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("local")).drop("before")


def checksums(places: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its ids as they stand in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            sums = []
            for path, local, count in zip(*(batch[c].to_pylist() for c in ("path", "local", "n_tokens")), strict=True):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, TokenFile(path)
                sums.append(zlib.crc32(file.tokens(local, count).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if file:
            file.close()

    # files are read in order; a large file is spread over tasks by ranges of places
    ordered = places.repartitionByRange("path", "local").sortWithinPartitions("path", "local")
    return ordered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """The contract's row per document, read back from the files."""
    folder = shared_path(documents.sparkSession, "token-files")
    return checksums(write(documents, tokenizer, folder, sequence))
