"""Token ids packed into fixed rows by best-fit decreasing.

Each task encodes its documents (byte-level BPE from a rank file; an end mark follows each), cuts those longer than a row
into pieces without loss, and packs a block of documents at a time: pieces by falling length, each into the open row with
the least room that takes it, found in a segment tree over rooms that counts open rows. Full pieces are rows at once.

A packed row has: ``ids`` (little-endian uint16, or uint32 for vocabularies over 65,536 ids; ``row_len`` of them, padded
with the end mark), ``cu_seqlens`` (cumulative segment lengths from 0), ``positions`` (uint32 for long rows, else uint16,
per id, from 0 anew in each segment; padding counts from 0 too) and ``segments`` (doc_id, first id within the document,
length). ``unpack`` gives the texts back; ``save`` and ``load`` keep the matrices as binary files with an index.

A null text has no ids and no segment; an empty one is its end mark. Repeated rows are packed each and told apart by
``copy``; a null doc_id is carried along. Ties in size go by place. Empty table: no rows. Extra columns are ignored. A very
long text is cut into rows without loss. Memory: a block of ids and one row for each bin. Blocks are packed each by itself,
so which documents share a row depends on how the table is read, and the last rows of a block may be less full; no id is
lost or repeated either way.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS, END, ROW_LEN = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 2048
#: Word pattern that belongs to the rank file (a fixed value of that public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A long run of white space (what ``\s`` is in that pattern). The pattern takes all of it but the last character, or all at
#: the end of a text, as one word; a run of a million would be beyond the regular expression's stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Ids that are packed together: a block's bound on memory.
BLOCK_IDS = 4_000_000
RESULT = "task long, row long, n_ids int, cu_seqlens array<int>, segments array<struct<doc_id:long, copy:long, begin:long, length:int>>, ids binary, positions binary"


def rank_table(ranks: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(ranks, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(table: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_whole(code, one_word, text: str) -> np.ndarray:
    """The ids of a text of any length; long runs of white space are given to ``one_word``, an encoder without a word pattern."""
    parts, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [code.encode_to_numpy(text[at : m.start()]), one_word.encode_to_numpy(text[m.start() : end])] if m.start() > at else [one_word.encode_to_numpy(text[m.start() : end])]
        at = end
    return np.concatenate([*parts, code.encode_to_numpy(text[at:])] if at < len(text) else parts or [np.zeros(0, np.uint32)])


class RoomTree:
    """How many open rows have each room, and the least room of at least some size."""

    def __init__(self, most: int):
        self.leaves = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the tightest open row with room for ``size``, which is taken out."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a subtree to the right has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, row_len: int) -> list[list[int]]:
    """Rows of places in ``sizes`` (each 1 to row_len); ties by place."""
    rows: list[list[int]] = []
    tree = RoomTree(row_len)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if size < row_len and (got := tree.take(size)):
            room, row = got
            rows[row].append(i)
        else:
            room, row = row_len, len(rows)
            rows.append([i])
        if room > size:
            tree.put(room - size, row)
    return rows


def pack(docs: DataFrame, row_len: int = ROW_LEN, ranks: str = DEFAULT_RANKS, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    table = docs.sparkSession.sparkContext.broadcast(rank_table(ranks))  # as large as the vocabulary
    place = np.dtype("<u2") if row_len <= 1 << 16 else np.dtype("<u4")

    def rows_of(items: list[tuple[int, int, np.ndarray]], task: int, base: int) -> tuple[pa.RecordBatch, int]:
        pieces = [(d, copy, a, ids[a : a + row_len]) for d, copy, ids in items for a in range(0, len(ids), row_len)]
        rows = best_fit_decreasing(np.array([len(p[3]) for p in pieces], np.int64), row_len) if pieces else []
        cu, segments, matrix, positions, used = [], [], [], [], []
        for row in rows:
            own = [pieces[i] for i in row]
            sizes = [len(p[3]) for p in own]
            n = sum(sizes)
            ids, at = np.full(row_len, end, kind), np.empty(row_len, place)
            ids[:n] = np.concatenate([p[3] for p in own])
            edges = np.cumsum([0, *sizes])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), row_len]):
                at[a:b] = np.arange(b - a)
            cu.append(edges.tolist())
            segments.append([{"doc_id": d, "copy": c, "begin": a, "length": k} for (d, c, a, _), k in zip(own, sizes)])
            matrix.append(ids.tobytes())
            positions.append(at.tobytes())
            used.append(n)
        segment = pa.struct([("doc_id", pa.int64()), ("copy", pa.int64()), ("begin", pa.int64()), ("length", pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int64()), pa.array(np.arange(base, base + len(rows)), pa.int64()), pa.array(used, pa.int32()), pa.array(cu, pa.list_(pa.int32())), pa.array(segments, pa.list_(segment)), pa.array(matrix, pa.binary()), pa.array(positions, pa.binary())], names=["task", "row", "n_ids", "cu_seqlens", "segments", "ids", "positions"]), base + len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, one_word, task, base, held, waiting = encoder(table.value), encoder(table.value, r"[\s\S]+"), TaskContext.get().partitionId(), 0, 0, []
        seen = 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                seen += 1
                if not t.is_valid:
                    continue
                ids = np.append(encode_whole(code, one_word, t.as_py()).astype(kind), kind.type(end))
                waiting.append((d, (task << 40) + seen, ids))
                held += len(ids)
                if held >= block_ids:
                    out, base = rows_of(waiting, task, base)
                    held, waiting = 0, []
                    for at in range(0, out.num_rows, 2000):
                        yield out.slice(at, 2000)
        out, base = rows_of(waiting, task, base)
        for at in range(0, out.num_rows, 2000):
            yield out.slice(at, 2000)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def unpack(packed: DataFrame, ranks: str = DEFAULT_RANKS, end: int = END) -> DataFrame:
    """doc_id and text of each packed document."""
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    s = packed.select("ids", F.posexplode("segments").alias("i", "s"), "cu_seqlens")
    s = s.select("s.doc_id", "s.copy", "s.begin", F.expr(f"substring(ids, {kind.itemsize} * cu_seqlens[i] + 1, {kind.itemsize} * s.length)").alias("part"))
    table = packed.sparkSession.sparkContext.broadcast(rank_table(ranks))
    whole = s.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(table.value)
        for b in batches:
            ids = [np.frombuffer(b"".join(x["part"] for x in p), kind)[:-1].tolist() for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([code.decode(x) for x in ids], pa.string())], names=["doc_id", "text"])

    return whole.select("doc_id", "p").mapInArrow(run, "doc_id long, text string")


INDEX = "file string, task long, row long, n_ids int, cu_seqlens array<int>, segments array<struct<doc_id:long, copy:long, begin:long, length:int>>"


def save(packed: DataFrame, folder: str) -> None:
    """Write packed rows as binary matrices, one file of ids and one of positions for each task, and an index of their rows.

    ``folder`` is an address that all executors write to (any of Arrow's file systems). Files are named at random and count
    only once the index, written last, names them, so what a lost task left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, place = uuid.uuid4().hex, 0
        with fs.open_output_stream(f"{path}/{name}.ids") as ids, fs.open_output_stream(f"{path}/{name}.positions") as positions:
            for b in batches:
                for out, column in ((ids, "ids"), (positions, "positions")):
                    for x in b.column(column):
                        out.write(x.as_buffer())
                rows = pa.array(np.arange(place, place + b.num_rows))
                place += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), b.column("task"), rows, b.column("n_ids"), b.column("cu_seqlens"), b.column("segments")], names=["file", "task", "row", "n_ids", "cu_seqlens", "segments"])

    packed.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")


def load(folder: str, row_len: int = ROW_LEN, end: int = END) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[int]]]]:
    """(ids, positions, cumulative segment lengths of each row) of each file: matrices of ``row_len`` columns, in order of name."""
    kinds = (np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4"), np.dtype("<u2") if row_len <= 1 << 16 else np.dtype("<u4"))
    fs, path = pa.fs.FileSystem.from_uri(folder)
    index = pa.dataset.dataset(f"{path}/index", filesystem=fs, format="parquet").to_table(["file", "row", "cu_seqlens"]).sort_by([("file", "ascending"), ("row", "ascending")])
    for name in index["file"].unique().to_pylist():
        ids, positions = (np.frombuffer(fs.open_input_file(f"{path}/{name}.{x}").read(), kind).reshape(-1, row_len) for x, kind in zip(("ids", "positions"), kinds))
        yield ids, positions, index.filter(pa.compute.equal(index["file"], name))["cu_seqlens"].to_pylist()


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
