"""Helpers that the operators share: tables, checkpoints, size-checked joins and vectorised word hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes up to which a measured side may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one step of the vectorised code takes at a time (a single longer text is taken alone).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the session names none and all is one machine (tests)."""
    sc = spark.sparkContext
    if (named := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named := tempfile.mkdtemp(prefix="gristmill-"))
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: 8 bytes for the row and each column, and what strings and lists hold."""


    def held(name: str, kind) -> Column:
        if kind.typeName() in ("string", "binary"):
            return 8 + F.coalesce(F.octet_length(name), F.lit(0))
        if kind.typeName() == "array":
            return 8 + 8 * len(getattr(kind.elementType, "fields", "1")) * F.greatest(F.size(name), F.lit(0))
        return sum((held(f"{name}.`{f.name}`", f.dataType) for f in kind.fields), F.lit(8)) if kind.typeName() == "struct" else F.lit(8)

    return sum((held(f"`{f.name}`", f.dataType) for f in df.schema.fields), F.lit(8)).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one, ``row``: what is put beside it clashes with no name that a table may have. ``row.*`` gives them back."""
    return docs.select(F.struct("*").alias("row"))


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already durable, so cheap to read) takes ``most`` bytes or less."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join without moving ``big`` if ``small`` (already durable) takes at most ``most`` bytes; else an ordinary shuffled join."""
    return big.join(F.broadcast(small) if is_small(small, most) else small.hint("merge"), on, how)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once: a lambda variable can't be inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """The rows that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, total_bytes: int) -> DataFrame:
    """(doc_id, text, y) to learn ``label`` (0 or 1) from: a sample of bounded size, the same for any partitioning.

    Labels of held-out rows and others than 0 and 1 are left out; of several labels of a doc_id the largest counts, of
    several texts the least. The ``max_rows`` rows with the least hashes of their doc_ids, without texts of over
    ``max_bytes`` bytes, are taken in that order up to ``total_bytes`` bytes in all. Repeated rows are made one before
    they move.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = durable(known.orderBy(*order).limit(max_rows))
    rows = join_small(docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes), known, "doc_id")
    rows = durable(rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")))
    upto = rows.select("doc_id", F.sum(F.octet_length("text")).over(W.orderBy(*order)).alias("upto"))  # max_rows numbers
    return rows.join(upto.where(F.col("upto") <= total_bytes).select("doc_id"), "doc_id", "left_semi")


# --- vectorised text -----------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, for n positions at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x & (2**64 - 1), np.uint64)]).cumprod(dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Chunk:
    """Some whole texts: ``rows`` (their places in the batch), ``data`` (their bytes, one space between texts) and where each begins."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.rows, self.data, self.begin, self.end = rows, data, begin, end

    def words(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document in chunk, first byte, end byte, 64-bit hash) of each word ``[^\\x20\\x09-\\x0D]+``."""
        data = _LOWER[self.data] if lower else self.data
        edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        return np.searchsorted(self.end, s, side="right"), s, e, h


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The batch's texts (null: empty), some at a time, none ever cut."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        size = np.diff(off[at : to + 1])
        end = np.cumsum(size + 1)
        begin = end - size - 1
        out = np.full(int(end[-1]), 32, np.uint8)
        part = data[off[at] : off[to]]
        out[np.arange(len(part)) + np.repeat(np.arange(to - at), size)] = part
        yield Chunk(np.arange(at, to), out, begin, end)
        at = to


def shingles(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k words; a document of 1 to k-1 words has its whole sequence as one."""
    n = len(h)
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1) for i in range(k)]
    count = np.bincount(doc, minlength=n_docs)
    if n >= k:
        s = h[: n - k + 1] * odd[0]
        for i in range(1, k):
            s = s + h[i : n - k + 1 + i] * odd[i]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        d, s = doc[: n - k + 1][ok], mix(s[ok])
    else:
        d, s = doc[:0], h[:0]
    short = (count > 0) & (count < k)
    if short.any():
        sel = short[doc]
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        part = h[sel] * np.array(odd, np.uint64)[place[sel]]
        which, first = np.unique(doc[sel], return_index=True)
        total = np.add.reduceat(part, first)
        d, s = np.concatenate([d, which]), np.concatenate([s, mix(total + count[which].astype(np.uint64))])
    return d, s


def by_document(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value), in order of both."""
    o = np.lexsort((value, doc))
    doc, value = doc[o], value[o]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
        doc, value = doc[new], value[new]
    return doc, value
