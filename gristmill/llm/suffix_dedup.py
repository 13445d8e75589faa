"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted, compared with neighbours and extended.

A document is its lower-cased (A-Z) words. Suffixes are kept only where a run of ``SEED`` words has the least hash of
``WINDOW`` runs in a row (minimisers), so places are chosen by content, and each window of ``LEAST`` = SEED + WINDOW - 1
words has one kept suffix, at the same place in each of its copies. Suffixes whose seed occurs in one text only are
dropped. The others carry the words that their windows reach to, and are sorted by seed and by these words and
range-partitioned. A task compares each suffix with its neighbour, word by word: a run of neighbours that share k words is
all suffixes that do, so every member of it counts and not the next one alone. Matches are extended to the left in the same
way, over the left contexts, sorted and compared. Two suffixes have a passage of LEAST words or more in common if what
they share to the right and to the left adds up to it; windows that two documents or more have are repeated, wherever and
however often they stand in each, and the least doc_id among exactly these is their first. Windows in a row become spans;
longer passages have kept suffixes all along, so their spans overlap and are joined. Hashes only choose places and bring
suffixes together: words decide. Seeds at the borders of partitions are settled afterwards by an aggregation over their
windows (there named by 128 bits of BLAKE2, as tasks don't have each other's words), so a passage shared by a third of all
documents is spread over many tasks and loses nothing.

Equal texts are one class first: only the least doc_id of each is searched, and copies of a text of LEAST words or more
are repeated as a whole, beside the passages that other texts have first. Nulls and texts under LEAST words have no
passage. Rows that share a doc_id are one document (a result row for each of its texts): passages that only these have in
common are no repeats. Rows without a doc_id can't be told apart: they take no part, and ``cut_repeats`` leaves them as
they are. An empty table gives no rows; extra columns of any names pass through ``cut_repeats``. Very long texts are taken
whole: a task holds one with some numbers for each word, and up to LEAST + WINDOW words for each kept suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_BYTES, chunks, durable, is_small, join_small, mix, packed, shingles

SEED, WINDOW = 16, 35
LEAST = SEED + WINDOW - 1
#: Between the words of a context; the least byte.
SEPARATOR = b"\0"
_SORTED = np.arange(256, dtype=np.uint8)
_SORTED[[0, 32]] = 32, 0
_SORTED[65:91] += 32
SPANS = "doc_id long, begin int, end int, first_doc_id long"


def _least_runs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each window of LEAST words, place of the leftmost least run of SEED words in it, hashes of all runs); places in ``h``."""
    none = np.zeros(0, np.int64)
    if len(h) < LEAST:
        return none, none, h[:0]
    _, s = shingles(np.zeros(len(h), np.int64), h, 1, SEED)  # runs across documents are masked below
    m = len(s)
    ok = doc[:m] == doc[SEED - 1 : SEED - 1 + m]
    s[~ok] = np.uint64(2**64 - 1)
    at = np.lib.stride_tricks.sliding_window_view(s, WINDOW).argmin(axis=1) + np.arange(m - WINDOW + 1)
    inside = np.flatnonzero(doc[: m - WINDOW + 1] == doc[LEAST - 1 : LEAST - 1 + m - WINDOW + 1])
    return inside, at[inside], s


def minimisers(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word place within it, seed hash) of the leftmost least run in each WINDOW of runs of SEED words."""
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    _, at, s = _least_runs(doc, h)
    at = np.unique(at)
    return doc[at], at - begin[doc[at]], s[at]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sig (of the words) of every text of LEAST words or more, with its kept suffixes' seeds and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            for c in chunks(b.column("text")):
                n_docs = len(c.rows)
                doc, _, _, h = c.words()
                count = np.bincount(doc, minlength=n_docs)
                begin = np.cumsum(count) - count
                place = np.arange(len(h)) - begin[doc]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h * np.uint64(x) + place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))]) for x in (0x243F6A8885A308D3, 0x13198A2E03707345)]
                sig = np.stack([x[begin + count] - x[begin] for x in sums], 1)
                d, p, s = minimisers(doc, h, n_docs)
                cut = np.searchsorted(d, np.arange(n_docs + 1))
                long = np.flatnonzero(count >= LEAST)
                offsets = np.concatenate([[0], np.cumsum(cut[long + 1] - cut[long])]).astype(np.int32)
                keep = np.isin(d, long)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(c.rows[long])), pa.array(count[long], pa.int32()), pa.array([sig[i].tobytes() for i in long], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[keep].view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p[keep].astype(np.int32))),
                ], names=["doc_id", "n_words", "sig", "seeds", "places"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n_words int, sig binary, seeds array<long>, places array<int>")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each kept suffix: its place, the offsets of its seed in the windows it stands for, and their words: from the
    seed on, and before it in reversed order."""
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64())
        for c in chunks(b.column("text")):
            doc, s, e, h = c.words()
            count = np.bincount(doc, minlength=len(c.rows))
            begin = np.cumsum(count) - count
            kept = b.column("kept").slice(int(c.rows[0]), len(c.rows))
            place, of = kept.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(c.rows)), kept.value_lengths().to_numpy(zero_copy_only=False))
            inside = place < count[of]  # a doc_id may have texts of several lengths
            flag = np.zeros(len(h) + 1, bool)
            flag[begin[of[inside]] + place[inside]] = True
            i, at, seeds = _least_runs(doc, h)
            i, at = i[flag[at]], at[flag[at]]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            p, first, last = at[cut], i[cut], i[np.append(cut[1:], len(i)) - 1] if len(cut) else cut
            right, left = _contexts(c.data, s, e, p, last + LEAST, first)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(c.rows[doc[p]])), pa.array(seeds[p].view(np.int64)), pa.array(p - begin[doc[p]], pa.int32()), pa.array(p - last, pa.int32()), pa.array(p - first, pa.int32()), pa.array(right, pa.binary()), pa.array(left, pa.binary()),
            ], names=["doc_id", "seed", "place", "near", "far", "right", "left"])


def _contexts(data: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, upto: np.ndarray, since: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each place p, the words from p to ``upto``, and those from p - 1 back to ``since``, each with SEPARATOR between.

    No byte is less than the separator: it is a zero, and zeros in words become blanks, which no word has otherwise.
    """
    if not len(p):
        return [], []
    data = _SORTED[data]

    def joined(order: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All words in this order, and where each begins."""
        size = (e - s)[order] + 1
        begin = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        at = np.arange(len(out)) - np.repeat(begin, size)
        word = at < np.repeat(size - 1, size)
        out[word] = data[(np.repeat(s[order], size) + at)[word]]
        return out.tobytes(), np.append(begin, len(out))

    n = len(s)
    forth, f = joined(np.arange(n))
    back, r = joined(np.arange(n)[::-1])
    right = [forth[x : y - 1] for x, y in zip(f[p].tolist(), f[upto].tolist())]
    left = [back[x : max(x, y - 1)] for x, y in zip(r[n - p].tolist(), r[n - since].tolist())]
    return right, left


def common_words(a: bytes, b: bytes) -> int:
    """How many words two contexts have in common from their beginnings on."""
    if a == b:
        return a.count(SEPARATOR) + 1 if a else 0
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    whole = lo and (lo == len(a) or not a[lo]) and (lo == len(b) or not b[lo])
    return a.count(SEPARATOR, 0, lo) + bool(whole)


class Suffixes:
    """Kept suffixes, sorted by seed and right context, and compared with their neighbours; their left contexts likewise.

    All that share k words to the right stand in a row whose neighbours share k words or more, and so for the left. A
    match of two suffixes reaches as far to the right and to the left as these runs that both are in.
    """

    def __init__(self, t: pa.Table):
        self.doc, self.place, self.near, self.far, seed = (t[c].to_numpy() for c in ("doc_id", "place", "near", "far", "seed"))
        self.right, self.left = t["right"].to_pylist(), t["left"].to_pylist()
        new = np.concatenate([[True], seed[1:] != seed[:-1]])
        self.shared_right = self._neighbours(self.right, np.arange(len(seed)), new)
        group = np.cumsum(new)
        self.order = np.array(sorted(range(len(seed)), key=lambda i: (group[i], self.left[i])), np.int64)
        self.shared_left = self._neighbours(self.left, self.order, np.concatenate([[True], np.diff(group[self.order]) != 0]))

    @staticmethod
    def _neighbours(words: list[bytes], order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Words that each in order shares with the one before it; -1 for the first of a seed."""
        return np.array([-1 if n else common_words(words[i], words[j]) for i, j, n in zip(np.append(order[:1], order[:-1]).tolist(), order.tolist(), new.tolist())], np.int64)

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words left of the seed, rows that stand for such a window, its class: equal for equal windows) for each offset."""
        for left in range(WINDOW):
            rows = np.flatnonzero((self.near <= left) & (left <= self.far))
            if len(rows):
                right = np.cumsum(self.shared_right < LEAST - left)
                run = np.empty(len(self.doc), np.int64)
                run[self.order] = np.cumsum(self.shared_left < left)
                yield left, rows, np.unique(run[rows] * (len(run) + 1) + right[rows], return_inverse=True)[1]

    def digest(self, row: int, left: int) -> bytes:
        """Names a window for tasks that don't have each other's words: 128 bits of BLAKE2."""
        before = self.left[row].split(SEPARATOR, left)[:left]
        after = self.right[row].split(SEPARATOR, LEAST - left)[: LEAST - left]
        return hashlib.blake2b(SEPARATOR.join([*before[::-1], *after]), digest_size=16).digest()


def _extents(doc: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least document, greatest document, a row's place) of each class."""
    o = np.argsort(which, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(which[o]) != 0]))
    return np.minimum.reduceat(doc[o], cut), np.maximum.reduceat(doc[o], cut), o[cut]


def _runs(row: np.ndarray, doc: np.ndarray, begin: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Spans of windows, each given by its row and begin: those in a row with the same first document are one."""
    o = np.lexsort((begin, row))
    row, doc, begin, first = row[o], doc[o], begin[o], first[o]
    new = np.concatenate([[True], (np.diff(begin) != 1) | (np.diff(row) != 0) | (np.diff(first) != 0)]) if len(row) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(row)) - 1 if len(a) else a
    return pa.RecordBatch.from_arrays([pa.array(doc[a], pa.int64()), pa.array(begin[a], pa.int32()), pa.array(begin[z] + LEAST, pa.int32()), pa.array(first[a], pa.int64())], names=["doc_id", "begin", "end", "first_doc_id"])


def _spans(rows: pa.Table) -> pa.RecordBatch:
    """Spans of the windows that two documents or more of ``rows`` have."""
    x = Suffixes(rows)
    found = []
    for left, at, which in x.windows():
        low, high, _ = _extents(x.doc[at], which)
        hit = (low < high)[which]
        found.append((at[hit], x.place[at[hit]] - left, low[which][hit]))
    row, begin, first = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return _runs(row, x.doc[row], begin, first)


_NONE = {"seed": pa.int64(), "place": pa.int32(), "near": pa.int32(), "far": pa.int32(), "right": pa.binary(), "left": pa.binary()}
SETTLED = f"{SPANS}, seed long, place int, near int, far int, right binary, left binary"


def _as_settled(b: pa.RecordBatch) -> pa.RecordBatch:
    """Spans, or open rows, in columns SETTLED."""
    kinds = {"doc_id": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "first_doc_id": pa.int64()} | _NONE
    return pa.RecordBatch.from_arrays([b.column(n) if n in b.schema.names else pa.nulls(b.num_rows, k) for n, k in kinds.items()], names=list(kinds))


def _sorted(b: pa.RecordBatch) -> Suffixes:
    return Suffixes(pa.Table.from_batches([b]).sort_by([("seed", "ascending"), ("right", "ascending")]))


def _named_windows(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Digests of open rows' windows: (w, low, high) of the distinct ones of a batch, or with ``each`` (doc_id, begin, w) of all."""
    for b in batches:
        if not b.num_rows:
            continue
        x = _sorted(b)
        for left, at, which in x.windows():
            low, high, one = _extents(x.doc[at], which)
            w = pa.array([x.digest(int(at[i]), left) for i in one], pa.binary())
            if each:
                yield pa.RecordBatch.from_arrays([pa.array(x.doc[at]), pa.array(x.place[at] - left, pa.int32()), w.take(pa.array(which))], names=["doc_id", "begin", "w"])
            else:
                yield pa.RecordBatch.from_arrays([w, pa.array(low), pa.array(high)], names=["w", "low", "high"])


def _all_spans(got: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The spans of ``_settled``, with those of its open rows: their windows' first documents are broadcast up to ``most`` bytes, else joined by shuffle."""
    border = got.where("seed is not null").select("doc_id", *_NONE)
    firsts = border.mapInArrow(lambda x: _named_windows(x, False), "w binary, low long, high long").groupBy("w").agg(F.min("low").alias("first_doc_id"), F.max("high").alias("last"))
    firsts = durable(firsts.where("first_doc_id < last").drop("last"))
    if is_small(firsts, most):
        table = firsts.toArrow().sort_by("w")  # bounded just above
        shared = got.sparkSession.sparkContext.broadcast((np.array(table["w"].to_pylist(), "S16"), table["first_doc_id"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, first = shared.value
            for b in batches:
                done = pa.compute.is_null(b.column("seed"))
                yield b.filter(done).select(["doc_id", "begin", "end", "first_doc_id"])
                rest = b.filter(pa.compute.invert(done))
                if not len(known) or not rest.num_rows:
                    continue
                x, found = _sorted(rest), []
                for left, at, which in x.windows():
                    *_, one = _extents(x.doc[at], which)
                    w = np.array([x.digest(int(at[i]), left) for i in one], "S16")
                    k = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    hit = (known[k] == w)[which]
                    found.append((at[hit], x.place[at[hit]] - left, first[k][which][hit]))
                row, begin, one = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
                yield _runs(row, x.doc[row], begin, one)

        return got.mapInArrow(run, SPANS)
    apart = border.mapInArrow(lambda x: _named_windows(x, True), "doc_id long, begin int, w binary")
    apart = apart.join(firsts.hint("merge"), "w").select("doc_id", "begin", (F.col("begin") + LEAST).alias("end"), "first_doc_id")
    return got.where("seed is null").select("doc_id", "begin", "end", "first_doc_id").unionByName(apart)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans within a sorted partition; rows of its first and last seed, which neighbours may have too, as they are."""
    held: list[pa.RecordBatch] = []  # rows of the last seed so far
    begun = False
    for b in batches:
        if not b.num_rows:
            continue
        seed = b.column("seed").to_numpy()
        if held and held[-1].column("seed")[0].as_py() == seed[-1]:
            held.append(b)
            continue
        cut = int(np.argmax(seed == seed[-1]))
        done = [*held, b.slice(0, cut)] if cut else held
        held = [b.slice(cut)]
        if done:
            rows = pa.Table.from_batches(done)
            if not begun:
                seed = rows["seed"].to_numpy()
                n = int(np.argmax(seed != seed[0])) if seed[-1] != seed[0] else len(seed)
                yield from map(_as_settled, rows.slice(0, n).to_batches())
                rows, begun = rows.slice(n), True
            if rows.num_rows:
                yield _as_settled(_spans(rows))
    yield from map(_as_settled, held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of rows in order of document, first document and begin: overlapping or touching spans with one first document become one."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64())]))

    def rows(t: pa.Table) -> pa.RecordBatch:
        doc, first, begin, end = (t[n].to_numpy().astype(np.int64) for n in ("doc_id", "first_doc_id", "begin", "end"))
        group = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])])) - 1
        shift = group << 32
        upto = np.maximum.accumulate(end + shift) - shift  # the furthest end so far in the group
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (begin[1:] > upto[:-1])])
        at = np.flatnonzero(new)
        doc, first, begin, end = doc[at], first[at], begin[at], np.maximum.reduceat(end, at)
        o = np.lexsort((first, end, begin, doc))
        doc, first, begin, end = doc[o], first[o], begin[o], end[o]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        each = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(first)], names=["begin", "end", "first_doc_id"])
        return pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), each).cast(kind)], names=["doc_id", "spans"])

    held: list[pa.RecordBatch] = []  # of the last document so far
    for b in batches:
        if not b.num_rows:
            continue
        doc = b.column("doc_id").to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        if cut == 0 and held and held[-1].column("doc_id")[0].as_py() == doc[0]:
            held.append(b)
            continue
        done = [*held, b.slice(0, cut)] if cut else held
        if done:
            yield rows(pa.Table.from_batches(done))
        held = [b.slice(cut)]
    if held:
        yield rows(pa.Table.from_batches(held))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, class_id, copies, repeated_words and spans (words; begin, end, first_doc_id) of documents with a repeated passage.

    Spans with different first documents may overlap; repeated_words counts each word once.
    """
    texts = durable(_texts(docs))
    classes = durable(texts.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("copies")))
    reps = texts.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    suffixes = reps.select("doc_id", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("doc_id", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    shared = suffixes.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("seed")
    # Durable, so that neither side of the join comes from the count's exchange: a hot seed's rows can then be split.
    kept = durable(join_small(suffixes, durable(shared), "seed").groupBy("doc_id").agg(F.collect_list("place").alias("kept")))
    rows = join_small(docs.select("doc_id", "text"), kept, "doc_id")
    rows = durable(rows.mapInArrow(_suffixes, "doc_id long, seed long, place int, near int, far int, right binary, left binary"))
    by = ("seed", "right", "doc_id", "place")
    got = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_settled, SETTLED))
    # Open are seeds at borders: two for each partition, and all rows of a seed that fills several.
    spans = _all_spans(got).repartition("doc_id").sortWithinPartitions("doc_id", "first_doc_id", "begin", "end").mapInArrow(_joined, "doc_id long, spans array<struct<begin:int, end:int, first_doc_id:long>>")
    of = texts.select("doc_id", "n_words", "sig").distinct().join(classes, "sig").join(spans.withColumnRenamed("doc_id", "class_id"), "class_id", "left").where("copies > 1 or spans is not null")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end"), F.col("class_id").alias("first_doc_id")))
    # Beside the whole text, passages that another class has first; those that its own class has first lie within it.
    others = F.coalesce(F.filter("spans", lambda x: x["first_doc_id"] != F.col("class_id")), F.array().cast("array<struct<begin:int, end:int, first_doc_id:long>>"))
    of = of.withColumn("spans", F.when(F.col("copies") > 1, F.array_sort(F.concat(whole, others))).otherwise(F.col("spans")))
    upto = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["begin"]), F.lit(0))).alias("n"))
    return of.select("doc_id", "n_words", "class_id", "copies", F.aggregate("spans", upto, add, lambda a: a["n"]).alias("repeated_words"), "spans")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without passages that an earlier document (by doc_id) has too; words around them stay as they are."""
    again = durable(repeats(docs).select("doc_id", F.filter("spans", lambda x: x["first_doc_id"] < F.col("doc_id")).alias("again")).where("size(again) > 0"))
    d = join_small(packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id")), again, "doc_id", "left").select("row", "again")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = dict(zip(names, b.column("row").flatten()))
            texts = own["text"].to_pylist()
            spans = b.column("again").to_pylist()
            for i, cut in enumerate(spans):
                if cut and texts[i]:
                    raw = texts[i].encode()
                    c = next(iter(chunks(pa.array([texts[i]]))))
                    _, s, e, _ = c.words()
                    parts, at = [], 0
                    for x in cut:
                        parts.append(raw[at : max(at, s[x["begin"]])])
                        at = max(at, e[x["end"] - 1])
                    texts[i] = (b"".join(parts) + raw[at:]).decode("utf-8", "ignore")
            cols = own | {"text": pa.array(texts, own["text"].type)}
            if "n_chars" in names:
                old = own["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if cut and t is not None else o for t, cut, o in zip(texts, spans, old)], own["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return d.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs)
