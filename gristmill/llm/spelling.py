"""Spelling variant grouping with forward and reversed sorted dictionaries.

1. Words are counted in each task before they move; only counts are shuffled.
2. Two words one edit apart, the shorter of m code points, agree up to the edit at p (the length of their common prefix)
   and after it. Either p is at least half of m, and they stand in one range of the forward dictionary (sorted words) that
   shares this prefix, or they share the suffix behind it, and stand in one range of the reversed dictionary. A block is
   such a range: words of m and m + 1 code points, an interval [lo, hi) of places for p, and the intact rest as its key.
3. A block of over ``MOST`` words is subdivided, as often as needed: its interval is halved, and its key grows by the
   code points that are then intact too. In the end one place is left, where the alphabet bounds a block. Sizes are
   counted by aggregation and only oversized blocks are listed, so no block ever comes to one task before it is small.
4. Blocks are range-partitioned and sorted, each task scans its ranges, and pairs of a block are verified code point by
   code point (vectorised). A pair is taken in the block whose interval holds its p, so it counts exactly once.
5. A word's form is its near word of largest count, if that is at least ``RATIO`` times its own. Counts grow along forms,
   so that following them ends; roots are found by pointer doubling over the words that haven't arrived yet.

Words here are runs of letters from A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. ``drop_every`` (97) damages one
occurrence in so many, as the contract asks; 0 takes texts as they are.

A null text has no words; a null doc_id counts as empty. Repeated rows count each. Ties between forms go to the smallest
in code-point order. Very long runs are words like others. Empty table, or no word that is frequent enough: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable, join_small

MIN_CHARS, MIN_COUNT, DROP_EVERY, RATIO = 5, 3, 97, 2
#: Words of a block that are compared with each other.
MOST = 64
#: Distinct words that a task gathers before it hands them on, and bytes that one step of the comparison takes.
GATHER, STEP_BYTES = 400_000, 8 << 20
#: ``[A-Za-zÀ-ÿ]+`` in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
BLOCK = ["m", "lo", "hi", "key"]


# --- words ---------------------------------------------------------------------------------------------------------


def without_one(run: bytes, h: int) -> bytes:
    s = run.decode()
    i = h % len(s)
    return (s[:i] + s[i + 1 :]).encode()


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` code points and ``min_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def gathered() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if n and len(w) >= min_chars and len(w.decode()) >= min_chars]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if not text.is_valid:
                    continue
                runs = RUN.findall(text.as_buffer().to_pybytes().lower())  # bytes: only A-Z are lower-cased
                total.update(runs)
                if drop_every:
                    seen = list(set(runs))
                    begin = crc32(b"" if doc_id is None else b"%d" % doc_id)
                    for w, h in zip(seen, map(crc32, seen, repeat(crc32(b":", begin)))):
                        if not h % drop_every:
                            n = runs.count(w)
                            total[w] -= n
                            total[without_one(w, h)] += n
                if len(total) >= GATHER:
                    yield gathered()
        yield gathered()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- near words ----------------------------------------------------------------------------------------------------


def placed(words: DataFrame, intervals) -> DataFrame:
    """``words(word, n, m, ...)`` once for each of ``intervals`` (an array of structs lo, hi), with the block's key.

    The key is what must be equal before the interval, and behind it from the end on: the beginning of the word, of the
    reversed word, or both. So blocks with lo = 0 are ranges of the reversed dictionary, and those up to the end of the forward one.
    """
    x = words.withColumn("x", F.explode(intervals)).select("word", "n", "m", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    return x.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("lo")), F.reverse(F.right("word", F.greatest(F.col("m") - F.col("hi"), F.lit(0))))))


def interval(lo, hi):
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def blocks(words: DataFrame, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(word, n, m, lo, hi, key): each word in its blocks of at most ``most`` words, or of one place.

    ``words`` is durable; what is built on it is projections and joins with lists of oversized blocks, so that nothing but
    these lists is written.
    """
    lengths = F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda m: m >= min_chars)
    half = lambda lo, hi: F.floor((lo + hi) / 2)
    e = words.select("word", "n", F.explode(lengths).alias("m"))
    e, out = placed(e, F.array(interval(F.lit(0), half(F.lit(0), F.col("m") + 1)), interval(half(F.lit(0), F.col("m") + 1), F.col("m") + 1))), None
    while True:
        large = durable(e.groupBy(*BLOCK).agg(F.count("*").alias("_n")).where((F.col("_n") > most) & (F.col("hi") - F.col("lo") > 1)).select(*BLOCK))
        if large.isEmpty():
            return e if out is None else out.unionByName(e)
        small = join_small(e, large, BLOCK, "left_anti")
        out = small if out is None else out.unionByName(small)
        mid = half(F.col("lo"), F.col("hi"))
        e = join_small(e, large, BLOCK, "left_semi")
        e = placed(e.select("word", "n", "m", F.array(interval(F.col("lo"), mid), interval(mid, F.col("hi"))).alias("_i")), F.col("_i"))


def near_pairs(w: np.ndarray, size: np.ndarray, begin: np.ndarray, m: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of words one edit apart, within blocks of one m.

    ``w``: a row of m + 1 code points for each word, ordered by block and length; ``size`` of each word; ``begin`` of each
    block. Words of m code points are compared with all that follow in their block.
    """
    end = np.append(begin[1:], len(w))
    block = np.repeat(np.arange(len(begin)), end - begin)
    count = np.where(size == m, end[block] - 1 - np.arange(len(w)), 0)
    found_a, found_b = [], []
    step, at = max(1, STEP_BYTES // (m + 1)), 0
    upto = np.cumsum(count)
    while at < len(w):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        c = count[at:to]
        a = np.repeat(np.arange(at, to), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        at = to
        left, right = w[a], w[b]
        same = left[:, :m] == right[:, :m]
        p = np.where(same.all(1), m, same.argmin(1))
        longer = size[b] > m
        tail = np.where(longer[:, None], left[:, :m] == right[:, 1 : m + 1], same)  # what must agree behind the edit
        ok = (tail | (np.arange(m) < (p + ~longer)[:, None])).all(1) & (lo[block[a]] <= p) & (p < hi[block[a]])
        found_a.append(a[ok])
        found_b.append(b[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


PARTIAL = "word string, n_near long, best_n long, best string"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (m, lo, hi, key, size, word, n) -> for each word that has near words here, their number and the best of them."""

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m, lo, hi = (t.column(c).to_numpy() for c in ("m", "lo", "hi"))
        key = t.column("key").combine_chunks()
        new = (np.diff(m) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | ~np.asarray(pa.compute.equal(key[1:], key[:-1]))
        begin = np.concatenate([[0], np.flatnonzero(new) + 1])
        size, n = t.column("size").to_numpy(), t.column("n").to_numpy()
        alone = np.diff(np.append(begin, len(m))) < 2
        live = ~np.repeat(alone, np.diff(np.append(begin, len(m))))
        for one in np.unique(m[live]):
            of = np.flatnonzero(live & (m == one))
            starts = begin[~alone & (m[begin] == one)]
            # blocks are taken some at a time, so that the matrix of their words stays small
            bytes_of = (np.searchsorted(of, starts) * (int(one) + 1)) // STEP_BYTES
            for part in np.unique(bytes_of):
                s = starts[bytes_of == part]
                first = np.searchsorted(of, s)
                nxt = np.searchsorted(starts, s[-1]) + 1
                rows = of[first[0] : (np.searchsorted(of, starts[nxt]) if nxt < len(starts) else len(of))]
                words = t.column("word").take(pa.array(rows)).combine_chunks()
                w = np.array([x.encode("latin-1") for x in words.to_pylist()], f"S{int(one) + 1}").view(np.uint8).reshape(len(rows), -1)
                a, b = near_pairs(w, size[rows], first - first[0], int(one), lo[s], hi[s])
                if len(a):
                    yield best_of(np.concatenate([a, b]), np.concatenate([b, a]), n[rows], words)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        last, k = {c: t.column(c)[-1] for c in BLOCK}, t.num_rows
        same = pa.compute.equal(t.column("key"), last["key"])
        for c in ("m", "lo", "hi"):
            same = pa.compute.and_(same, pa.compute.equal(t.column(c), last[c]))
        k -= int(np.asarray(same)[::-1].argmin()) if not np.asarray(same).all() else k
        held = t.slice(k)
        if k:
            yield from settled(t.slice(0, k))
    if held is not None:
        yield from settled(held)


def best_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """For each word a of pairs (a, b): how many b, and the b of largest n (ties: smallest)."""
    rank = np.empty(len(words), np.int64)
    rank[np.asarray(pa.compute.sort_indices(words.cast(pa.binary())))] = np.arange(len(words))
    o = np.lexsort((rank[b], -n[b], a))
    a, b = a[o], b[o]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return pa.RecordBatch.from_arrays([words.take(pa.array(a[first])), pa.array(np.diff(np.append(first, len(a)))), pa.array(n[b[first]]), words.take(pa.array(b[first]))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(word, n_near, form, form_n) of the words (durable ``words(word, n)``) with a near word; form is the best of them."""
    e = blocks(words, min_chars, most).select(*BLOCK, F.char_length("word").alias("size"), "word", "n")
    e = e.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "size", "word")
    best = e.mapInArrow(scan, PARTIAL).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("x"))
    return best.select("word", "n_near", "x.form", (-F.col("x.n")).alias("form_n"))


# --- groups --------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from durable ``forms(word, form)`` without cycles: the last word that forms lead to."""
    known, arrived = forms.select("word", F.col("form").alias("root")), None
    moving = known
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(moving.join(after, "root", "left"))
        done = step.where("next is null").select("word", "root")
        arrived = done if arrived is None else arrived.unionByName(done)
        moving = step.where("next is not null").select("word", F.col("next").alias("root"))
        if moving.isEmpty():
            return arrived
        known = arrived.unionByName(moving)


def group(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words(word, n)``."""
    words = durable(words)
    x = durable(words.join(near_words(words, min_chars, most), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    r = roots(x.where("form is not null").select("word", "form"))
    return x.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return group(count_words(docs))
