"""Benchmark decontamination by greedy string tiling.

Tests and documents are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``. A seed is as many words in a row as
the least tile has, or the whole test if it is shorter. A tile of k words holds k / seed of the test's seeds at least, so
a document with fewer than ``needed`` of them, by the threshold, can't be a leak. One that has so many has one at least of
any ``seeds - needed + 1`` of them: documents meet a test by its rarest ones only (in the benchmark; a choice that changes
the work and never the result), so that phrases that a great many tests share fall away. Who meets a test is counted over
all its seeds, and who has enough is tiled: the longest matches of the test in the document that
overlap no earlier tile are marked first, found with running Karp-Rabin (window hashes at a search length that jumps up
when a much longer match turns up and then halves down to the least tile). The part of the test's words under tiles is
its coverage, so a test whose sentences were put in another order still counts. From ``threshold`` on it is a leak.
Words that repeat are stepped over: a match is looked at from where it begins only, all its places in the text at once.

If the benchmark has up to ``BROADCAST_WORDS`` words (counted first), its seeds and words are broadcast and one pass over
the documents finds and tiles; else seeds are joined by shuffle, and only documents with enough shared seeds are tiled.

Nulls and texts without words match nothing. Rows without a doc_id are tiled as others and reported with a null one.
Repeated rows of documents (doc_id and text) give one result, and ``clean`` judges each row by its text; a test listed
under two ids gives a row for each, an id with several texts counts by the one that is covered most; tests without an id
are left out. Ties between matches go to the earlier words. Empty tables: no rows. Extra columns are ignored. Very long
texts are tiled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.llm.common import by_document, chunks, durable, join_small, mix, packed, shingles

LEAST_TILE, THRESHOLD, FIRST_LENGTH = 3, 0.5, 20
BROADCAST_WORDS = 4_000_000
#: Words that are compared in one step.
STEP = 1 << 22
RESULT = "key long, doc_id long, item_id long, coverage double, n_tiles long, tiles array<struct<item_word:int, doc_word:int, words:int>>"
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Windows:
    """Karp-Rabin hashes of all windows of any length of a word sequence."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.power = np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD)]).cumprod(dtype=np.uint64)
        self.inverse = np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))]).cumprod(dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[:n])])

    def hashes(self, s: int) -> np.ndarray:
        return mix((self.sums[s:] - self.sums[:-s]) * self.inverse[: len(self.sums) - s])


def unmarked(marked: np.ndarray, s: int) -> np.ndarray:
    """Whether a window of s words from each place on has no marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[s:] == sums[:-s]


def match_lengths(test: np.ndarray, text: np.ndarray, p: int, at: np.ndarray) -> np.ndarray:
    """How many words from ``p`` of the test on stand at each place ``at`` of the text, which goes on for a test's length without any."""
    same = np.lib.stride_tricks.sliding_window_view(text, len(test) - p)[at] == test[p:]
    return np.where(same.all(1), len(test) - p, same.argmin(1))


def tile(test: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in the test, place in the text, words), none overlapping another in either."""
    least = max(1, min(least, len(test)))
    p_marked, t_marked = np.zeros(len(test), bool), np.zeros(len(text), bool)
    p_windows, t_windows = Windows(test), Windows(text)
    # Words as small numbers; one that is marked, or that the test doesn't have, equals none on the other side.
    known = np.unique(test)
    small = np.int16 if len(known) < 1 << 15 else np.int64
    p_code, at = np.searchsorted(known, test).astype(small), np.minimum(np.searchsorted(known, text), len(known) - 1)
    t_code = np.append(np.where(known[at] == text, at, -1), np.full(len(test), -1)).astype(small)
    tiles: list[tuple[int, int, int]] = []
    under = 0  # words of the test
    s = max(least, min(FIRST_LENGTH, len(test)))
    while s >= least:
        found = [np.zeros((3, 0), np.int64)]  # lengths, places in the test, places in the text
        if s <= min(len(test), len(text)):
            ph, th = p_windows.hashes(s), t_windows.hashes(s)
            ps, ts = np.flatnonzero(unmarked(p_marked, s)), np.flatnonzero(unmarked(t_marked, s))
            ts = ts[np.isin(th[ts], ph[ps])]
            ts = ts[np.argsort(th[ts], kind="stable")]
            lo, hi = np.searchsorted(th[ts], ph[ps], "left"), np.searchsorted(th[ts], ph[ps], "right")
            for p, a, b in zip(ps[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                at = ts[a:b]
                if p and not p_marked[p - 1]:  # leave out what is part of a longer match that begins before
                    at = at[(at == 0) | (t_code[at - 1] != p_code[p - 1])]
                for part in np.array_split(at, len(at) * (len(test) - p) // STEP + 1) if len(at) else ():
                    k = match_lengths(p_code, t_code, p, part)
                    found.append(np.stack([k, np.full(len(k), p), part])[:, k >= s])
        found = np.concatenate(found, axis=1)
        longest = int(found[0].max(initial=0))
        if longest > 2 * s:
            s = longest
            continue
        found = found[:, np.lexsort((found[2], found[1], -found[0]))]
        queue: dict[int, list[tuple[int, int]]] = {}
        for k in range(longest, s - 1, -1):
            a, b = np.searchsorted(-found[0], [-k, 1 - k])
            for p, t in chain(zip(found[1, a:b].tolist(), found[2, a:b].tolist()), queue.get(k, ())):
                if under == len(test):
                    return sorted(tiles)
                if not p_marked[p : p + k].any() and not t_marked[t : t + k].any():
                    p_marked[p : p + k] = t_marked[t : t + k] = True
                    p_code[p : p + k], t_code[t : t + k] = -2, -3
                    tiles.append((p, t, k))
                    under += k
                else:  # what is left free of it, if long enough, waits its turn
                    free = np.flatnonzero(np.diff(np.concatenate([[True], p_marked[p : p + k] | t_marked[t : t + k], [True]]).astype(np.int8)))
                    for a2, b2 in zip(free[::2].tolist(), free[1::2].tolist()):
                        if s <= b2 - a2 < k:
                            queue.setdefault(b2 - a2, []).append((p + a2, t + a2))
        s = s // 2 if s > 2 * least else least if s > least else 0
    return sorted(tiles)


def seeds_needed(n: int, k: int, threshold: float) -> int:
    """Seeds of k words that a document of enough coverage has at least, of a test of n words."""
    return max(1, math.ceil(threshold * n / k - 1e-6))


def rarest(times: np.ndarray, df: np.ndarray, needed: int) -> np.ndarray:
    """Which of a test's distinct seeds, ``times`` in it and in ``df`` tests, every document with ``needed`` of them meets: the
    rarest, until those left out are fewer than ``needed``."""
    o = np.argsort(df, kind="stable")
    kept = np.zeros(len(times), bool)
    kept[o[: int(np.searchsorted(np.cumsum(times[o]), int(times.sum()) - needed + 1)) + 1]] = True
    return kept


class Benchmark:
    """The tests' word hashes, their seeds, and in order of hash the rarest of each test's."""

    def __init__(self, ids: list[int], texts: pa.Array, threshold: float = THRESHOLD, least: int = LEAST_TILE):
        self.words: dict[int, list[np.ndarray]] = {}
        each: dict[int, list[tuple[np.ndarray, np.ndarray, int, int]]] = {}
        #: For each text of an item: the seeds' length, distinct seeds, their number each, and what a leak needs.
        self.texts: dict[int, list[tuple[int, np.ndarray, np.ndarray, int]]] = {}
        for c in chunks(texts):
            doc, _, _, h = c.words()
            for i, row in enumerate(c.rows):
                w = h[doc == i]
                if len(w) and ids[row] is not None:
                    k = max(1, min(least, len(w)))
                    self.words.setdefault(ids[row], []).append(w)
                    own = (*np.unique(shingles(np.zeros(len(w), np.int64), w, 1, k)[1], return_counts=True), seeds_needed(len(w), k, threshold))
                    self.texts.setdefault(ids[row], []).append((k, *own))
                    each.setdefault(k, []).append((*own, ids[row]))
        self.seeds = {}
        for k, tests in each.items():
            every, df = np.unique(np.concatenate([h for h, *_ in tests]), return_counts=True)
            rare = [(h[kept], i) for h, times, needed, i in tests for kept in [rarest(times, df[np.searchsorted(every, h)], needed)]]
            h, item = np.concatenate([x for x, _ in rare]), np.concatenate([np.full(len(x), i) for x, i in rare])
            o = np.argsort(h, kind="stable")
            mask = np.zeros(1 << 16, bool)
            mask[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.seeds[k] = (h[o], item[o], mask)

    def meet(self, doc: np.ndarray, h: np.ndarray, n_docs: int) -> set[tuple[int, int]]:
        """(document, item) that share seeds enough."""
        out = set()
        of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (seed, item, mask) in self.seeds.items():
            if len(h) < k:
                continue
            d, s = of[k] = by_document(*shingles(doc, h, n_docs, k))
            some = np.flatnonzero(mask[(s & np.uint64(0xFFFF)).astype(np.int64)])
            lo, hi = np.searchsorted(seed, s[some], "left"), np.searchsorted(seed, s[some], "right")
            n = hi - lo
            met = np.stack([np.repeat(d[some], n), item[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]], 1)
            for one, i in np.unique(met, axis=0).tolist():
                if (one, i) not in out:
                    a, b = np.searchsorted(d, [one, one + 1])
                    if any(enough(s[a:b], *x[1:]) for x in self.texts[i] if x[0] == k):
                        out.add((one, i))
        return out


def enough(doc_seeds: np.ndarray, seeds: np.ndarray, times: np.ndarray, needed: int) -> bool:
    """Whether a document with these (sorted) seeds has as many of a test's as a leak needs."""
    if not len(doc_seeds):
        return False
    at = np.minimum(np.searchsorted(doc_seeds, seeds), len(doc_seeds) - 1)
    return int(times[doc_seeds[at] == seeds].sum()) >= needed


def _batch(found: list[tuple]) -> pa.RecordBatch:
    """Rows of RESULT from (key, doc_id, item_id, coverage, tiles)."""
    kind = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))
    tiles = [[{"item_word": p, "doc_word": t, "words": k} for p, t, k in x[4]] for x in found]
    return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.int64()) for i in range(3)), pa.array([x[3] for x in found], pa.float64()), pa.array([len(x[4]) for x in found], pa.int64()), pa.array(tiles, kind)], names=["key", "doc_id", "item_id", "coverage", "n_tiles", "tiles"])


def covers(words: list[np.ndarray], text: np.ndarray, least: int) -> tuple[float, list]:
    """The largest coverage of an item's texts (one, unless its id repeats), with the tiles."""
    each = [(sum(k for *_, k in x) / len(w), x) for w in words for x in [tile(w, text, least)]]
    return max(each, key=lambda x: x[0])


def _key(of: str = "") -> Column:
    """Names a row by doc_id and text; rows of one key are all tiled each by itself."""
    return F.xxhash64(F.col(f"{of}doc_id").cast("long"), f"{of}text").alias("key")


def _benchmark(benchmark: DataFrame, threshold: float, least: int, broadcast_words: int) -> tuple[DataFrame, Broadcast | None]:
    """The tests, and what a task needs of them if they are few (measured first)."""
    bench = durable(benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    if size > broadcast_words:
        return bench, None
    rows = bench.orderBy("item_id", "text").collect()  # bounded just above
    return bench, bench.sparkSession.sparkContext.broadcast(Benchmark([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), threshold, least))


def _found(b: Benchmark, texts: pa.Array, threshold: float, least: int) -> Iterator[tuple[int, int, float, list]]:
    """(row, item, coverage, tiles) of the leaks among some texts."""
    for c in chunks(texts):
        doc, _, _, h = c.words()
        for d, item in sorted(b.meet(doc, h, len(c.rows))):
            x, y = np.searchsorted(doc, [d, d + 1])
            coverage, tiles = covers(b.words[item], h[x:y], least)
            if coverage >= threshold:
                yield int(c.rows[d]), item, coverage, tiles


def _joined(docs: DataFrame, bench: DataFrame, threshold: float, least: int) -> DataFrame:
    """RESULT by a shuffled join of seeds, for a benchmark that can't be broadcast; ``docs`` has key, doc_id and text."""
    lengths = sorted(x[0] for x in bench.select(F.least(F.lit(max(1, least)), F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).distinct().collect() if x[0])

    def seeds(name: str, pick: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(name).cast(pa.int64())
                for c in chunks(batch.column("text")):
                    doc, _, _, h = c.words()
                    count = np.bincount(doc, minlength=len(c.rows))
                    for k in lengths:
                        d, s = shingles(doc, h, len(c.rows), k)
                        if pick:
                            keep = np.minimum(count, max(1, least))[d] == k
                            d, s = d[keep], s[keep]
                            needed = pa.array([seeds_needed(n, k, threshold) for n in count[d].tolist()], pa.int64())
                        else:
                            d, s = by_document(d, s)
                            needed = pa.nulls(len(d), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), ids.take(pa.array(c.rows[d])), needed], names=["seed", name, "needed"])

        return run

    # An item id with several texts is told apart by the text's hash. Of each test's seeds the rarest are joined, as in
    # ``rarest``. Durable, so that neither side of the join comes from an aggregation's exchange: a hot seed's rows can be split.
    one = bench.select("item_id", "text", F.xxhash64("item_id", "text").alias("test"))
    item_seeds = one.select("test", "text").mapInArrow(seeds("test", True), "seed long, test long, needed long").groupBy("seed", "test").agg(F.count("*").alias("times"), F.max("needed").alias("needed"))
    item_seeds = durable(item_seeds)
    df = durable(item_seeds.groupBy("seed").agg(F.count("*").alias("df")))
    of = W.partitionBy("test")  # the seeds of one test
    rare = item_seeds.join(df.hint("merge"), "seed").withColumn("before", F.sum("times").over(of.orderBy("df", "seed")) - F.col("times")).withColumn("all", F.sum("times").over(of))
    rare = durable(rare.where("before <= all - needed").select("seed", "test"))
    doc_seeds = docs.select("key", "text").mapInArrow(seeds("key", False), "seed long, key long, needed long").select("seed", "key")
    meet = durable(doc_seeds.join(rare.hint("merge"), "seed").select("key", "test").distinct().join(one.select("test", "item_id"), "test").select("key", "item_id").distinct())
    texts = join_small(docs, meet, "key").join(bench.withColumnRenamed("text", "item"), "item_id").select("key", "doc_id", "item_id", "text", "item")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                w = [next(iter(chunks(batch.column(n).slice(i, 1)))).words()[3] for n in ("item", "text")]
                k = max(1, min(least, len(w[0])))
                (own, times), has = (np.unique(shingles(np.zeros(len(x), np.int64), x, 1, k)[1], return_counts=True) for x in w)
                coverage, tiles = covers([w[0]], w[1], least) if len(w[0]) and enough(has[0], own, times, seeds_needed(len(w[0]), k, threshold)) else (0.0, [])
                if coverage >= threshold:
                    found.append((*(batch.column(n)[i].as_py() for n in ("key", "doc_id", "item_id")), coverage, tiles))
            yield _batch(found)

    return texts.mapInArrow(each, RESULT)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_TILE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each document and test with coverage of ``threshold`` or more: coverage, and the tiles in words."""
    bench, shared = _benchmark(benchmark, threshold, least, broadcast_words)
    rows = docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key"), batch.column("doc_id")
            yield _batch([(keys[i].as_py(), ids[i].as_py(), *x) for i, *x in _found(shared.value, batch.column("text"), threshold, least)])

    found = _joined(rows, bench, threshold, least) if shared is None else rows.mapInArrow(run, RESULT)
    best = found.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("coverage", "n_tiles", "tiles")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_TILE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` without rows that leak a test: found and left out in one pass if the benchmark is broadcast."""
    bench, shared = _benchmark(benchmark, threshold, least, broadcast_words)
    if shared is None:
        gone = durable(_joined(docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), "text"), bench, threshold, least).select("key").distinct())
        return join_small(packed(docs).select("row", _key("row.")), gone, "key", "left_anti").select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, *_ in _found(shared.value, batch.column("text"), threshold, least)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
