"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact, returning components and link counts.

A document is the set of its k-word shingles (64-bit hashes). Two link when ``100 * |A and B| >= percent * |A or B|``.

1. Rows with the same set are one class; one of its rows stands for it and everything below works on classes.
2. A class of n shingles must share ``t = ceil(percent * n / 100)`` with any partner. Of its shingles in hash order, the
   first ``n - t + e`` (e = ceil((100 - percent) * n / 100)), its head, hold at least ``T = ceil(percent * (100 - percent)
   * n / 10000)`` of those they share. This is a T-occurrence problem over the heads' inverted lists; DivideSkip leaves
   the ``L = T - 1`` longest lists of each head unmerged, so partners meet in one short list at least. Shingles of one
   class alone are dropped. No frequency is estimated; no list is cut.
3. Classes that meet in a short list are put into one cluster (components over list leaders: linear in the lists'
   lengths); every link lies within a cluster. A cluster of up to ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles is searched
   whole, many to a task. Hot tokens, found in a sample, are joined by broadcast, with the sample's estimate for their rarity
   and a lead that is no row, so that none fills a task.
   Short texts meet by chance in common phrases, and the more rows, the more of them are one cluster. So the classes of a
   cluster of over ``FINE`` blocks are dealt anew: rarity is that of all shingles of their full sets among these classes, and of
   n shingles the ``n - t + 1`` rarest (DivideSkip's ``L = t - 1``) make the short lists. Those that meet nobody there leave.
4. A larger cluster is searched in the way that compares less, by the lists' lengths. Dense (near copies of one text):
   blocks of some ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles, against those blocks whose sizes allow a link, so that a pair meets once. Sparse
   (texts that quote each other): list by list; a task holds the heads of some lists' members, a list over ``BLOCK`` is
   split into pairs of blocks; T-occurrence over the heads gives candidates, each from the first list they share, and
   their full sets are compared afterwards. So work follows the squares of the short lists' lengths.
5. A search is DivideSkip over full sets (heads in step 4's lists): merge the short lists (sorted runs), keep classes
   found ``T - L`` times or more, probe the L long lists by binary search, keep those with the overlap. Tasks return
   spanning forests of the links, and link counts, never all pairs.
6. Components of those links give the result.

Nulls and texts without words have the empty set and link with nothing. A row without a doc_id gets the component of the
rows with its set that have one (null if there are none; such a set links with nothing). Rows that share a doc_id are
judged each by its own text. Repeated rows are returned each. Empty table: no rows. Extra columns are ignored. Very long
texts are taken whole: a class is in memory with its full set in one task for each block it is searched against.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gristmill.llm.common import by_document, chunks, durable, is_small, join_small, mix, packed, shingles
from gristmill.llm.components import components, forest

#: Classes that are searched against each other at once, and shingles that small clusters in one task have together.
BLOCK, TASK_SHINGLES = 512, 500_000
#: Shingles of a block (8 bytes each, some five times that while it is searched); a longer text is a block of its own.
BLOCK_SHINGLES = 4_000_000
#: Binary searches in long lists that are done in one step.
PROBES = 1 << 18
#: Tokens that are sampled to find hot ones (or a part of all, if that is more), and occurrences in the sample that make one
#: hot. A token that is missed or taken for hot changes the work only.
SAMPLED, SAMPLED_PART, HOT = 2_000_000, 1e-4, 200
#: Blocks of a cluster beyond which its classes are dealt anew by their full sets; up to that, comparing its blocks costs less.
FINE = 16
#: A large cluster is searched list by list if that meets so many times fewer pairs.
SPARSE = 4
SET = "row long, key long, doc_id long, n_shingles long, sig binary, head array<long>"
TASK = "struct<cluster:bigint,b1:int,s1:int,b2:int,s2:int>"
PARTS = "row long, n_shingles long, n_hot long, hot array<long>, cold array<long>"
FULL = f"row long, doc_id long, task {TASK}, shingles binary"


def set_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the head, shingles of the head that any partner shares) of sets of n; no head where only an equal set could link."""
    t = -(-percent * n // 100)
    e = -(-(100 - percent) * n // 100)
    f = np.maximum(1, -(-percent * (100 - percent) * n // 10000))
    return np.where((t >= n) & (100 * n // percent <= n), 0, np.minimum(n, n - t + e)), f


def signatures(s: np.ndarray, cut: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; None for the empty one."""
    n = np.diff(cut)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(x)))]) for x in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    one, two = (x[cut[1:]] - x[cut[:-1]] for x in sums)
    sig = np.stack([one, two + n.astype(np.uint64)], 1)
    return [x.tobytes() if k else None for x, k in zip(sig, n.tolist())]


def text_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shingles in order by row, where each row's begin and the last ends) for some whole texts at a time."""
    for c in chunks(texts):
        wdoc, _, _, h = c.words()
        doc, s = by_document(*shingles(wdoc, h, len(c.rows), k))
        yield c.rows, s, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(c.rows)))])


def row_sets(k: int, percent: int):
    """A row for each document: a number of its own, its set's size, signature and head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            for rows, s, cut in text_sets(b.column("text"), k):
                n = np.diff(cut)
                keys = b.column("key").take(pa.array(rows))
                head, _ = set_sizes(n, percent)
                ends = np.cumsum(head)
                first = s[np.arange(int(ends[-1])) + np.repeat(cut[:-1] - (ends - head), head)]
                heads = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(rows))), keys, ids.take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(signatures(s, cut), pa.binary()), heads], names=["row", "key", "doc_id", "n_shingles", "sig", "head"])
                at += len(rows)

    return run


def full_sets(k: int):
    """The full sets of (doc_id, text, row, sig, task), where the text's signature is sig; one of each row in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            wanted, number = b.column("sig").to_pylist(), b.column("row").to_pylist()
            for rows, s, cut in text_sets(b.column("text"), k):
                keep = []
                for i, x in enumerate(signatures(s, cut)):
                    if x is not None and x == wanted[rows[i]] and number[rows[i]] not in seen:
                        seen.add(number[rows[i]])
                        keep.append(i)
                at = pa.array(rows[keep], pa.int64())
                sets = pa.array([s[cut[i] : cut[i + 1]].tobytes() for i in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at).cast(pa.int64()), b.column("task").take(at), sets], names=["row", "doc_id", "task", "shingles"])

    return run


def set_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of (row, shingles) as lists, with their sizes."""
    for b in batches:
        sets = b.column("shingles").to_pylist()
        cut = np.concatenate([[0], np.cumsum([len(x) // 8 for x in sets], dtype=np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.frombuffer(b"".join(sets), np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(cut)), lists], names=["row", "n_shingles", "head"])


def without_hot(tokens: np.ndarray, rank: np.ndarray, percent: int):
    """Sets as lists without the hot ``tokens`` (sorted), how many these were, and as many of them, rarest first, as a set's short lists may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = b.column("n_shingles").to_numpy(), b.column("head").flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            is_hot = tokens[at] == s if len(tokens) else np.zeros(len(s), bool)
            o = np.lexsort((rank[at[is_hot]], owner[is_hot]))
            of, hot, n_hot = owner[is_hot][o], s[is_hot][o], np.bincount(owner[is_hot], minlength=len(n))
            some = np.arange(len(of)) - np.repeat(np.cumsum(n_hot) - n_hot, n_hot) < (n + percent * -n // 100 + 1)[of]
            lists = []
            for who, what in ((of[some], hot[some]), (owner[~is_hot], s[~is_hot])):
                ends = np.cumsum(np.bincount(who, minlength=len(n)))
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(what)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_shingles"), pa.array(n_hot), *lists], names=["row", "n_shingles", "n_hot", "hot", "cold"])

    return run


def of_sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, int, bool]:
    """(rows of a task by side and number, each once; how many are looked up; whether among themselves).

    Side 0 is looked up in side 1; a task of side -1 alone compares its rows with each other.
    """
    t = pa.Table.from_batches(list(batches)).sort_by([("side", "ascending"), ("row", "ascending")])
    side, row = t["side"].to_numpy(), t["row"].to_numpy()
    t = t.filter(pa.array(np.concatenate([[True], (side[1:] != side[:-1]) | (row[1:] != row[:-1])])))
    side = t["side"].to_numpy()
    return t, int((side <= 0).sum()), bool(side[0] < 0)


class Lists:
    """Inverted lists over some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        o = np.argsort(tokens, kind="stable")
        self.owner = owner[o]
        self.tokens, self.begin = np.unique(tokens[o], return_index=True)
        self.end = np.append(self.begin[1:], len(o)).astype(np.int64)
        #: (list, set) of all entries as one ascending number, so that many lists are probed at once.
        self.entry = np.repeat(np.arange(len(self.tokens)), self.end - self.begin) * len(sets) + self.owner

    def occur(self, query: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, shared) of all sets that share ``t`` shingles or more with the query, by DivideSkip."""
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, query)
        at = at[: np.searchsorted(at, len(self.tokens))]  # both are sorted
        at = at[self.tokens[at] == query[: len(at)]]
        if len(at) < t:
            return none, none
        size = self.end[at] - self.begin[at]
        o = np.argsort(size, kind="stable")
        at, size = at[o], size[o]
        # L: as many of the longest lists as pay, at most t - 1 (the paper's estimate t / (mu log2 M + 1), mu = 1/16)
        n_long = min(t - 1, int(t / (np.log2(size[-1] + 1) / 16 + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        size = size[: len(short)]
        runs = self.owner[np.arange(int(size.sum())) + np.repeat(self.begin[short] - (np.cumsum(size) - size), size)]
        runs = np.sort(runs, kind="stable")  # merges sorted runs
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else none
        found, count = runs[first], np.diff(np.append(first, len(runs)))
        ok = count >= t - n_long
        found, count = found[ok], count[ok]
        if len(found):
            step = max(1, PROBES // len(found))
            for i in range(0, len(long), step):
                wanted = long[i : i + step, None] * len(self.n) + found
                p = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
                count = count + (self.entry[p] == wanted).sum(axis=0)
        ok = count >= t
        return found[ok], count[ok]

    def search(self, query: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, shared) of all sets that link with the query."""
        q = len(query)
        found, count = self.occur(query, max(1, -(-percent * q // 100)))
        ok = 100 * count >= percent * (q + self.n[found] - count)
        return found[ok], count[ok]


def search_blocks(percent: int):
    """Links between side 0 and side 1, or within side -1: a spanning forest (a, b, 0) and counts (a, a, links), by doc_id."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, cut, within = of_sides(batches)
        ids, sets = t["doc_id"].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]]
        lists = Lists(sets if within else sets[cut:])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(cut):
            j = lists.search(sets[i], percent)[0] + (0 if within else cut)
            a.append(np.full(len(j), i))
            b.append(j)
        a, b = np.concatenate(a), np.concatenate(b)
        own = a != b
        a, b = a[own], b[own]
        degree = np.bincount(a, minlength=len(ids)) + (0 if within else np.bincount(b, minlength=len(ids)))
        node, least = forest(a, b)
        node, least = node[node != least], least[node != least]
        some = np.flatnonzero(degree)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[node], ids[some]])), pa.array(np.concatenate([ids[least], ids[some]])), pa.array(np.concatenate([np.zeros(len(node), np.int64), degree[some]]))], names=["a", "b", "links"])

    return run


def search_heads(percent: int):
    """(a, b) of classes whose heads share as many shingles as a link asks for, from the task of the first list that both are in."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, cut, within = of_sides(batches)
        rows, n = t["row"].to_numpy(), t["n_shingles"].to_numpy()
        heads, listed, own = ([x.values.to_numpy() for x in t[name]] for name in ("head", "listed", "own"))
        heads = [x.view(np.uint64) for x in heads]
        _, need = set_sizes(n, percent)
        offset = 0 if within else cut
        lists = Lists(heads[offset:])
        a, b = [], []
        for i in range(cut):
            j, count = lists.occur(heads[i], int(need[i]))
            j = j + offset
            ok = (count >= need[j]) & (percent * n[j] <= 100 * n[i]) & (percent * n[i] <= 100 * n[j]) & (~np.bool_(within) | (j > i))
            for x in j[ok].tolist():
                both = np.intersect1d(listed[i], listed[x])
                if len(both) and both[0] in own[i]:
                    a.append(rows[i])
                    b.append(rows[x])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def compare(percent: int):
    """Those of (ra, rb, a, b, one, two), rows, doc_ids and full sets, that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for one, two in zip(x.column("one"), x.column("two")):
                one, two = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield x.select(["ra", "rb", "a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sparse_links(listed: DataFrame, lists: DataFrame, heads: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b, links) as of ``search_blocks`` for clusters that are searched list by list.

    ``listed(row, cluster, token)`` and ``lists(cluster, token, m, load, entries)``, m members of as many entries in all, are of
    these clusters; a list is ``load`` blocks, and a task takes lists of some ``8 * block`` entries together.
    """
    some = F.pmod(F.xxhash64("token"), F.ceil(F.col("entries") / (8 * block)))
    lists = lists.select("cluster", "token", F.ceil("load").cast("int").alias("salts"), some.cast("long").alias("some"))
    of = listed.join(lists, ["cluster", "token"])
    whole = of.where("salts = 1").select("row", "cluster", F.col("some").alias("list"), F.lit(0).alias("s1"), F.lit(0).alias("s2"), F.lit(-1).alias("side"), "token")
    salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    parts = of.where("salts > 1").select("row", "cluster", F.col("token").alias("list"), salt.alias("s"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("o"), "token")
    parts = parts.select("row", "cluster", "list", F.least("s", "o").alias("s1"), (F.greatest("s", "o") + 1).alias("s2"), side("s", "o").alias("side"), "token")
    key = ["cluster", "list", "s1", "s2"]
    tasks = whole.unionByName(parts).groupBy(*key, "side", "row").agg(F.collect_list("token").alias("own"))
    own = listed.groupBy("row").agg(F.collect_list("token").alias("listed")).join(heads, "row")
    pairs = durable(tasks.join(own, "row").groupBy(*key).applyInArrow(search_heads(percent), "a long, b long"))
    one, two = (full.select(F.col("row").alias(r), F.col("doc_id").alias(d), F.col("shingles").alias(v)) for r, d, v in (("ra", "a", "one"), ("rb", "b", "two")))
    sets = pairs.withColumnsRenamed({"a": "ra", "b": "rb"}).join(one, "ra").join(two, "rb").select("ra", "rb", "a", "b", "one", "two")
    found = durable(sets.mapInArrow(compare(percent), "ra long, rb long, a long, b long").dropDuplicates(["ra", "rb"]))
    degree = found.select("a").unionAll(found.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    return found.select("a", "b", F.lit(0).cast("long").alias("links")).unionByName(degree.select("a", F.col("a").alias("b"), "links"))


def side(own: str, other: str) -> Column:
    """Of a row of one salt in the task of its salt and another one."""
    return F.when(F.col(own) == F.col(other), -1).otherwise((F.col(own) > F.col(other)).cast("int"))


def size_bands(sized: DataFrame, percent: int) -> DataFrame:
    """``sized`` with band: partners' sizes are in the same or a neighbouring one."""
    return sized.withColumn("band", F.floor(F.log("n_shingles") / float(np.log(100 / percent * 1.000001))).cast("int"))


def dense_tasks(sized: DataFrame, bands: DataFrame, block: int) -> DataFrame:
    """(row, task, side) of clusters cut into groups of neighbouring size bands, some ``block`` rows each, and salts where a band has more.

    ``bands(cluster, band, load)`` has how many blocks its rows are, so its windows are over some hundred rows of a cluster,
    however large that is. A row is in its group's tasks; those at a group's edge are also compared with the neighbouring band.
    """
    by = W.partitionBy("cluster").orderBy("band")
    bands = bands.withColumn("g", F.floor(F.sum("load").over(by) - F.col("load")))
    groups = bands.groupBy("cluster", "g").agg(F.min("band").alias("low"), F.max("band").alias("high"), F.ceil(F.sum("load")).cast("int").alias("salts"))
    by = W.partitionBy("cluster").orderBy("g")
    for way, f in (("next", F.lead), ("prior", F.lag)):
        for name in ("g", "low", "high", "salts"):
            groups = groups.withColumn(f"{way}_{name}", f(name).over(by))
    groups = durable(bands.select("cluster", "band", "g").join(groups, ["cluster", "g"]))
    d = join_small(sized, groups, ["cluster", "band"]).withColumn("s", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))

    def task(g1: str, g2: str, s1: Column, s2: Column) -> Column:
        return F.struct("cluster", F.col(g1).cast("int").alias("b1"), s1.alias("s1"), F.col(g2).cast("int").alias("b2"), s2.alias("s2")).alias("task")

    salts = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1)).alias("o")
    own = d.select("*", salts("salts")).select("row", task("g", "g", F.least("s", "o"), F.greatest("s", "o")), side("s", "o").alias("side"))
    up = d.where("band = high and next_low = high + 1").select("*", salts("next_salts")).select("row", task("g", "next_g", F.col("s"), F.col("o")), F.lit(0).alias("side"))
    down = d.where("band = low and prior_high = low - 1").select("*", salts("prior_salts")).select("row", task("prior_g", "g", F.col("o"), F.col("s")), F.lit(1).alias("side"))
    return own.unionByName(up).unionByName(down)


def blocks_of(block: int) -> Column:
    """How many blocks some rows with ``n_shingles`` are."""
    return F.greatest(F.count("*") / block, F.sum("n_shingles") / BLOCK_SHINGLES)


def hot_tokens(heads: DataFrame) -> DataFrame:
    """(token, df): those of the arrays ``head`` that many rows have, and about how many, judged by a sample of rows."""
    total = heads.agg(F.coalesce(F.sum(F.size("head")), F.lit(0))).first()[0]
    part = min(1.0, max(SAMPLED_PART, SAMPLED / max(1, total)))
    some = heads.sample(fraction=part, seed=7).select(F.explode("head").alias("token"))
    return durable(some.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= HOT).select("token", F.ceil(F.col("c") / part).cast("long").alias("df")))


def with_df(tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """``tokens(token, ...)`` of two rows or more, with the number of rows that have the token: counted, or about so for hot ones.

    Any order of tokens that is the same for all rows is right, so that hot tokens need no count: their rows meet the hot
    table by broadcast and stay where they are. The others are joined by shuffle, where no token has many rows.
    """
    cold = tokens if hot.isEmpty() else join_small(tokens, hot, "token", "left_anti")
    counted = cold.join(cold.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    return counted if hot.isEmpty() else counted.unionByName(join_small(tokens, hot, "token"))


def with_lead(listed: DataFrame, hot: DataFrame, below: int = 1 << 61) -> DataFrame:
    """(row, lead): all rows of a list have one lead in common, its least row, or for a hot token a number below all rows (and ``-below``)."""
    cold = listed if hot.isEmpty() else join_small(listed, hot.select("token"), "token", "left_anti")
    led = cold.join(cold.groupBy("token").agg(F.min("row").alias("lead"), F.count("*").alias("c")).where("c > 1"), "token").select("row", "lead")
    hub = F.lit(-below) - F.pmod("token", F.lit(1 << 60))
    return led if hot.isEmpty() else led.unionByName(join_small(listed, hot.select("token"), "token").select("row", hub.alias("lead")))


def clusters(listed: DataFrame, hot: DataFrame, below: int = 1 << 61) -> DataFrame:
    """(row, cluster) of the rows that meet others in ``listed(row, token, ...)``; further rows are leads of hot tokens."""
    led = with_lead(listed.select("token", "row"), hot, below).where("row <> lead")
    return components(led.select(F.col("row").alias("a"), F.col("lead").alias("b"))).withColumnsRenamed({"node": "row", "component": "cluster"})


def rarest(full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(row, n_shingles, token), the short lists that ``full(row, shingles)`` are in by rarity among themselves, and the hot tokens.

    Any two that link share a list. Hot tokens come last, so tasks put them aside and no join picks out their rows.
    """
    sets = durable(full.mapInArrow(set_lists, "row long, n_shingles long, head array<long>"))
    hot = hot_tokens(sets)
    ranked = np.array([x["token"] for x in hot.orderBy("df", "token").collect()], np.int64)  # bounded by the sample
    o = np.argsort(ranked)
    parts = sets.mapInArrow(without_hot(ranked[o], o, percent), PARTS)
    cold = parts.select(F.explode("cold").alias("token"), "row")
    cold = cold.join(cold.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    t = F.coalesce(F.col("t.token"), F.array().cast("array<long>"))
    kept = parts.drop("cold").join(cold, "row", "left").withColumn("t", t)
    room = F.expr(f"n_hot + size(t) - ({percent} * n_shingles + 99) div 100 + 1")  # shingles of one class come first
    return durable(kept.where(room > 0).select("row", "n_shingles", F.explode(F.slice(F.concat("t", "hot"), 1, room.cast("int"))).alias("token"))), hot


def together(rows: int, total: int, number: int, block: int) -> Column:
    """The task of a small cluster: some clusters of ``rows`` rows and ``total`` shingles in all have one. ``number`` < 0 sets these tasks apart."""
    some = F.pmod(F.xxhash64("cluster"), F.lit(max(1, total // TASK_SHINGLES, rows // (2 * block)))).cast("int")
    return F.struct(F.lit(number).cast("long").alias("cluster"), F.lit(0).alias("b1"), some.alias("s1"), F.lit(0).alias("b2"), F.lit(0).alias("s2"))


def rows_and_shingles(sized: DataFrame) -> tuple[int, int]:
    return tuple(sized.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first())


def links(docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles, sig, rep) of every row, rep being its class's least doc_id, and (node, component, links) of the doc_ids that stand for a class with a link."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))  # a hot doc_id has many keys
    sets = durable(cols.mapInArrow(row_sets(k, percent), SET))
    reps = durable(sets.where("sig is not null").groupBy("sig").agg(F.min("row").alias("class"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    many = durable(reps.where("copies > 1").select("sig", "class", "rep"))
    of = join_small(sets, many, "sig", "left").withColumn("class", F.coalesce("class", "row")).withColumn("rep", F.coalesce("rep", "doc_id"))

    # Not settled once more: exploded rows take several times the room of the lists, and both uses below shuffle them at once.
    tokens = of.where("class = row and rep is not null").select(F.explode("head").alias("token"), "row", F.col("n_shingles").alias("n"))
    hot = hot_tokens(of.where("class = row and rep is not null"))
    kept = with_df(tokens, hot).groupBy("row").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    t, e = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"({100 - percent} * n + 99) div 100")
    head = F.least(F.col("n"), F.col("n") - t + e)
    f = F.greatest(F.lit(1), F.expr(f"({percent * (100 - percent)} * n + 9999) div 10000"))
    room = head - f + 1 - (head - F.size("t"))  # shingles of one class come first in rarity, and take room
    listed = durable(kept.where(room > 0).select("row", "n", F.explode(F.slice("t", 1, room.cast("int"))).alias("x")).select("row", F.col("n").alias("n_shingles"), "x.token"))
    sized = durable(clusters(listed, hot).join(of.select("row", "key", "doc_id", "rep", "n_shingles", "sig"), "row"))
    large = durable(sized.groupBy("cluster").agg(blocks_of(block).alias("load")).where("load > 1"))
    none = large.isEmpty()
    group = together(*rows_and_shingles(sized), -1, block)
    sized = sized.withColumn("task", group) if none else join_small(sized, large, "cluster", "left").withColumn("task", F.when(F.col("load").isNull(), group))
    wanted = durable(sized.select("row", "key", "rep", "sig", "task"))
    texts = cols.drop("doc_id")
    if not is_small(wanted):  # their keys may be: then other texts aren't moved
        texts = join_small(texts, wanted.select("key"), "key", "left_semi")
    full = durable(join_small(texts, wanted, "key").withColumnRenamed("rep", "doc_id").mapInArrow(full_sets(k), FULL))
    blocks, found = full.where("task is not null").withColumn("side", F.lit(-1)), None
    if not none:
        large, sized = full.where("task is null").drop("task"), sized.where("task is null").select("row", "cluster", "n_shingles", "load")
        coarse = durable(sized.where(F.col("load") > FINE).select("row", "n_shingles"))
        sized = sized.where(F.col("load") <= FINE).drop("load")
        if not coarse.isEmpty():
            again, hot = rarest(join_small(large.select("row", "shingles"), coarse.select("row"), "row"), percent)
            dealt = durable(clusters(again, hot, 1 << 62).join(coarse, "row").select("row", "cluster", "n_shingles"))
            still = durable(dealt.groupBy("cluster").agg(blocks_of(block).alias("load")).where("load > 1").select("cluster"))
            small = durable(join_small(dealt, still, "cluster", "left_anti"))
            small = durable(small.select("row", together(*rows_and_shingles(small), -2, block).alias("task"), F.lit(-1).alias("side")))
            blocks = blocks.unionByName(join_small(large, small, "row").select(*blocks.columns))
            sized = sized.unionByName(join_small(dealt, still, "cluster").select("row", "cluster", "n_shingles"))
            listed = join_small(listed, coarse.select("row"), "row", "left_anti").unionByName(again)
        sized = durable(size_bands(sized, percent))
        mine = durable(join_small(listed, sized.select("row", "cluster"), "row").select("row", "n_shingles", "cluster", "token"))
        lists = durable(mine.groupBy("cluster", "token").agg(F.count("*").alias("m"), blocks_of(block).alias("load")).where("m > 1"))
        mine = mine.drop("n_shingles")
        bands = durable(sized.groupBy("cluster", "band").agg(F.count("*").alias("c"), blocks_of(block).alias("load")))
        near = bands.alias("x").join(bands.alias("y"), F.expr("x.cluster = y.cluster and y.band between x.band - 1 and x.band + 1")).groupBy(F.col("x.cluster").alias("cluster")).agg(F.sum(F.expr("x.c * y.c")).alias("all"))
        way = lists.groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("met"), F.sum("m").alias("entries")).join(near, "cluster")
        way = durable(way.select("cluster", "entries", (SPARSE * F.col("met") < F.col("all")).alias("sparse")))
        dense, sparse = way.where("not sparse").select("cluster"), way.where("sparse").select("cluster", "entries")
        tasks = dense_tasks(join_small(sized, dense, "cluster"), join_small(bands, dense, "cluster"), block)
        blocks = blocks.unionByName(tasks.join(large, "row").select(*blocks.columns))
        if not sparse.isEmpty():
            own = join_small(sized, sparse.select("cluster"), "cluster").select("row")
            heads = of.select("row", "n_shingles", "head").join(own, "row", "left_semi")
            found = sparse_links(join_small(mine, sparse.select("cluster"), "cluster"), join_small(lists, sparse, "cluster"), heads, large, percent, block)
    blocks = blocks.groupBy("task").applyInArrow(search_blocks(percent), "a long, b long, links long")
    found = durable(blocks if found is None else blocks.unionByName(found))
    degree = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b")).join(degree, "node")
    return of.select("row", "doc_id", "n_shingles", "sig", "rep"), durable(comp)


def joined(docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Every row's row, sig, doc_id, n_shingles, component_id, links (of its class to other classes) and class_id."""
    of, comp = links(docs, k, percent, block)
    return join_small(of, comp.withColumnRenamed("node", "rep"), "rep", "left").select("row", "sig", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("rep").alias("class_id"))


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, links and class_id of every document."""
    return joined(docs, k, percent).drop("row", "sig")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id.

    Of repeated rows one stays, of texts that only rows without a doc_id have too; texts without words all stay.
    """
    rows = durable(joined(docs, k, percent).where("sig is not null").select("doc_id", "sig", "component_id"))
    again = durable(rows.groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1 or doc_id is null").select("doc_id"))
    gone = durable(rows.where("component_id <> doc_id").select("doc_id").distinct())
    own = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"))
    if again.isEmpty():
        return join_small(own, gone, "doc_id", "left_anti").select("row.*")
    # Rows that doc_id alone doesn't tell apart: by their set too.
    odd = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("id", F.coalesce("doc_id", F.lit(0))).join(again.withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id"), "id")
    stay = odd.where("doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("sig")).unionByName(odd.where("doc_id is null").select("doc_id", "sig").distinct())
    flag = again.select(F.col("doc_id").alias("id"), F.lit(True).alias("again"))
    flagged = own.join(F.broadcast(flag) if is_small(again) else flag, own["doc_id"].eqNullSafe(flag["id"]), "left").drop("id")
    single = join_small(flagged.where("again is null").select("row", "doc_id"), gone, "doc_id", "left_anti")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs: list = [None] * b.num_rows
            for part, s, cut in text_sets(pa.compute.struct_field(b.column("row"), "text"), k):
                for i, x in zip(part.tolist(), signatures(s, cut)):
                    sigs[i] = x
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sigs, pa.binary())], names=["row", "doc_id", "sig"])

    schema = T.StructType().add("row", docs.schema).add("doc_id", T.LongType()).add("sig", T.BinaryType())
    marked = flagged.where("again").select("row", "doc_id").mapInArrow(mark, schema)
    stay = durable(stay.select(F.col("doc_id").alias("id"), F.col("sig").alias("s")))
    left = marked.where("sig is not null").join(stay, marked["doc_id"].eqNullSafe(stay["id"]) & (marked["sig"] == stay["s"]), "left_semi").dropDuplicates(["doc_id", "sig"])
    return single.select("row.*").unionByName(left.select("row.*")).unionByName(marked.where("sig is null").select("row.*"))


def query(docs: DataFrame) -> DataFrame:
    return join(docs, 3, 90)
