"""Near duplicates, leaks, repeats: against brute force."""

import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import decontaminate as dc
from gristmill.llm import ngram_join as nj
from gristmill.llm import suffix_dedup as sd
from gristmill.llm.components import components, forest


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_sets(rows, k):
    out = {}
    for d, t in rows:
        w = words(t)
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_components(rows, k, percent):
    sets = shingle_sets(rows, k)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(seed, n=60):
    """Families around the threshold, nested ones, chains, and texts of common words only."""
    rng = np.random.default_rng(seed)
    rows, d = [], 0
    for _ in range(n // 6):
        base = [f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 90))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = f"v{rng.integers(1000)}"
            rows.append((d, " ".join(t[: len(t) - rng.integers(0, 3)] or t)))
            base = t if rng.random() < 0.3 else base
            d += 1
    return rows


@pytest.mark.parametrize("k, percent, block", [(3, 90, 512), (5, 80, 512), (3, 90, 4), (2, 80, 3)])
def test_components_match_brute_force(spark, make, k, percent, block):
    rows = near_copies(k * percent + block)
    of, comp = nj.links(make(rows), k, percent, block)
    got = of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows, k, percent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12), st.sets(st.integers(0, 30), min_size=1, max_size=25), st.sampled_from([60, 80, 90]))
def test_divide_skip(sets, query, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    found, shared = nj.Lists(arrays).search(np.array(sorted(query), np.uint64), percent)
    want = {i: len(s & query) for i, s in enumerate(sets) if 100 * len(s & query) >= percent * len(s | query)}
    assert dict(zip(found.tolist(), shared.tolist())) == want


def test_join_on_odd_rows(odd, make):
    r = nj.query(odd).collect()
    assert len(r) == odd.count()
    by = defaultdict(set)
    for x in r:
        by[x.doc_id].add((x.n_shingles, x.component_id))
    assert by[1] == {(0, 1)} and by[3] == {(0, 3)} and by[7] == {(1, 7)} and by[8] == {(1, 7)} and by[6] == {(1, 6)}
    assert nj.query(odd.where("false")).count() == 0
    kept = nj.keep_one(odd)
    assert kept.columns == odd.columns and {x.doc_id for x in kept.collect()} == {1, 2, 3, None, 5, 6, 7, 9}
    # links of a class are counted without its copies
    d = make([(0, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k m")])
    assert {x.doc_id: (x.component_id, x.links) for x in nj.join(d, 1, 80).collect()} == {0: (0, 1), 1: (0, 1), 2: (0, 1)}


def quotes(n, pool, seed=5):
    """Texts of three passages each, from a shared pool, so that nearly all meet in some list; a few near copies among them."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{i}x{x}" for x in range(32)] for i in range(pool)]
    rows = []
    for d in range(n):
        t = [x for i in rng.permutation(pool)[:3] for x in passages[i]]
        if d % 10 == 9:  # one word of an earlier text changed
            t = rows[-3][1].split()
            t[rng.integers(len(t))] = f"v{d}"
        rows.append((d, " ".join(t)))
    return rows


@pytest.mark.parametrize("k, percent, pool, block", [(3, 90, 60, 40), (5, 80, 60, 40), (3, 90, 3, 16)])
def test_texts_that_quote_each_other(make, k, percent, pool, block):
    rows = quotes(600, pool)
    got = nj.joined(make(rows), k, percent, block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, k, percent)
    sets = shingle_sets(rows, k)
    reps = {frozenset(s): d for d, s in reversed(list(sets.items()))}
    linked = {d: sum(100 * len(s & o) >= percent * len(s | o) for o in reps) - 1 for s, d in reps.items()}
    assert {r.doc_id: r.links for r in got.collect()} == {d: linked[reps[frozenset(s)]] for d, s in sets.items()}


@pytest.mark.parametrize("hot, shingles", [(2, 10**9), (12, 300), (10**9, 40)])
def test_hot_tokens_and_long_texts_change_no_result(make, monkeypatch, hot, shingles):
    monkeypatch.setattr(nj, "HOT", hot)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", shingles)
    rows = near_copies(hot % 1000 + shingles % 1000, 48) + [(1000 + d, t) for d, t in quotes(90, 30)]
    got = nj.joined(make(rows), 3, 90, 30)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 90)


def phrases(n, seed=11):
    """Texts of two common lines of ten and twelve words of their own; a few near copies among them."""
    rng = np.random.default_rng(seed)
    common = [[f"c{i}x{x}" for x in range(12)] for i in range(10)]
    rows = []
    for d in range(n):
        t = [x for i in rng.permutation(10)[:2] for x in common[i]] + [f"o{d}x{x}" for x in range(12)]
        if d % 20 == 19:  # its last word changed
            t = [*rows[-3][1].split()[:-1], f"v{d}"]
        rows.append((d, " ".join(t)))
    return rows


def test_common_phrases_keep_no_texts_together(make, monkeypatch):
    """Nearly all texts are one cluster by their heads; by the rarest shingles of their full sets only near copies are."""
    met, bands = [], nj.size_bands
    monkeypatch.setattr(nj, "size_bands", lambda sized, percent: met.append(sized.count()) or bands(sized, percent))
    rows = phrases(500)
    got = nj.joined(make(rows), 3, 90, 8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 90)
    assert len({r.component_id for r in got.collect()}) == 475 and met == [0]


@pytest.mark.parametrize("hot, k, percent, block", [(3, 3, 90, 4), (10**9, 3, 90, 4), (12, 2, 80, 3)])
def test_clusters_dealt_anew_change_no_result(make, monkeypatch, hot, k, percent, block):
    monkeypatch.setattr(nj, "FINE", 1)
    monkeypatch.setattr(nj, "HOT", hot)
    rows = near_copies(hot % 1000 + block, 48) + [(1000 + d, t) for d, t in quotes(120, 12)] + [(2000 + d, t) for d, t in phrases(60)]
    got = nj.joined(make(rows), k, percent, block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, k, percent)


def test_a_large_wanted_side_changes_no_result(make, monkeypatch):
    monkeypatch.setattr(nj, "is_small", lambda *a: False)
    rows = near_copies(7, 48) + [(1000 + d, t) for d, t in phrases(60)]
    got = nj.joined(make(rows), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 90)


def test_a_hot_doc_id_costs_no_more(make):
    """Near copies, all different, under one doc_id and under one each."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[: 7 * i % 120], f"v{i}", *base[7 * i % 120 + 1 :]]) for i in range(800)]
    times, links = [], []
    for ids in (range(800), [5] * 800):
        began = time.monotonic()
        rows = nj.join(make(list(zip(ids, texts))), 3, 90).collect()
        times.append(time.monotonic() - began)
        links.append(sorted((r.n_shingles, r.component_id > 5) for r in rows))
        assert len(rows) == 800
    assert links[0] == links[1] and times[1] < 1.7 * times[0] + 3


def test_quotes_are_searched_by_list(make, monkeypatch):
    """16,000 texts in one cluster: no block is compared with another."""
    met = []
    monkeypatch.setattr(nj, "dense_tasks", lambda sized, *a: met.append(sized.count()) or sized.select("row", nj.F.lit(None).cast(nj.TASK).alias("task"), nj.F.lit(0).alias("side")).limit(0))
    rows = quotes(16_000, 1000)
    comp = {r.doc_id: r.component_id for r in nj.query(make(rows)).collect()}
    assert met == [0] and comp[9] == comp[6] and sum(d == c for d, c in comp.items()) >= 14_000


def test_keep_one_on_repeated_rows_and_missing_ids(make):
    t, u = "some words of a text that is here more than once in all", "other words that only rows without an id have"
    rows = [(7, t), (7, t), (None, t), (None, u), (None, u), (9, "a text of its own"), (9, "another text of the same id"), (5, ""), (5, None), (None, "")]
    d = make(rows, extra=True)
    kept = sorted(((r.doc_id, r.text) for r in nj.keep_one(d).collect()), key=str)
    assert [x for x in kept if x[0] != 9] == sorted([(7, t), (None, u), (5, ""), (5, None), (None, "")], key=str)
    assert len([x for x in kept if x[0] == 9]) == 1 and nj.keep_one(d).columns == d.columns
    by = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.query(d).collect()), key=str)
    assert by.count((7, 11, 7)) == 2 and (None, 11, 7) in by and by.count((None, 7, None)) == 2


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert {r.node: r.component for r in components(e.repartition(7), one_task=0).collect()} == got
    assert components(e.where("false")).count() == 0 and components(e.where("false"), one_task=-1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 30), st.integers(-9, 30)), max_size=60))
def test_forest(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    node, least = forest(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    assert dict(zip(node.tolist(), least.tolist())) == {x: root(x) for x in parent}

def brute_tiles(test, text, least):
    """Greedy string tiling as first stated: mark the longest match of unmarked words, again and again."""
    pm, tm, lengths = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(test)):
            for t in range(len(text)):
                k = 0
                while p + k < len(test) and t + k < len(text) and test[p + k] == text[t + k] and p + k not in pm and t + k not in tm:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return lengths
        pm |= set(range(p, p + k))
        tm |= set(range(t, t + k))
        lengths.append(k)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.lists(st.integers(0, 4), min_size=1, max_size=45))
def test_tiles_are_valid_and_begin_with_the_longest(test, text):
    a, b = np.array(test, np.uint64), np.array(text, np.uint64)
    tiles = dc.tile(a, b, 3)
    assert all(test[p : p + k] == text[t : t + k] and k >= min(3, len(test)) for p, t, k in tiles)
    for i in (0, 1):
        used = [x for s in tiles for x in range(s[i], s[i] + s[2])]
        assert len(used) == len(set(used))
    want = brute_tiles(test, text, min(3, len(test)))
    assert max((k for *_, k in tiles), default=0) == max(want, default=0)


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(5)), st.integers(3, 12))
def test_reordered_passages_are_covered(order, n):
    parts = [list(range(100 * i, 100 * i + n)) for i in range(5)]
    test = [x for p in parts for x in p]
    text = [x for i in order for x in [*parts[i], 10_000 + i]]
    assert sum(k for *_, k in dc.tile(np.array(test, np.uint64), np.array(text, np.uint64), 3)) == len(test)


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(24)), st.lists(st.integers(1, 7), min_size=1, max_size=8))
def test_tiles_of_texts_without_repeats(order, cuts):
    """Each word once: the tiles are the common runs, whichever way they are found."""
    test, text, at = list(range(24)), [], 0
    for n, c in zip(cuts, order):
        text += [*range(c, min(24, c + n)), 100 + c]
    text = list(dict.fromkeys(text))
    assert sorted(k for *_, k in dc.tile(np.array(test, np.uint64), np.array(text, np.uint64), 3)) == sorted(brute_tiles(test, text, 3))


def test_repeated_words_are_stepped_over():
    one = np.zeros(200, np.uint64)
    began = time.process_time()
    assert dc.tile(one, np.zeros(1_000_000, np.uint64)) == [(0, 0, 200)]
    mixed = np.where(np.arange(200) % 50 < 49, 0, np.arange(200)).astype(np.uint64)
    assert sum(k for *_, k in dc.tile(mixed, np.concatenate([np.zeros(300_000, np.uint64), mixed[100:], mixed[:100]]))) == 200
    assert time.process_time() - began < 15


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9)), min_size=1, max_size=12), st.data())
def test_enough_seeds_meet_one_of_the_rarest(seeds, data):
    times, df = (np.array(x) for x in zip(*seeds))
    needed = data.draw(st.integers(1, int(times.sum())))
    kept = dc.rarest(times, df, needed)
    assert int(times[~kept].sum()) < needed  # who has ``needed`` has one that is kept
    if kept.sum() > 1:
        o = np.argsort(df, kind="stable")
        last = o[kept[o].nonzero()[0][-1]]
        assert int(times[~kept].sum() + times[last]) >= needed  # and no fewer would do
        assert df[kept].max() <= df[~kept].min(initial=99)


def test_leaks_are_those_of_all_pairs(spark, docs, sf_dir):
    """Every document tiled with every test, without seeds."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.uint64)
    tests = [(r.item_id, code(r.text)) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        w = code(r.text)
        for item, x in tests:
            if len(x) and (share := sum(k for *_, k in dc.tile(x, w, 3)) / len(x)) >= 0.3:
                want[r.doc_id, item] = round(share, 6)
    got = {(r.doc_id, r.item_id): round(r.coverage, 6) for r in dc.leaks(docs, bench, 0.3).collect()}
    assert got == want and want


def test_leaks(spark, make):
    test = "alpha beta gamma delta epsilon. zeta eta theta iota kappa lambda. mu nu xi omikron pi rho"
    moved = "mu nu xi omikron pi rho filler words here zeta eta theta iota kappa lambda. and alpha beta gamma delta epsilon."
    bench = spark.createDataFrame([(1, test), (2, "two words"), (3, None), (None, "x y z"), (4, "")], "item_id long, text string")
    d = make([(1, "before " + test + " after"), (2, moved), (3, "alpha beta gamma delta epsilon. only"), (4, None), (5, ""), (6, "here TWO words end"), (7, "two, words")], extra=True)
    for limit in (dc.BROADCAST_WORDS, 0):
        got = {(r.doc_id, r.item_id): round(r.coverage, 3) for r in dc.leaks(d, bench, broadcast_words=limit).collect()}
        assert got == {(1, 1): 1.0, (2, 1): 1.0, (6, 2): 1.0}
    odd = make([(1, test), (1, test), (1, "clean"), (None, moved), (None, "clean"), (2, "two words")], extra=True)
    twice = bench.unionByName(spark.createDataFrame([(1, "alpha beta gamma unlike the rest of it all here"), (9, test)], "item_id long, text string"))
    for limit in (dc.BROADCAST_WORDS, 0):
        got = sorted(((r.doc_id, r.item_id, r.coverage) for r in dc.leaks(odd, twice, broadcast_words=limit).collect()), key=str)
        assert got == sorted([(1, 1, 1.0), (1, 9, 1.0), (None, 1, 1.0), (None, 9, 1.0), (2, 2, 1.0)], key=str)
        assert sorted((str(r.doc_id), r.text) for r in dc.clean(odd, twice, broadcast_words=limit).collect()) == [("1", "clean"), ("None", "clean")]
    assert {r.doc_id for r in dc.clean(d, bench).collect()} == {3, 4, 5, 7} and dc.clean(d, bench).columns == d.columns
    assert dc.leaks(d, bench.where("false")).count() == 0 and dc.leaks(d.where("false"), bench).count() == 0


def test_both_ways_agree_on_the_data(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    a, b = (sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in dc.leaks(docs, bench, 0.2, broadcast_words=x).collect()) for x in (dc.BROADCAST_WORDS, 0))
    assert a == b and a


def brute_repeats(rows):
    where = defaultdict(set)
    w = {d: words(t) for d, t in rows}
    n = sd.LEAST
    for d, x in w.items():
        for i in range(len(x) - n + 1):
            where[tuple(x[i : i + n])].add(d)
    out = {}
    for d, x in w.items():
        marked = {j for i in range(len(x) - n + 1) if len(where[tuple(x[i : i + n])]) > 1 for j in range(i, i + n)}
        if marked:
            out[d] = marked
    return out


def test_repeats_match_brute_force(spark, make):
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    shared = [fresh(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for d in range(60):
        parts = [fresh(rng.integers(0, 60))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(5)], fresh(rng.integers(1, 60))]
        rows.append((d, " ".join(x for p in parts for x in p)))
    rows += [(100 + i, rows[3][1]) for i in range(3)] + [(200, " ".join(shared[4][100:160])), (201, None), (202, "")]
    got = {r.doc_id: {j for s in r.spans for j in range(s.begin, s.end)} for r in sd.repeats(make(rows)).collect()}
    assert got == brute_repeats(rows)


def marks(df):
    return {r.doc_id: {j for s in r.spans for j in range(s.begin, s.end)} for r in df.collect()}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repeats_among_near_copies(spark, make, partitions):
    """Windows of a passage in pieces, so that a pair's match stands far from it in every order of its suffixes."""
    rng = np.random.default_rng(2)
    passage = [f"p{x}" for x in range(70)]
    rows = []
    for d in range(60):
        a, b = rng.integers(0, 30), rng.integers(40, 71)
        rows.append((d, " ".join([*(f"a{d}x{i}" for i in range(20)), *passage[a:b], *(f"z{d}x{i}" for i in range(20))])))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert marks(sd.repeats(make(rows))) == brute_repeats(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repeats_pair_that_is_good_only_in_sum(make):
    """For whichever seed the passage has: a pair of 55 words, with variants of a longer right or left part but under 50 words in all."""
    p = [f"p{x}" for x in range(55)]
    fresh = lambda k, n: [f"{k}f{x}" for x in range(n)]
    rows = [(0, " ".join([*fresh("a", 60), *p, *fresh("b", 60)])), (1, " ".join([*fresh("c", 60), *p, *fresh("d", 60)]))]
    for i in range(300):  # 49 words at most in common with the two, from either end
        n = 36 + i % 14
        rows.append((10 + i, " ".join([*fresh(f"l{i}", 40), *(p[:n] if i % 2 else p[-n:]), *fresh(f"r{i}", 40)])))
    want = brute_repeats(rows)
    assert len(want[0]) == 55
    assert marks(sd.repeats(make(rows))) == want


def test_repeats_within_one_text(make):
    p = [f"p{x}" for x in range(150)]
    line = ["over", "and", "out"] * 200
    fresh = lambda k: [f"{k}{x}" for x in range(30)]
    rows = [(1, " ".join([*p, *fresh("a"), *p, *fresh("b"), *p, *fresh("c"), *p, *fresh("d")])), (2, " ".join([*fresh("e"), *p])), (3, " ".join([*fresh("g"), *line])), (4, " ".join([*line, *fresh("h")]))]
    assert marks(sd.repeats(make(rows))) == brute_repeats(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"b", b"a b", b"\x01"]), max_size=6), st.lists(st.sampled_from([b"a", b"ab", b"b", b"a b", b"\x01"]), max_size=6))
def test_common_words(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert sd.common_words(sd.SEPARATOR.join(a), sd.SEPARATOR.join(b)) == want


def test_words_decide_where_hashes_collide():
    """All suffixes under one seed: only those with equal words are repeats."""
    rng = np.random.default_rng(4)
    passage = [f"p{x}" for x in range(120)]
    rows = []
    for d in range(40):
        cut, word = rng.integers(0, 60), rng.integers(0, 120)
        body = [*passage[cut:word], *([f"x{d % 3}"] if d % 2 else ["Two\x00", "\x01"]), *passage[word + 1 :]] if d % 4 else passage[cut : cut + 70]
        rows.append((d, "\n\t".join([*(f"a{d}y{i}" for i in range(9)), *body, *(f"z{d}y{i}" for i in range(40))])))
    every = [(d, [p for _, p, _ in zip(*sd.minimisers(*(lambda c: (c.words()[0], c.words()[3], 1))(next(iter(sd.chunks(pa.array([t])))))))]) for d, t in rows]
    docs = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array([[int(p) for p in k] for _, k in every], pa.list_(pa.int32()))], names=["doc_id", "text", "kept"])
    t = pa.Table.from_batches(sd._suffixes(iter([docs])))
    t = t.set_column(t.schema.get_field_index("seed"), "seed", pa.array([7] * t.num_rows, pa.int64())).sort_by([("seed", "ascending"), ("right", "ascending")])
    got = defaultdict(set)
    for s in sd._spans(t).to_pylist():
        got[s["doc_id"]] |= set(range(s["begin"], s["end"]))
    assert got == brute_repeats(rows) and len(got) > 20


def test_repeats_on_the_data(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: {j for s in r.spans for j in range(s.begin, s.end)} for r in sd.repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_cut_repeats(odd, make):
    p = " ".join(f"p{i}" for i in range(60))
    d = make([(1, "a " + p + " b"), (2, "c " + p + " d"), (3, "short"), (4, None)], extra=True)
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.cut_repeats(d).collect()}
    assert got == {1: ("a " + p + " b", len("a " + p + " b")), 2: ("c  d", 4), 3: ("short", 5), 4: (None, None)}
    assert sd.cut_repeats(odd).count() == odd.count() and sd.query(odd).count() == 0 and sd.query(odd.where("false")).count() == 0


def test_first_documents_are_those_of_the_passage(make):
    fresh = lambda k, n: [f"{k}{x}" for x in range(n)]
    p, q, r = fresh("p", 60), fresh("q", 60), fresh("r", 60)
    line = p[5:54]  # too short for a passage, and holds its seed
    rows = [(3, [*fresh("a", 30), *line, *fresh("b", 30)]), (5, [*fresh("c", 30), *p]), (7, [*q, *fresh("d", 9)]), (8, [*r, *q, *fresh("e", 9)]), (9, [*p, *fresh("f", 30)]), (10, [*r, *q, *fresh("e", 9)]), (11, [*fresh("g", 9), *r, *fresh("h", 9)])]
    d = make([(i, " ".join(w)) for i, w in rows])
    got = {x.doc_id: (x.repeated_words, [tuple(s) for s in x.spans]) for x in sd.repeats(d).collect()}
    assert got == {
        5: (60, [(30, 90, 5)]), 7: (60, [(0, 60, 7)]), 8: (129, [(0, 129, 8), (60, 120, 7)]), 9: (60, [(0, 60, 5)]), 10: (129, [(0, 129, 8), (60, 120, 7)]), 11: (60, [(9, 69, 8)]),
    }
    # each passage stays once, in the first document that has it
    cut = {x.doc_id: x.text.split() for x in sd.cut_repeats(d).collect()}
    assert cut == {3: rows[0][1], 5: rows[1][1], 7: rows[2][1], 8: [*r, *fresh("e", 9)], 9: fresh("f", 30), 10: [], 11: [*fresh("g", 9), *fresh("h", 9)]}


def test_touching_passages_keep_their_first_documents(make):
    fresh = lambda k, n: [f"{k}{x}" for x in range(n)]
    p, q = fresh("p", 60), fresh("q", 60)
    d = make([(1, " ".join([*fresh("a", 9), *p])), (2, " ".join([*p, *q])), (3, " ".join([*q, *fresh("b", 9)]))])
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in sd.repeats(d).collect()}
    assert got == {1: [(9, 69, 1)], 2: [(0, 60, 1), (60, 120, 2)], 3: [(0, 60, 2)]}
    assert [x.text.split() for x in sd.cut_repeats(d).orderBy("doc_id").collect()] == [[*fresh("a", 9), *p], q, fresh("b", 9)]


def test_leaks_without_five_words_in_a_row(spark, make):
    w = [f"t{i}" for i in range(40)]
    moved = [x for i in (9, 2, 7, 0, 5, 3, 8, 1, 6, 4) for x in w[4 * i : 4 * i + 4]]
    changed = [f"c{i}" if i % 5 == 4 else x for i, x in enumerate(w)]
    few = [x for i in range(6) for x in [*w[6 * i : 6 * i + 3], f"c{i}"]]  # 18 of 40 words
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    rows = [(1, moved), (2, changed), (3, few), (4, w[::-1])]
    for limit in (dc.BROADCAST_WORDS, 0):
        got = {(r.doc_id, r.coverage) for r in dc.leaks(make([(i, " ".join(x)) for i, x in rows]), bench, broadcast_words=limit).collect()}
        assert got == {(i, sum(brute_tiles(w, x, 3)) / 40) for i, x in rows if 2 * sum(brute_tiles(w, x, 3)) >= 40} == {(1, 1.0), (2, 0.8)}
