import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import quality_classifier as qc
from gristmill.llm import toxicity as tox


def auc(p, y):
    pos, neg = p[y == 1], np.sort(p[y == 0])
    return np.mean((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")) / 2 / len(neg))


@pytest.mark.parametrize("module, label, least", [(qc, "quality", 0.97), (tox, "toxic", 0.9)])
def test_held_out(spark, module, label, least):
    d = "/root/testdata/sf0.1"  # sf0.01 has too few labelled rows for words of four languages
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = module.query(spark.read.parquet(f"{d}/documents.parquet"), labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    r = got.join(labels, "doc_id", "left").toPandas()
    assert len(r) == 10_000 and r["score"].between(0, 1).all()
    assert (r["held_out"] == r["doc_id"].map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    test = r[r["held_out"] & r[label].notna()]
    assert auc(test["score"].to_numpy(), test[label].to_numpy()) >= least


@pytest.mark.parametrize("module, label", [(qc, "quality"), (tox, "toxic")])
def test_odd_rows(spark, odd, module, label):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (5, 1), (7, 0), (None, 1), (6, 5), (99, 0)], f"doc_id long, {label} int")
    r = module.query(odd, labels).collect()
    assert len(r) == odd.count() and all(0 <= x.score <= 1 for x in r)
    none = labels.where("false")
    assert {x.score for x in module.query(odd, none).collect()} == {0.5}
    assert module.query(odd.where("false"), none).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, docs, labels):
    from gristmill.llm.common import held_out

    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (qc.query(docs, x).orderBy("doc_id").toPandas()["score"].to_numpy() for x in (labels, other))
    assert np.array_equal(a, b)


def test_subsequence_kernel_is_the_sum_over_common_subsequences():
    def brute(s, t):
        out = 0.0
        sub = lambda w: [(w[i] + w[j] + w[k], k - i + 1) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, len(w)) if k - i < tox.SPAN]
        for a, x in sub(s):
            out += sum(tox.DECAY ** (x + y) for b, y in sub(t) if a == b)
        return out

    marks = tox.Landmarks([b"idiot", b"clown"])
    words = [b"idiot", b"idxiot", b"i-d-i-o-t", b"cloown", b"harmless"]
    ids, k = tox.kernels_of(words, marks)
    for i, row in zip(ids, k):
        w = words[i].decode().replace("-", "")
        for j, m in enumerate(("idiot", "clown")):
            v = brute(w, m) / np.sqrt(brute(w, w) * brute(m, m))
            assert abs(row[j] - (v**tox.POWER if v >= tox.CUT else 0)) < 1e-5
    assert set(ids) == {0, 1, 2, 3}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1, -1)
    w = qc.dual_coordinate_descent([np.arange(5)] * 200, list(x), y, 5, cost=10, epochs=200)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def hinge(w, x, y, c):
    return w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w))).sum()


@pytest.mark.parametrize("seed", range(3))
def test_dual_descent_against_a_dense_solver(seed):
    """The dual by projected gradient steps on the whole matrix."""
    rng = np.random.default_rng(seed)
    n, size = 60, 25
    rows = [np.sort(rng.choice(size, rng.integers(1, 9), replace=False)) for _ in range(n)]
    values, y = [rng.normal(size=len(r)) for r in rows], np.where(rng.random(n) < 0.3, 1, -1)
    x = np.zeros((n, size + 1))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v
    x[:, -1] = 1
    upper = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a, step = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        a = np.clip(a + step * (1 - q @ a), 0, upper)
    best = hinge((a * y) @ x, x, y, upper)
    w = qc.dual_coordinate_descent(rows, values, y, size, epochs=3000)
    assert best - 1e-6 <= hinge(w, x, y, upper) <= best * 1.01 + 1e-3


def test_features_ratios_and_scores_against_plain_ones(make):
    import pyarrow as pa

    texts = ["abc abc abc", "", "zé zé q", "one two one two three", "x", None, "aa bb cc"]
    [(rows, doc, f)] = list(qc.features(pa.array(texts)))
    lists = [f[doc == i] for i in range(len(texts))]
    for t, got in zip(texts, lists):
        b = (t or "").encode() + b" "  # a text ends in a space
        two = {b[i] << 8 | b[i + 1] for i in range(len(b) - 1)}
        three = {(((b[i] << 8 | b[i + 1]) * 0x9E3779B1 + b[i + 2] * 0x85EBCA77) % 2**32 >> 16) % (2**16 - qc.SHAPES) + 2**16 for i in range(len(b) - 2)}
        assert {x for x in got.tolist() if x < qc.SIZE - qc.SHAPES} == two | three and len(set(got.tolist())) == len(got)
    y = np.array([1, 1, -1, 1, -1, -1, -1])
    ratio = qc.log_count_ratios(lists, y, qc.SIZE)
    count = {s: [1 + sum(k in set(x.tolist()) for x, z in zip(lists, y) if z == s) for k in (97 << 8 | 98, 98 << 8 | 99, 5)] for s in (1, -1)}
    total = {s: qc.SIZE + sum(len(x) for x, z in zip(lists, y) if z == s) for s in (1, -1)}
    assert np.allclose(ratio[[97 << 8 | 98, 98 << 8 | 99, 5]], [np.log(p / total[1] / (m / total[-1])) for p, m in zip(count[1], count[-1])])
    w = np.random.default_rng(0).normal(size=qc.SIZE).astype(np.float32)
    got = {r.doc_id: r.score for r in qc.score(make(list(enumerate(texts))), (w, 0.25)).collect()}
    for i, x in enumerate(lists):
        assert abs(got[i] - 1 / (1 + np.exp(-(0.25 + sum(float(w[k]) for k in x) / np.sqrt(len(x) + 1.0))))) < 1e-5


def test_a_document_scores_by_its_worst_sentence(make):
    """Every word's kernel with every landmark by itself, summed by sentence."""
    words = [b"idiot", b"clown", b"water"]
    marks, weight = tox.Landmarks(words), np.array([2.0, 1.0, -0.5])
    texts = ["You idiot. What a clown, you id1ot!\nWater is fine", "cloown idiot water. i d i o t", "nothing here", "", None, "water water water"]

    def value(word):
        ids, k = tox.kernels_of([word], marks)
        return float(k[0] @ weight) if len(ids) else 0.0

    def margin(sentences):
        each = [sum(value(w) for w in s) for s in sentences]
        return max(each) if each else 0.0

    split = [[[b"you", b"idiot."], [b"what", b"a", b"clown,", b"you", b"id1ot!"], [b"water", b"is", b"fine"]], [[b"cloown", b"idiot", b"water."], [b"idiot"]], [[b"nothing", b"here"]], [], [], [[b"water"] * 3]]
    got = {r.doc_id: r.score for r in tox.score(make(list(enumerate(texts))), (words, weight, 1.5, -1.0)).collect()}
    for i, s in enumerate(split):
        assert abs(got[i] - 1 / (1 + np.exp(-(1.5 * margin(s) - 1.0)))) < 1e-5, texts[i]


def test_labelled_sample_is_bounded_and_distinct(spark, make):
    from gristmill.llm.common import held_out, labelled_sample

    d = make([(i % 500, f"text {i}" * (1 + i % 3)) for i in range(1000)] + [(600, "x" * 1000), (None, "y")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(700)] * 2 + [(None, 1), (1, None)], "doc_id long, y int")
    got = labelled_sample(d, labels, "y", 300, 500, 2000).toPandas()
    assert got["doc_id"].is_unique and len(got) <= 300 and got["text"].str.len().sum() <= 2000 and 600 not in set(got["doc_id"])
    assert not d.where(held_out(F.col("doc_id")) & F.col("doc_id").isin(got["doc_id"].tolist())).count()
    again = labelled_sample(d.repartition(7), labels.repartition(3), "y", 300, 500, 2000).toPandas()
    assert sorted(map(tuple, again.itertuples(index=False))) == sorted(map(tuple, got.itertuples(index=False)))


def plain_kernel(s, t):
    """Sharpened cosine of the words' weighted triples of letters, by going over all of them."""

    def triples(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + tox.SPAN)):
                    out[w[i] + w[j] + w[k]] += tox.DECAY ** (k - i + 1)
        return out

    a, b = triples(s), triples(t)
    norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b.get(c, 0.0) for c, x in a.items()) / norm if norm else 0.0


def test_landmarks_are_those_of_a_plain_choice():
    """Words by how much they tell of toxic documents, each next one discounted by its likeness to those chosen."""
    rng = np.random.default_rng(8)
    bad, plain = ["idiot", "moron", "clown", "scum", "idiots", "trash"], [f"{a}{b}{c}" for a in ("bal", "tor", "min") for b in ("ev", "ul", "ar") for c in ("ne", "sto", "rix")]
    docs, y = [], []
    for i in range(160):
        words = [plain[j] for j in rng.integers(0, len(plain), 12)]
        if i % 4 == 0:
            words[int(rng.integers(12))] = bad[int(rng.integers(len(bad)))]
        docs.append(words)
        y.append(1 if i % 4 == 0 else -1)
    model = tox.fit([" ".join(w) + "." for w in docs], np.array(y))
    n1, n0 = y.count(1), y.count(-1)
    tells = {}
    for w in sorted({x for d in docs for x in d}):
        df1, df0 = (sum(w in d for d, z in zip(docs, y) if z == k) for k in (1, -1))
        tells[w] = (np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))) * np.sqrt(df1) if df1 >= 3 else 0.0
    left, want = {w: x for w, x in tells.items() if x > 0}, []
    while left and max(left.values()) > 0 and len(want) < tox.LANDMARKS:
        best = max(sorted(left), key=left.get)
        want.append(best)
        left = {w: x * (1 - 0.9 * min(1.0, plain_kernel(w, best)) ** 2) for w, x in left.items() if w != best}
    got = [w.decode() for w in model[0]]
    assert got[: len(want)] == want and set(bad) <= set(want) and len(got) <= len(want) + tox.ORDINARY
    # the Nystroem map of landmarks gives their kernel back, so that a weight for each landmark says the same
    k = np.array([[plain_kernel(a, b) for b in got] for a in got])
    k = np.where(k >= tox.CUT, k, 0) ** tox.POWER
    value, vector = np.linalg.eigh(k)
    feature = k @ (vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6]))
    assert np.abs(feature @ feature.T - k).max() < 1e-6 + np.abs(value[value <= 1e-6]).sum()
    margin = {w: float(k[i] @ model[1]) for i, w in enumerate(got)}
    assert min(margin[w] for w in bad) > max(margin[w] for w in got if w not in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_support_vectors_against_plain_descent(seed):
    rng = np.random.default_rng(seed)
    x, times = rng.normal(size=(60, 4)), rng.integers(1, 5, 60).astype(float)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0.4, 1.0, -1.0)
    share = {k: times.sum() / (2 * times[y == k].sum()) for k in (1.0, -1.0)}

    def slope(w):
        out = np.append(w[:-1], 1e-6 * w[-1])
        for r, k, t in zip(x, y, times):
            a = np.append(r, 1.0)
            out -= 2 * tox.COST * t * share[k] * max(0.0, 1 - k * float(a @ w)) * k * a
        return out

    w = np.zeros(5)
    for _ in range(6000):
        w = w - 4e-4 * slope(w)
    assert np.abs(tox.support_vectors(x, y, times) - w).max() < 1e-3
