import re
import zlib
from collections import Counter

import pytest

from gristmill.llm import spelling


def plain_words(rows, drop_every=97, min_chars=5, min_count=3):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, pairs=None):
    """By comparing all words with each other."""
    at = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, xs in at.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(at[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_words_and_groups_of_documents(spark, docs):
    some = docs.where("doc_id < 60")  # the fixture: all words of 60 texts against all
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    n = plain_words(rows)
    assert {tuple(r) for r in spelling.count_words(some).collect()} == set(n.items())
    assert rows_of(spelling.query(some)) == plain_groups(n)


@pytest.mark.parametrize("most", [2, 3, 7, 1000])
def test_subdivided_blocks_lose_and_repeat_no_pair(spark, most):
    """Dense words over two letters of 4 to 9 code points: blocks are halved down to one place."""
    words = {f"{i:0{k}b}".replace("0", "a").replace("1", "é"): 1 + (i * 7919 + k) % 50 for k in range(4, 9) for i in range(0, 1 << k, 3 if k > 6 else 1)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group(df, min_chars=4, most=most)) == plain_groups(words)
    assert spelling.blocks(df, 4, most).groupBy("m", "lo", "hi", "key").count().where(f"count > {most} and hi - lo > 1").isEmpty()


def test_every_kind_of_edit(spark):
    words = ["hello", "jello", "helloo", "hell", "hllo", "ello", "hellos", "ahello", "heello", "help", "hellp", "hexlo", "helxo", "ñello", "aaaaa", "aaaaaa", "aaaaaaa"]
    n = {w: 10 + i for i, w in enumerate(words)} | {"hello": 500}
    assert rows_of(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long"), min_chars=4, most=2)) == plain_groups(n)


def test_roots_follow_long_chains(spark):
    chain = [("w" * 5 + "abcdefghijkl"[:i], 3 * 2**i) for i in range(13)]
    got = spelling.group(spark.createDataFrame(chain, "word string, n long"))
    assert {r.root for r in got.collect()} == {chain[-1][0]}
    forms = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(37)] + [(f"m{i}", "n30") for i in range(50)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"n{i}", "n37") for i in range(37)} | {(f"m{i}", "n37") for i in range(50)}


def test_ties_go_to_the_smallest(spark):
    got = rows_of(spelling.group(spark.createDataFrame([("hellx", 1), ("hella", 9), ("hellb", 9), ("hellé", 9)], "word string, n long")))
    assert ("hellx", "hella", "hella", 1, 3, 9) in got


def test_odd_rows(spark, odd, make):
    long = "a" * 30_000
    rows = odd.select("doc_id", "text").unionByName(make([(None, "Straße Straße straße STRAße ×÷×÷× word_word"), (30, f"{long} {long}b {long} {long}b {long}\n{long}b"), (31, None)]).select("doc_id", "text"))
    n = plain_words([tuple(r) for r in rows.collect()])
    assert {tuple(r) for r in spelling.count_words(rows).collect()} == set(n.items())
    assert rows_of(spelling.query(rows)) == plain_groups(n)
    assert long in n


def test_counts_do_not_hang_on_partitions_or_gathering(spark, docs, monkeypatch):
    want = {tuple(r) for r in spelling.count_words(docs).collect()}
    assert {tuple(r) for r in spelling.count_words(docs.repartition(7)).collect()} == want
    assert {tuple(r) for r in spelling.count_words(docs, drop_every=0).collect()} != want


def test_empty(spark, make):
    assert spelling.query(make([])).count() == 0 and spelling.query(make([(1, "a b c")])).count() == 0
