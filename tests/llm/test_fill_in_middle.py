import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import fill_in_middle as fim


def plain(doc_id, text, rate=100, spm=50):
    """(doc_id, n, form, prefix_chars, middle_chars, output) by the rule."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("values", [[1], [3, 4, 5], [0, 0, 7, 1000, 10**9], list(range(1, 400, 3)), [10**6] * 9])
def test_lists_give_their_values_back(values):
    n, *parts = fim.elias_fano(np.array(values))
    assert n == len(values) and [fim.select(*parts, i) for i in range(n)] == values


def test_lists_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 160, 100_000))
    _, _, low, high = fim.elias_fano(ends)
    assert 8 * (len(low) + len(high)) / len(ends) < 2 + np.log2(80) + 0.5
    assert fim.select(*fim.elias_fano(ends)[1:], 77_777) == ends[77_777]


def test_line_ends():
    assert fim.line_ends("é\n\n日本".encode()).tolist() == [2, 3, 5] and not len(fim.line_ends(b"")) and fim.line_ends(b"a\n").tolist() == [2]


def test_every_document_against_the_rule(spark, docs):
    got = [tuple(r)[:6] for r in fim.transform(docs).collect()]
    assert key(got) == key(plain(r.doc_id, r.text) for r in docs.collect())


def test_rates(spark, docs):
    got = [tuple(r)[:6] for r in fim.transform(docs, rate=40, spm=0).collect()]
    assert key(got) == key(plain(r.doc_id, r.text, 40, 0) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "psm"}


def test_odd_rows(spark, odd, make):
    marked = make([(20, "a <P> b\nc"), (21, "<<S\n<M\n>\nx<"), (22, "no end\n\n\n"), (None, None), (23, "\n"), (24, "x\r\ny z\n" * 3)])
    rows = odd.select("doc_id", "text").unionByName(marked.select("doc_id", "text"))
    out = fim.transform(rows).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert key(tuple(r)[:6] for r in out) == key(plain(r.doc_id, r.text) for r in rows.collect())
    assert all(r.back == r.text for r in out)


def test_hot_texts_are_split_and_stay_whole(spark, make):
    rows = [(i, "one\ntwo\nthree\n") for i in range(3000)] + [(7, "one\ntwo\nthree\n")] * 5 + [(None, "one\ntwo\nthree\n")] * 3 + [(9000, "other")]
    got = fim.transform(make(rows), group=100)
    assert key(tuple(r)[:6] for r in got.collect()) == key(plain(*r) for r in rows)
    heavy = spark.createDataFrame([], "key binary, parts long")
    assert fim.text_index(make(rows), heavy).count() == 2  # each text once


def test_a_digest_never_stands_for_two_texts(spark, make):
    rows = make([(1, "some text"), (2, "other text"), (3, "some text")])
    same = lambda text: F.unhex(F.lit("00"))
    with pytest.raises(Exception, match="same digest"):
        fim.transform(rows, key=same).collect()


def test_empty_table(spark, make):
    assert fim.query(make([])).count() == 0
