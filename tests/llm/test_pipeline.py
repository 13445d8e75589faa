"""The whole pipeline against a plain version of each stage."""

import glob
import os

import duckdb
import pyarrow as pa  # noqa: F401
import pytest

import corpus_pipeline
from gristmill.llm import secret_scan as ss
from gristmill.llm.oracles import ORACLES
from tests.llm.test_joins import brute_components, brute_tiles, words


def plain(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({ORACLES['op3_quality_rules']}) where kept").fetchall()}
    rows = [r for r in con.sql("select doc_id, text from documents order by doc_id").fetchall() if r[0] in kept]
    comp = brute_components(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    tests = [words(t) for _, t in con.sql("select item_id, text from benchmark").fetchall()]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    clean = []
    for d, t in rows:
        w = words(t)
        own = {k: runs(w, k) for k in (1, 2, 3)}
        # without a run as long as the least tile there is no tile at all
        if not any(own[min(3, len(x))] & runs(x, min(3, len(x))) and 2 * sum(brute_tiles(x, w, 3)) >= len(x) for x in tests if x):
            clean.append((d, t))
    out = {}
    for d, t in clean:
        mask = [False] * len(t)
        for a, b, _ in ss.spans(t):
            mask[a:b] = [True] * (b - a)
        parts, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and mask[j] == mask[i]:
                j += 1
            parts.append("[SECRET]" if mask[i] else t[i:j])
            i = j
        out[d] = "".join(parts)
    return out


def test_run_matches_the_plain_version(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = {d: lib.encode(t) for d, t in plain(sf_dir).items()}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == want and all(r.round_trip for r in got.collect())


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, odd, sf_dir, stage):
    name, f = corpus_pipeline.STAGES[stage]
    for d in (odd, odd.where("false")):
        r = f(spark, d, sf_dir)
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert r.columns == odd.columns
        assert r.count() <= d.count()
