import csv
import io
import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import chat, questions, text, urls
from gristmill.functions.html import repo_links
from gristmill.plans.generate import last_lines_text


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i int, {kind if ' ' in kind else 'x ' + kind}")
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.orderBy("i").select(f(*cols)).collect()]


def test_strip_is_pythons(spark):
    values = ["", " a ", " a　", "\x1ca\x1f", "a\n", "\t\r\n", " x y ", "\x85z"]
    assert one(spark, values, text.strip) == [v.strip() for v in values]


def test_truncate(spark):
    values = ["a" * 2048, "a" * 2049, "é" * 3000, None]
    got = one(spark, values, text.truncate_context)
    assert got[0] == values[0] and got[3] is None
    for v, g in zip(values[1:3], got[1:3]):
        assert g == v[:1024] + "\n... [Content truncated for model context window] ...\n" + v[-1024:]


def test_sizes_names_paths(spark):
    assert one(spark, [0, 1023, 1024, 1536, 1024**2, 1024**4 * 3], text.human_size, "long") == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "3.0 TB"]
    assert one(spark, ["models--a--b"], text.cache_dir_model) == ["a/b"]
    assert one(spark, ["a/b"], text.model_cache_dir) == ["models--a--b"]
    assert one(spark, ["x/y/z.py", "z.py", ""], text.base_name) == ["z.py", "z.py", ""]
    assert one(spark, ["x/y/z.py", "z.py"], text.dir_name) == ["x/y", ""]
    assert one(spark, ["now 42%; 7%", "none"], text.percent_of) == [42, None]
    assert one(spark, ["a\r\nb\rc"], text.fold_newlines) == ["a\nb\nc"]


def test_source_prefix(spark):
    assert one(spark, [("repo_file:A.py", "a.py"), ("repo_file:a.pyc", "a.py"), ("repo_file:b", "a"), ("repo_file:axb", "a_b")], text.source_like, "t string, p string") == [True, True, False, False]
    assert one(spark, ["repo_file:a/b", "other"], text.source_path) == ["a/b", None]


def test_question_lines(spark):
    assert one(spark, [" What? \nNo.\n\nWhy ?\n", "none", None], questions.question_lines) == [["What?", "Why ?"], None, None]


@pytest.mark.parametrize(
    "said, found",
    [
        ("", []),
        ("  \n", []),
        ("Q1: What is X?", ["What is X?"]),
        ("Q: What is X?", []),
        ("q2: tail missing? no", ["tail missing?"][:0]),
        ("What is X? And Y?", ["What is X?", "And Y?"]),
        ("1. What is X?\n2. What is Y?", ["What is X?", "What is Y?"]),
        ("1. What is X? 2. Why?", ["What is X?", "Why?"]),
        ("Is v1.2 new?", ["Is v2 new?", "2 new?"]),
        ("What?\nWhat?", ["What?"]),
        ("no mark at all", ["no mark at all?"]),
        ("a?", []),
    ],
)
def test_parse_questions(said, found):
    assert questions.parse_questions(said) == found


@given(st.text(alphabet="Qq1. :?\nab", max_size=40))
def test_parse_questions_properties(said):
    found = questions.parse_questions(said)
    assert len(found) == len(set(found)) and all(q == q.strip() and q for q in found)
    assert all(q.endswith("?") for q in found)


def test_clean_answer(spark):
    assert one(spark, [("Answer: it is. Why?", "Why?"), ("Answer:  ", "q"), ("plain", "")], questions.clean_answer, "a string, q string") == ["it is.", None, "plain"]


def test_urls(spark):
    us = ["https://github.com/org", "https://github.com/org/repo.git", "https://github.com/", "https://gitlab.com/a/b.git", "https://notgithub.com/x/y", "https://u@github.com:443/o/r/", "plain"]
    assert one(spark, us, urls.url_kind) == ["org_page", "direct_repo", "direct_unclear", "direct", "direct_repo", "direct_repo", "direct"]
    assert one(spark, us, urls.clone_path) == ["repos/org", "repos/org/repo", "repos/", "repos/b", "repos/x/y", "repos/o/r", "repos/plain"]
    assert one(spark, us, urls.netloc)[5] == "u@github.com:443"


def test_repo_links():
    page = """<h3 class="f4 wb-break-all"><span><a href="/o/a">a</a></span><a href="/o/zz"></a></h3><a data-hovercard-type="repository" href="/o/b"></a>
    <div class="Box-row"><div><a href="/x"></a><a itemprop="name codeRepository" href="/o/c"></a></div></div><a class="v-align-middle" href="/o/d"><a class="v-align-middle" href="/o/d/e"><a class="v-align-middle" href="https://z/q">
    <h3><a href="/no"></a></h3><a data-hovercard-type="repository" href="http://else"></a>"""
    assert repo_links(page) == [f"https://github.com/o/{x}" for x in "abcd"]
    assert repo_links(None) == [] and repo_links("<div><p>") == []


def test_templates(spark):
    rows = [(None, "u %s", "a"), ("sys", 'q,"x"\n', "é"), ("", "", "")]
    kind = "s string, u string, a string"
    assert one(spark, rows, lambda s, u, a: chat.render("llama3", s, u, a), kind)[0].startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are a helpful AI assistant.<|eot_id|>")
    assert one(spark, rows, lambda s, u, a: chat.render("mistral", s, u, a), kind)[:2] == ["<s>[INST] u %s [/INST]a</s>", '<s>[INST] sys\n\nq,"x"\n [/INST]é</s>']
    assert one(spark, rows, lambda s, u, a: chat.render("gemma", s, u, a), kind)[0] == "<start_of_turn>user\nu %s<end_of_turn><start_of_turn>model\na<end_of_turn>"
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([r[1:] for r in rows])
    assert "\n".join(one(spark, rows, lambda s, u, a: chat.render("csv", s, u, a), kind)) + "\n" == out.getvalue()
    for exact in (False, True):
        alpaca = one(spark, rows, lambda s, u, a: chat.render("alpaca-jsonl", s, u, a, exact), kind)
        assert [json.loads(x) for x in alpaca] == [{"instruction": u, "input": "", "output": a} for _, u, a in rows]
    assert alpaca == [json.dumps({"instruction": u, "input": "", "output": a}) for _, u, a in rows]
    said = one(spark, rows, lambda s, u, a: chat.render("chatml-jsonl", s, u, a), kind)
    assert [len(json.loads(x)["messages"]) for x in said] == [2, 3, 2]
    with pytest.raises(ValueError):
        chat.render("other", F.lit(""), F.lit(""), F.lit(""))


def test_sse(spark):
    line = lambda c: "data: " + json.dumps({"choices": [{"delta": {"content": c}}]})
    streams = [[line(" Hel"), line("lo "), "data: [DONE]"], ["data: [DONE]"], ["noise", "data: {bad", line("x"), 'data: {"choices":[]}'], []]
    assert one(spark, streams, chat.sse_text, "array<string>") == ["Hello", None, "x", None]
    assert [last_lines_text(iter(s)) for s in streams] == ["Hello", None, "x", None]


def test_model_ids_and_prompt(spark):
    assert one(spark, ['{"data":[{"id":"a"},{"id":"b"}]}', "bad"], chat.model_ids) == [["a", "b"], None]
    df = spark.sql("select array(named_struct('role','system','content','s'), named_struct('role','user','content','u')) c")
    assert df.select(chat.plain_prompt(F.col("c"))).first()[0] == "System: s\n\nUser: u"


@given(st.text(max_size=30))
def test_percent_pattern(x):
    assert (m := re.search(r"(\d+)%", x, re.A)) is None or m[1].isdigit()
