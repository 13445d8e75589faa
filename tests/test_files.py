import hashlib
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gristmill.operators.incremental import kept_skipped
from gristmill.settings import READ_TIMEOUT, Settings
from gristmill.sources import files as sources
from gristmill.sources.files import file_corpus, file_list, file_stream, find_repos, folders, list_files, model_cache, model_files, remove_model, repo_table, with_contents, within
from gristmill.sources.sinks import new_log, prune_logs, write_count, write_lines


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have this module


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "o/r/.git/config": b"x", "o/r/a.py": b"print(1)\r\nx\xff\r", "o/r/__init__.py": b"", "o/r/_p/x.py": b"y", "o/r/.hidden": b"h", "o/r/.d/x.py": b"h", "o/r/p.png": b"p", "o/r/P.PNG": b"p",
        "o/r/big.txt": b"b" * 101, "o/r/edge.txt": b"b" * 100, "o/r/inner/.git/HEAD": b"x", "o/r/inner/z.py": b"z", "o/s/.git/config": b"x", "o/s/b.py": b"b",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(tmp_path / "o/r/a.py", tmp_path / "o/s/link.py")
    return tmp_path


def test_repos_do_not_nest(tree):
    assert find_repos(str(tree)) == [str(tree / "o/r"), str(tree / "o/s")]


def test_listing(tree):
    got = {os.path.relpath(p, tree / "o/r"): kept for p, _, kept in list_files(str(tree / "o/r"), 100)}
    assert got == {".hidden": False, "P.PNG": True, "__init__.py": True, "_p/x.py": True, "a.py": True, "big.txt": False, "edge.txt": True, "inner/z.py": True, "p.png": False}


def test_corpus(spark, tree):
    rows = {os.path.relpath(r.file_path, tree): r for r in file_corpus(spark, Settings(repos_dir=str(tree), max_file_size=100)).collect()}
    a = rows["o/r/a.py"]
    assert a.content == "print(1)\nx\n" and a.content_hash == hashlib.sha256(b"print(1)\r\nx\xff\r").hexdigest() and a.repo == str(tree / "o/r")
    assert rows["o/r/big.txt"].content is None and not rows["o/r/big.txt"].kept and rows["o/r/__init__.py"].content == "" and "o/s/link.py" in rows


def test_model_cache(spark, tmp_path):
    (tmp_path / "models--a--b/x").mkdir(parents=True)
    (tmp_path / "models--a--b/x/w.safetensors").write_bytes(b"1" * 2048)
    (tmp_path / "models--none").mkdir()
    assert [(r.name, r.size, r.files) for r in model_cache(spark, str(tmp_path)).collect()] == [("a/b", "2.0 KB", 1)]
    assert [tuple(r) for r in model_files(spark, str(tmp_path), "a/b").collect()] == [("x/w.safetensors", 2048, "2.0 KB")] and model_files(spark, str(tmp_path), "no/such").count() == 0
    assert not remove_model(str(tmp_path), "a/b", lambda q: False) and not remove_model(str(tmp_path), "no/such", lambda q: True)
    assert remove_model(str(tmp_path), "a/b", lambda q: True) and sorted(os.listdir(tmp_path)) == ["models--none"]


def test_logs_and_count(spark, tmp_path):
    for i in range(6):
        p = tmp_path / f"pipeline_log_{i}.log"
        p.write_text("x")
        os.utime(p, (i, i))
    log = new_log(str(tmp_path))
    open(log, "w").close()
    assert len(prune_logs(spark, str(tmp_path), keep=3)) == 4
    assert set(os.listdir(tmp_path)) == {"pipeline_log_4.log", "pipeline_log_5.log", os.path.basename(log)} and prune_logs(spark, str(tmp_path), 3) == []
    assert open(write_count(3, str(tmp_path / "d"))).read() == "3"


def test_skipped_files_are_counted(spark, tree):
    os.mkfifo(tree / "o/s/pipe")
    got = {os.path.basename(r.repo): (r.kept, r.skipped) for r in kept_skipped(file_corpus(spark, Settings(repos_dir=str(tree), max_file_size=100))).collect()}
    assert got == {"r": (6, 3), "s": (2, 1)}  # hidden, png and large; the pipe


def test_folders_cover_a_tree_once(tree):
    want = sorted(p for p, *_ in list_files(str(tree / "o/r")))
    for levels in range(4):
        parts = list(folders(str(tree / "o/r"), levels))
        assert sorted(p for f, deep in parts for p, *_ in list_files(f, deep=deep)) == want
    assert len(parts) == 3


def test_a_read_that_hangs_is_a_failure(spark, tree, monkeypatch):
    assert within(0.05, time.sleep, 5) is None and within(5, lambda: "x") == "x"
    s = Settings(repos_dir=str(tree / "o/s"), read_timeout=0.05)
    [row] = with_contents(file_list(spark, s).where(F.col("file_path").endswith("b.py")), s, read=lambda path: time.sleep(5)).collect()
    assert row.error == READ_TIMEOUT and row.kept and row.content is None
    monkeypatch.setattr(sources, "read_file", lambda path: time.sleep(5))
    reader = sources.FileReader({"root": str(tree / "o/s"), "timeout": "0.05"})
    [row] = [r for p in reader.partitions() for r in reader.read(p) if r[1].endswith("b.py")]
    assert row[-1] == READ_TIMEOUT and row[3]


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_pushed_into_the_source(spark, tree):
    s, at = Settings(repos_dir=str(tree), max_file_size=100), lambda *names: sorted(str(tree / n) for n in names)
    files = file_list(spark, s)
    everything = sorted(r.file_path for r in files.collect())
    for condition, want in (
        (F.col("repo") == str(tree / "o/s"), at("o/s/b.py", "o/s/link.py")),
        (F.col("repo").isin(str(tree / "o/s"), str(tree / "o/r/inner"), str(tree / "o"), "/"), at("o/s/b.py", "o/s/link.py")),
        (F.col("file_path").isin(*at("o/r/_p/x.py", "o/r/.d/x.py", "o/r/none", "o/r/_p", "o/s/link.py")), at("o/r/_p/x.py", "o/s/link.py")),
        (F.col("file_path") == str(tree / "o/r/inner/z.py"), at("o/r/inner/z.py")),
        (~F.col("kept") & (F.col("size") > 1), at("o/r/big.txt")),
        (F.col("kept") & F.col("file_path").endswith(".py") & ~F.col("file_path").contains("/o/r/"), at("o/s/b.py", "o/s/link.py")),
        (F.col("file_path").startswith(str(tree / "o/r/e")) & (F.col("size") <= 100), at("o/r/edge.txt")),
    ):
        got = files.where(condition)
        assert sorted(r.file_path for r in got.collect()) == want and set(want) <= set(everything)
        assert " Filter " not in scan_of(got)
    both = files.where((F.col("repo") == str(tree / "o/s")) & (F.length("file_path") > 3))  # what isn't understood stays with Spark
    assert " Filter " in scan_of(both) and both.count() == 2


def test_a_filter_on_the_repository_walks_no_other(tree, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader, walked = sources.FileReader({"root": str(tree)}), []
    assert list(reader.pushFilters([EqualTo(("repo",), str(tree / "o/s")), f := GreaterThan(("content",), "x")])) == [f]
    monkeypatch.setattr(sources.os, "walk", lambda top, *a, walk=os.walk, **k: walked.append(top) or walk(top, *a, **k))
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [str(tree / "o/s/b.py"), str(tree / "o/s/link.py")]
    assert walked == [str(tree / "o/s")]
    reader = sources.FileReader({"root": str(tree)})
    list(reader.pushFilters([In(("file_path",), (str(tree / "o/s/b.py"),)), EqualTo(("repo",), str(tree / "o/s"))]))
    del walked[:]
    assert [r[5] for p in reader.partitions() for r in reader.read(p)] == ["b"] and walked == []


def test_contents_are_read_apart_from_the_listing(spark, tree):
    s = Settings(repos_dir=str(tree), max_file_size=100)
    got = {r.file_path: r for r in with_contents(file_list(spark, s), s).collect()}
    assert got == {r.file_path: r for r in file_corpus(spark, s).collect()} and len(got) == 11


def test_repos_are_found_by_tasks(spark, tree, tmp_path):
    assert sorted(r.repo for r in repo_table(spark, str(tree)).collect()) == find_repos(str(tree))
    assert [r.repo for r in repo_table(spark, str(tree / "o/s")).collect()] == [str(tree / "o/s")]
    assert repo_table(spark, str(tmp_path / "none")).count() == 0


def test_a_stopped_stream_goes_on_with_new_files_only(spark, tree, tmp_path):
    s, seen = Settings(repos_dir=str(tree), max_file_size=100), tmp_path / "seen"

    def run():
        batches = []
        q = file_stream(spark, s, settle=0).writeStream.foreachBatch(lambda df, i: batches.extend((os.path.relpath(r.file_path, tree), r.content) for r in df.collect()))
        q.option("checkpointLocation", f"file://{seen}").trigger(availableNow=True).start().awaitTermination()
        return sorted(batches)

    assert [p for p, _ in run()] == ["o/r/P.PNG", "o/r/__init__.py", "o/r/_p/x.py", "o/r/a.py", "o/r/edge.txt", "o/r/inner/z.py", "o/s/b.py", "o/s/link.py"]
    assert run() == []
    (tree / "o/r/__init__.py").write_text("changed")
    (tree / "old.py").write_text("moved")
    os.utime(tree / "old.py", (1, 1))
    os.rename(tree / "old.py", tree / "o/s/moved.py")
    (tree / "o/r/q.png").write_text("left out")
    assert run() == [("o/r/__init__.py", "changed"), ("o/s/moved.py", "moved")]


def test_one_file_of_many_partitions(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))).alias("line"))
    write_lines(rows.repartitionByRange(200, "id").sortWithinPartitions("id"), f"file://{tmp_path}/d/out.txt", "\r\n")
    want = "".join(("" if i % 7 == 0 else "é" + "x" * (i % 50) + str(i)) + "\r\n" for i in range(20_000))
    assert (tmp_path / "d/out.txt").read_bytes() == want.encode() and os.listdir(tmp_path / "d") == ["out.txt"]
    write_lines(rows.where("false"), str(tmp_path / "d/out.txt"))
    assert (tmp_path / "d/out.txt").read_bytes() == b"" and os.listdir(tmp_path / "d") == ["out.txt"]
    with pytest.raises(ValueError):
        write_lines(rows, "s3a://bucket/x")


def test_a_file_appears_whole_or_not_at_all(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") < 99, "x").otherwise(F.raise_error(F.lit("no"))).alias("line"))
    with pytest.raises(Exception, match="no"):
        write_lines(bad, str(tmp_path / "out.txt"))
    writer = sources_of_lines(str(tmp_path / "out.txt"))
    open(writer.unfinished, "w").close()
    with pytest.raises(RuntimeError):
        writer.commit([])
    assert os.listdir(tmp_path) == []


def sources_of_lines(path):
    from gristmill.sources.sinks import LineWriter

    return LineWriter({"target": path, "unfinished": f"{path}.tmp", "end": "\n", "places": "{}", "bytes": "3"})
