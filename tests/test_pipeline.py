import json
import os
import sys
import time
import uuid
from http.client import IncompleteRead

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gristmill.cli import parse, settings_of
from gristmill.operators import conversations as conv
from gristmill.operators import incremental as inc
from gristmill.operators.ids import dense_ids
from gristmill.operators.store import TableStore
from gristmill.plans import pipeline
from gristmill.plans.generate import HttpGenerator, LocalGenerator, StubGenerator, answers_batch, ask, generator
from gristmill.settings import NO_ANSWER, NO_QUESTIONS, Settings
from gristmill.sources.files import file_stream, read_file
from gristmill.sources.repos import Pace, clone_or_update, repo_list, targets
from gristmill.sources.sinks import write_export
from gristmill.streaming import prepare as streaming
from gristmill.streaming import retry as backoff


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have this module


@pytest.fixture
def world(spark, tmp_path):
    repo = tmp_path / "repos/o/r"
    (repo / ".git").mkdir(parents=True)
    for name, body in {"a.py": "alpha beta", "b.py": "BAD", "empty.py": " \n", "c.py": "gamma HALF delta"}.items():
        (repo / name).write_text(body)
    s = Settings(repos_dir=str(tmp_path / "repos"), data_dir=str(tmp_path / "data"))
    return s, TableStore(spark, f"file://{tmp_path}/store", F.to_timestamp(F.lit("2024-01-01 00:00:00")), buckets=4), repo


class Half(StubGenerator):
    def answer(self, question, content, temperature, max_tokens):
        return None if "HALF" in content and "gamma" in question else super().answer(question, content, temperature, max_tokens)


def names(rows):
    return {os.path.basename(r.file_path): (r.success, r.qa_count) for r in rows}


def test_prepare_retry_export(spark, world, tmp_path):
    s, store, repo = world
    assert names(pipeline.prepare(spark, s, store, Half(fail="BAD")).collect()) == {"a.py": (True, 2), "b.py": (False, 0), "empty.py": (True, 0), "c.py": (True, 0)}
    assert {os.path.basename(r.file_path): r.reason for r in store.read("failed_files").collect()} == {"b.py": NO_QUESTIONS, "c.py": NO_ANSWER}
    assert [os.path.basename(r.file_path) for r in store.read("file_hashes").collect()] == ["a.py"]
    # unchanged files are left alone; failures come again
    assert set(names(pipeline.prepare(spark, s, store, Half(fail="BAD")).collect())) == {"b.py", "empty.py", "c.py"}
    # retry: each path once, success clears its failures
    assert names(pipeline.retry(spark, s, store, StubGenerator(fail="BAD")).collect()) == {"b.py": (False, 0), "c.py": (True, 2)}
    assert {os.path.basename(r.file_path) for r in store.read("failed_files").collect()} == {"b.py"}
    # a changed file keeps its old samples and asks only what is new
    (repo / "a.py").write_text("alpha new")
    assert names(pipeline.prepare(spark, s, store, StubGenerator(fail="BAD")).collect())["a.py"] == (True, 1)
    assert store.read("training_samples").count() == 5
    # a removed file is forgotten
    (repo / "c.py").unlink()
    pipeline.prepare(spark, s, store, StubGenerator(fail="BAD"))
    assert store.read("training_samples").count() == 3 and store.read("conversation_turns").count() == 6
    pipeline.export(spark, s, "alpaca-jsonl", f"file://{tmp_path}/out.jsonl", store, one_file=True)
    lines = (tmp_path / "out.jsonl").read_text().splitlines()
    assert [json.loads(x)["instruction"] for x in lines] == ["What does alpha mean here?", "What does beta mean here?", "What does new mean here?"]


def test_export_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0, "user", 'a "b"'), (2, 1, "assistant", "x\ny"), (1, 0, "user", "u1"), (1, 2, "user", "u2"), (1, 1, "assistant", "é,"), (1, 3, "system", "s")], "sample_id long, turn_index int, role string, content string")
    want = 'user_content,assistant_content\r\n"u1\nu2","é,"\r\n"a ""b""","x\ny"\r\n'.encode()
    write_export(conv.collect_conversations(rows), "csv", f"file://{tmp_path}/one.csv", one_file=True)
    assert (tmp_path / "one.csv").read_bytes() == want
    write_export(conv.collect_conversations(rows), "csv", f"file://{tmp_path}/csv")
    parts = sorted(f for f in os.listdir(tmp_path / "csv") if f.startswith("part"))
    assert b"".join((tmp_path / "csv" / f).read_bytes() for f in parts) == want


def test_incremental(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    now, was = df([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, content_hash string"), df([("a", "1"), ("b", "x"), ("d", "4")], "file_path string, content_hash string")
    assert {r.file_path: r.status for r in inc.file_status(now, was).collect()} == {"a": "unchanged", "b": "updated", "c": "new", "d": "removed"}
    assert {r.file_path for r in inc.to_process(now, was).collect()} == {"b", "c"}
    asked = df([("f", "q"), ("f", "q"), ("f", "new"), ("f", "new")], "file_path string, question string")
    processed = asked.where("question = 'q'").select("file_path", F.sha2("question", 256).alias("q_hash")).distinct()
    assert [r.question for r in inc.new_questions(asked, processed).collect()] == ["new", "new"]
    k = df([("a",), ("b",), ("c",)], "k string")
    assert [r.k for r in inc.resume(k, "k", "b").orderBy("k").collect()] == ["b", "c"] and inc.resume(k, "k", "x").count() == 3


def test_dense_ids(spark):
    d = dense_ids(spark.range(1000).repartition(7), ["id"], "n", start=5)
    assert d.where("n <> id + 5").count() == 0
    assert dense_ids(spark.range(0), ["id"], "n").count() == 0


def test_repo_list_and_targets(spark, tmp_path):
    (tmp_path / "repos.txt").write_text("# no\n\n  https://github.com/org  \nhttps://github.com/o/r.git\nhttps://github.com/o/r.git\n")
    urls = repo_list(spark, f"file://{tmp_path}/repos.txt")
    assert urls.count() == 3 and repo_list(spark, f"file://{tmp_path}/none").count() == 0
    page = '<a data-hovercard-type="repository" href="/org/x"></a><a data-hovercard-type="repository" href="/org/y"></a>'
    got = sorted(tuple(r) for r in targets(urls, "repos", get=lambda u: page, pause=0).collect())
    assert got == [("https://github.com/o/r.git", "repos/o/r"), ("https://github.com/org/x", "repos/org/x"), ("https://github.com/org/y", "repos/org/y")]


def test_clone_or_update(tmp_path):
    said = []

    def run(args, cwd=None):
        said.append(args[0])
        return args[0] != "reset", ""

    assert clone_or_update([("u", str(tmp_path)), ("v", str(tmp_path / "n/m"))], run) == [(str(tmp_path), False), (str(tmp_path / "n/m"), True)]
    assert said == ["reset", "clone"]


class Reply:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def read(self):
        return self.body

    def __iter__(self):
        return iter(self.body.splitlines(keepends=True))


def test_http_backend():
    line = lambda c: b"data: " + json.dumps({"choices": [{"delta": {"content": c}}]}).encode() + b"\n"
    tries = []

    def opener(request, timeout=None):
        if isinstance(request, str):
            return Reply(b'{"data":[{"id":"m1"},{"id":"m2"}]}')
        tries.append(json.loads(request.data))
        if len(tries) == 1:
            raise OSError("down")
        return Reply(line("Why so?\n") + line("Not this.\nHow?") + b"data: [DONE]\n")

    g = HttpGenerator(Settings(model="gone", retry_delay=0), opener=opener)
    assert g.model() == "m1" and HttpGenerator(Settings(model="m2"), opener=opener).model() == "m2"
    assert g.ask("text", 0.7, 500) == "Why so?\nNot this.\nHow?" and len(tries) == 2
    assert answers_batch(StubGenerator(), [("q", "a b"), ("q", "a")], Settings(files_in_flight=2)) == ["It is one of 2 words.", "It is one of 1 words."]
    with pytest.raises(ValueError):
        HttpGenerator(Settings(), opener=lambda *a, **k: Reply(b"{}")).model()
    with pytest.raises(ValueError):
        generator(Settings(backend="no"))


def test_a_broken_stream_is_tried_again():
    tries = []

    def opener(request, timeout=None):
        if isinstance(request, str):
            return Reply(b'{"data":[{"id":"m"}]}')
        tries.append(1)
        if len(tries) == 1:
            raise IncompleteRead(b"")
        return Reply(b'data: {"choices":[{"delta":{"content":"Why?"}}]}\n')

    assert HttpGenerator(Settings(retry_delay=0), opener=opener).ask("t", 0.7, 500) == "Why?" and len(tries) == 2


def test_models_are_asked_for_once_by_all_tasks_of_a_process():
    asked = []

    def opener(request, timeout=None):
        asked.append(1)
        return Reply(b'{"data":[{"id":"m"}]}')

    for _ in range(3):
        assert HttpGenerator(Settings(base_url="http://x"), opener=opener).model() == "m"
    assert len(asked) == 1


class Counting(StubGenerator):
    def ask(self, content, temperature, max_tokens):
        open(f"{self.fail}/{uuid.uuid4().hex}", "w").close()
        return "Same?\n Same? \nNot a question."

    answer = lambda self, q, c, t, n: open(f"{self.fail}/{uuid.uuid4().hex}", "w").close() or "yes"


def test_equal_prompts_are_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    files = spark.createDataFrame([(f"f{i}", "1", "one content", None) for i in range(5)] + [("g", "2", "another", None)], "file_path string, content_hash string, content string, error string")
    store = TableStore(spark, f"file://{tmp_path}/store", buckets=4)
    got = pipeline.process(files, store, Counting(fail=str(tmp_path / "calls")), Settings(model_tasks=3)).collect()
    assert len(got) == 6 and all(r.qa_count == 2 for r in got) and len(os.listdir(tmp_path / "calls")) == 4
    asked = ask(files, StubGenerator(), Settings(model_tasks=5))
    assert {r.file_path: r.questions for r in asked.collect()}["f3"] == ["What does one mean here?", "What does content mean here?"]


def test_prepare_by_repo_keeps_its_place(spark, world):
    s, store, repo = world
    other = repo.parent / "q"
    (other / ".git").mkdir(parents=True)
    (other / "z.py").write_text("zeta")
    s.by_repo = True
    store.save_state({"current_repo_name": str(repo)})  # q is done
    assert set(names(pipeline.prepare(spark, s, store, StubGenerator(fail="BAD")).collect())) == {"a.py", "b.py", "c.py", "empty.py"}
    assert store.load_state()["current_repo_name"] is None
    assert set(names(pipeline.prepare(spark, s, store, StubGenerator(fail="BAD")).collect())) == {"b.py", "empty.py", "z.py"}


def test_a_tree_without_repositories_is_one(spark, tmp_path):
    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/a.py").write_text("alpha")
    s = Settings(repos_dir=f"{tmp_path}/t/", by_repo=True)
    store = TableStore(spark, f"file://{tmp_path}/store", buckets=4)
    assert names(pipeline.prepare(spark, s, store, StubGenerator()).collect()) == {"a.py": (True, 1)}


def test_prepare_by_batches_keeps_its_place_within_a_repository(spark, world):
    s, store, repo = world
    (repo / "b.py").write_text("beta")
    s.by_repo, s.batch_files = True, 2
    states = []

    class Told(TableStore):
        def save_state(self, state):
            states.append(state)
            super().save_state(state)

    told = Told(spark, store.root, store.now)
    with pytest.raises(KeyboardInterrupt):  # after the first batch: a and b
        told.save_state = lambda state: Told.save_state(told, state) if state.get("processed_files_count_in_repo", 0) < 4 else (_ for _ in ()).throw(KeyboardInterrupt())
        pipeline.prepare(spark, s, told, StubGenerator())
    state = store.load_state()
    assert (os.path.basename(state["current_file_path_in_repo"]), state["processed_files_count_in_repo"], state["current_repo_name"]) == ("b.py", 2, str(repo))
    assert {os.path.basename(r.file_path) for r in store.read("file_hashes").collect()} == {"a.py", "b.py"}
    del states[:]
    again = pipeline.prepare(spark, s, Told(spark, store.root, store.now), StubGenerator())
    assert set(names(again.collect())) == {"c.py", "empty.py"}  # b.py is looked at once more and is unchanged
    assert [x.get("processed_files_count_in_repo") for x in states] == [2, 4, 5, 0] and store.load_state()["current_file_path_in_repo"] is None


def counted(folder):
    def read(path):
        open(f"{folder}/{os.path.basename(path)}-{uuid.uuid4().hex}", "w").close()
        return read_file(path)

    return read


@pytest.mark.parametrize("by_repo", [False, True])
def test_each_file_is_opened_once(spark, world, tmp_path, by_repo):
    s, store, repo = world
    for name in "xy":
        (repo.parent / name / ".git").mkdir(parents=True)
        (repo.parent / name / f"{name}.py").write_text(name)
    (repo / "p.png").write_text("not kept")
    (tmp_path / "opened").mkdir()
    s.by_repo = by_repo
    opened = lambda: sorted(f.partition("-")[0] for f in os.listdir(tmp_path / "opened"))
    pipeline.prepare(spark, s, store, StubGenerator(fail="BAD"), counted(tmp_path / "opened")).collect()
    assert opened() == ["a.py", "b.py", "c.py", "empty.py", "x.py", "y.py"]
    for f in os.listdir(tmp_path / "opened"):
        (tmp_path / "opened" / f).unlink()
    pipeline.retry(spark, s, store, StubGenerator(fail="BAD"), counted(tmp_path / "opened")).collect()
    assert opened() == ["b.py"]


def test_a_second_run_over_equal_content_makes_no_call(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    kind = "file_path string, content_hash string, content string, error string"
    store, g, calls = TableStore(spark, f"file://{tmp_path}/store", buckets=4), Counting(fail=str(tmp_path / "calls")), lambda: len(os.listdir(tmp_path / "calls"))
    first = pipeline.process(spark.createDataFrame([("f", "1", "one content", None)], kind), store, g, Settings()).collect()
    assert [r.qa_count for r in first] == [2] and calls() == 2
    other = spark.createDataFrame([("g", "1", "one content", None), ("h", "1", "one content", None)], kind)
    assert [r.qa_count for r in pipeline.process(other, store, g, Settings()).collect()] == [2, 2] and calls() == 2
    assert store.read("memo").count() == 2
    more = lambda p: spark.createDataFrame([(p, "1", "one content", None)], kind)
    pipeline.process(more("i"), store, g, Settings(memo_days=0, temperature=0.1)).collect()
    assert calls() == 4
    late = TableStore(spark, store.root, F.current_timestamp() + F.expr("interval 8 days"))
    pipeline.process(more("k"), late, g, Settings()).collect()
    assert calls() == 6  # what was remembered is too old
    asked = ask(more("l"), g, Settings(), pipeline.remembered(late, Settings()))
    assert [r.fresh for r in asked.collect()] == [False] and calls() == 6
    assert [r.fresh for r in ask(more("l"), g, Settings(temperature=0.1), pipeline.remembered(late, Settings())).collect()] == [True]


def test_failures_are_not_remembered(spark, tmp_path):
    kind = "file_path string, content_hash string, content string, error string"
    store = TableStore(spark, f"file://{tmp_path}/store", buckets=4)
    rows = spark.createDataFrame([("f", "1", "BAD gamma HALF", None)], kind)
    assert not pipeline.process(rows, store, StubGenerator(fail="BAD"), Settings()).collect()[0].success
    assert pipeline.process(rows, store, Half(), Settings()).collect()[0].qa_count == 0
    assert pipeline.process(rows, store, StubGenerator(), Settings()).collect()[0].qa_count == 2


def load_counting(folder):
    def load():
        open(f"{folder}/load-{uuid.uuid4().hex}", "w").close()

        def generate(prompts, max_tokens):
            open(f"{folder}/batch-{len(prompts)}-{uuid.uuid4().hex}", "w").close()
            if any("BAD" in p for p in prompts):
                raise ValueError("bad prompt")
            return ["Answer: yes, here" if "Answer:" in p else "1. What is it? Why so?\n2. How?" for p in prompts]

        return generate

    return load


def test_a_local_model_is_loaded_once_and_gets_bounded_batches(spark, tmp_path):
    (tmp_path / "m").mkdir()
    kind = "file_path string, content_hash string, content string, error string"
    files = spark.createDataFrame([(f"f{i}", "1", f"content {i}", None) for i in range(30)], kind)
    store, s = TableStore(spark, f"file://{tmp_path}/store", buckets=4), Settings(model_tasks=1, backend="local")
    g = LocalGenerator(load_counting(str(tmp_path / "m")), batch=7)
    got = pipeline.process(files, store, g, s).collect()
    assert len(got) == 30 and {r.qa_count for r in got} == {3}
    assert {r.content for r in store.read("conversation_turns").where("role = 'assistant'").collect()} == {"yes, here"}
    made = os.listdir(tmp_path / "m")
    sizes = [int(x.split("-")[1]) for x in made if x.startswith("batch")]
    assert max(sizes) <= 7 and sum(sizes) == 30 + 90 and sum(x.startswith("load") for x in made) <= 2  # one for questions, one for answers
    bad = pipeline.process(spark.createDataFrame([("b", "1", "BAD", None)], kind), store, g, s).collect()
    assert not bad[0].success and store.read("failed_files").first().reason == "bad prompt"
    assert isinstance(generator(Settings(backend="local", local_model="a.b:c")), LocalGenerator)


def test_scrape_clones_by_tasks_at_a_pace(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "repos.txt").write_text("https://github.com/org\nhttps://github.com/o/r.git\nhttps://github.com/o/r\nhttps://other.example/x/y.git\n")
    page = "".join(f'<a data-hovercard-type="repository" href="/org/p{i}"></a>' for i in range(6))

    def run(args, cwd=None):
        open(f"{tmp_path}/log/{args[0]}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        if args[0] == "clone":
            os.makedirs(f"{args[2]}/.git")
        return args[-1] != f"{tmp_path}/repos/org/p5", ""

    s = Settings(repos_dir=str(tmp_path / "repos"), data_dir=str(tmp_path / "data"), lanes_per_host=3)
    assert pipeline.scrape(spark, s, f"file://{tmp_path}/repos.txt", get=lambda u: page, run=run, pause=0) == 8
    did = [x.split("-") for x in os.listdir(tmp_path / "log")]
    assert sorted(x[0] for x in did) == ["clone"] * 8 + ["pull", "reset"] and str(os.getpid()) not in {x[1] for x in did}
    assert (tmp_path / "data/repo_count.txt").read_text() == "8"


def test_lanes_keep_a_hosts_pause(spark):
    pace, began = Pace(0.05, 2), time.monotonic()
    for lane in [("h", 0)] * 4 + [("i", 0)]:
        pace.wait(lane)
    assert 0.3 <= time.monotonic() - began < 0.6
    rows = spark.createDataFrame([(f"https://h/{i}", f"p{i % 10}") for i in range(40)], "url string, path string")
    from gristmill.sources.repos import host_of, in_lanes

    dealt = in_lanes(rows, host_of(F.col("url")), F.col("path"), 4).select("host", "lane", "path", F.spark_partition_id().alias("part")).collect()
    assert len({r.lane for r in dealt}) > 1 and {r.host for r in dealt} == {"h"}
    assert len({(r.path, r.part) for r in dealt}) == 10  # one path, one task


def test_cli():
    a = settings_of(parse(["prepare", "--max-file-size", "5", "--temperature", "0.1"]))
    assert (a.max_file_size, a.temperature, a.max_tokens) == (5, 0.1, 500)
    assert settings_of(parse(["--data-dir", "x", "retry"])).data_dir == "x"
    assert parse(["export", "--template", "gemma", "--output-file", "o"]).template == "gemma"
    for bad in (["export", "--template", "no", "--output-file", "o"], ["export", "--template", "csv"], []):
        with pytest.raises(SystemExit):
            parse(bad)


def test_streams(spark, world, tmp_path):
    s, store, _ = world
    kind = "file_path string, content_hash string, content string, error string"
    files = f"file://{tmp_path}/in"
    spark.createDataFrame([("x", "1", "one two", None), ("y", "2", "", None)], kind).write.parquet(files)
    for _ in range(2):
        streaming.prepare_stream(spark.readStream.schema(kind).parquet(files), store, StubGenerator(), s, f"file://{tmp_path}/cp").awaitTermination()
    assert store.read("training_samples").count() == 2 and store.read("file_hashes").count() == 1
    spark.createDataFrame([("x", "q"), ("x", "q"), ("y", "q")], "file_path string, question string").write.parquet(f"file://{tmp_path}/q")
    q = streaming.fresh_questions(spark.readStream.schema("file_path string, question string").parquet(f"file://{tmp_path}/q"))
    q.writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cq").start().awaitTermination()
    assert spark.table("fresh").count() == 2


def test_streams_of_two_checkpoints_share_a_store(spark, world, tmp_path):
    s, store, _ = world
    kind = "file_path string, content_hash string, content string, error string"
    for name in ("one", "two"):
        spark.createDataFrame([(name, "1", f"{name} word", None)], kind).write.parquet(f"file://{tmp_path}/{name}")
        for _ in range(2):  # the second time there is nothing new
            streaming.prepare_stream(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/{name}"), store, StubGenerator(), s, f"file://{tmp_path}/cp-{name}").awaitTermination()
    assert sorted(r.file_path for r in store.read("file_hashes").collect()) == ["one", "two"] and store.read("training_samples").count() == 4
    assert len(store._manifest()[1]["epochs"]) == 2
    # a batch that was committed comes again, as after a crash before the stream noted it
    commits = tmp_path / "cp-two/commits"
    for f in commits.iterdir():
        f.unlink()
    before = store._manifest()
    streaming.prepare_stream(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/two"), store, StubGenerator(), s, f"file://{tmp_path}/cp-two").awaitTermination()
    assert list(commits.iterdir()) and store._manifest() == before


def test_a_stream_of_files_is_prepared(spark, world, tmp_path):
    s, store, repo = world
    run = lambda: streaming.prepare_stream(file_stream(spark, s, settle=0), store, StubGenerator(fail="BAD"), s, f"file://{tmp_path}/cp").awaitTermination()
    run()
    assert {os.path.basename(r.file_path) for r in store.read("file_hashes").collect()} == {"a.py", "c.py"}
    (repo / "new.py").write_text("new")
    (repo / "b.py").write_text("fine now")
    run()
    assert {os.path.basename(r.file_path) for r in store.read("file_hashes").collect()} == {"a.py", "b.py", "c.py", "new.py"}
    assert store.read("failed_files").count() == 0


def test_failures_come_back_after_their_delay(spark, world, tmp_path):
    s, store, repo = world
    pipeline.prepare(spark, s, store, StubGenerator(fail="BAD"))
    assert store.read("failed_files").count() == 1
    out, cp = [], f"file://{tmp_path}/cp"

    def start():
        due = backoff.due(backoff.failure_stream(store), delay=4)
        return due.writeStream.foreachBatch(lambda df, i: out.extend((os.path.basename(r.file_path), r.failures, r.reason, time.time()) for r in df.collect())).option("checkpointLocation", cp).trigger(processingTime="500 milliseconds").start()

    began, q = time.time(), start()
    while not [x for x in out] and time.time() - began < 1.0 or q.lastProgress is None:
        time.sleep(0.2)
    q.stop()  # its timer is in the checkpoint
    q = start()
    while len(out) < 1 and time.time() - began < 60:
        time.sleep(0.2)
    assert [x[:3] for x in out] == [("b.py", 1, NO_QUESTIONS)] and out[0][3] - began >= 3.5
    store.add_failures(spark.createDataFrame([(str(repo / "b.py"), "again")], "file_path string, reason string"))
    added = time.time()
    while len(out) < 2 and time.time() - added < 60:
        time.sleep(0.2)
    q.stop()
    assert out[1][:3] == ("b.py", 2, "again") and out[1][3] - added >= 7.5


def test_the_retry_stream_works_on_due_files(spark, world, tmp_path):
    s, store, repo = world
    pipeline.prepare(spark, s, store, StubGenerator(fail="BAD"))
    q = backoff.retry_stream(store, StubGenerator(), s, f"file://{tmp_path}/cp", delay=0.5, every="500 milliseconds")
    began = time.time()
    while store.read("failed_files").count() and time.time() - began < 90:
        time.sleep(0.5)
    q.stop()
    assert store.read("failed_files").count() == 0 and {os.path.basename(r.file_path) for r in store.read("file_hashes").collect()} == {"a.py", "b.py", "c.py"}
