import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gristmill.operators.store import Conflict, TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store", F.to_timestamp(F.lit("2024-01-01 00:00:00")), buckets=4)


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "file_path string, place int, question string, answer string")


def paths(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "file_path string")


def test_pairs_become_samples_and_turns(spark, store):
    store.add_pairs(pairs(spark, ("a.py", 0, "q0", "a0"), ("a.py", 1, "q1", "a1"), ("b.py", 0, "q2", "a2")))
    s = store.read("training_samples").orderBy("sample_id").collect()
    assert [(r.sample_id, r.dataset_source, r.model_type_intended, r.is_multiturn) for r in s] == [(1, "repo_file:a.py", "Instruct", False), (2, "repo_file:a.py", "Instruct", False), (3, "repo_file:b.py", "Instruct", False)]
    t = store.read("conversation_turns").orderBy("turn_id").collect()
    assert [(r.turn_id, r.sample_id, r.turn_index, r.role, r.content, r.is_label) for r in t][:2] == [(1, 1, 0, "user", "q0", False), (2, 1, 1, "assistant", "a0", True)]


def test_ids_are_never_used_again(spark, store):
    store.add_pairs(pairs(spark, ("a.py", 0, "q", "a"), ("b.py", 0, "q", "a")))
    assert store.delete_samples(paths(spark, "b.py")) == 1
    store.add_pairs(pairs(spark, ("c.py", 0, "q", "a")))
    assert sorted(r[0] for r in store.read("training_samples").select("sample_id").collect()) == [1, 3]


def test_delete_exact_and_by_prefix(spark, store):
    store.add_pairs(pairs(spark, *[(p, 0, "q", "a") for p in ("a.py", "a.pyc", "A.PY", "b.py")]))
    assert store.delete_samples(paths(spark, "none")) == 0
    assert store.delete_samples(paths(spark, "b.py")) == 1
    assert store.delete_samples(paths(spark, "a.py"), prefix=True) == 3
    assert store.read("conversation_turns").count() == 0


def test_hash_upsert_replaces_the_row(spark, store):
    put = lambda *rows: store.save_hashes(spark.createDataFrame(rows, "file_path string, content_hash string, sample_id long"))
    put(("a", "1", 7), ("b", "1", None))
    store.save_hashes(spark.createDataFrame([("a", "2")], "file_path string, content_hash string"))
    got = {r.file_path: (r.content_hash, r.sample_id) for r in store.read("file_hashes").collect()}
    assert got == {"a": ("2", None), "b": ("1", None)}
    assert {tuple(r) for r in store.file_hashes(paths(spark, "a", "x")).collect()} == {("a", "2"), ("x", None)}
    store.remove("file_hashes", paths(spark, "a"))
    assert store.read("file_hashes").count() == 1


def test_failures(spark, store):
    f = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r")], "file_path string, reason string")
    store.add_failures(f)
    store.remove("failed_files", paths(spark, "a"))
    assert [(r.file_path, r.reason) for r in store.read("failed_files").collect()] == [("b", "r")]


def test_state_round_trip(store):
    assert store.state() == {}
    store.save_state({"n": 42, "s": "5", "none": None, "list": [1, {"a": True}]})
    store.save_state({"n": 43})
    assert store.state() == {"n": 43, "s": "5", "none": None, "list": [1, {"a": True}]}
    store.reset_state()
    assert store.load_state()["processed_repos_count"] == 0 and store.load_state()["n"] == 43


def failures(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r, "r") for r in rows], "file_path string, reason string")


def hashes(spark, *rows):
    return spark.createDataFrame(rows, "file_path string, content_hash string")


def test_a_version_is_written_once(spark, store):
    version, m = store._manifest()
    store.add_failures(failures(spark, "a"))
    assert not store._take(m, version + 1) and store.read("failed_files").count() == 1
    assert not [n for n, _ in store._names("manifests") if n.startswith("tmp")]


def test_appends_of_two_writers_both_land(spark, store):
    other = TableStore(spark, store.root, store.now)
    with store.unit():
        store.add_failures(failures(spark, "a"))
        store.add_pairs(pairs(spark, ("a", 0, "q", "a")))
        other.add_failures(failures(spark, "b", "c"))
        other.add_pairs(pairs(spark, ("b", 0, "q", "a"), ("b", 1, "q", "a")))
        other.save_state({"by": "other"})
        store.save_hashes(hashes(spark, ("a", "1")))
    assert sorted(r.file_path for r in store.read("failed_files").collect()) == ["a", "b", "c"]
    ids = [r.sample_id for r in store.read("training_samples").collect()]
    assert len(ids) == len(set(ids)) == 3 and store.read("conversation_turns").select("turn_id").distinct().count() == 6
    turns = store.read("conversation_turns").groupBy("sample_id").count().collect()
    assert sorted((r.sample_id, r["count"]) for r in turns) == sorted((i, 2) for i in ids)
    assert store.state() == {"by": "other"} and store.read("file_hashes").count() == 1


def test_many_writers_at_once(spark, store):
    stores = [TableStore(spark, store.root, store.now) for _ in range(6)]
    threads = [threading.Thread(target=lambda i=i, s=s: s.add_failures(failures(spark, f"f{i}"))) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.read("failed_files").collect()
    assert sorted(r.file_path for r in rows) == [f"f{i}" for i in range(6)] and sorted(r.failed_id for r in rows) == list(range(1, 7))


def test_changes_of_the_same_rows_conflict(spark, store):
    other = TableStore(spark, store.root, store.now)
    store.save_hashes(hashes(spark, ("a", "1")))
    with pytest.raises(Conflict):
        with store.unit():
            store.save_hashes(hashes(spark, ("a", "mine")))
            other.save_hashes(hashes(spark, ("a", "other")))
    with pytest.raises(Conflict):
        with store.unit():
            store.save_hashes(hashes(spark, ("new", "mine")))
            other.save_hashes(hashes(spark, ("new", "other")))
    with pytest.raises(Conflict):
        with store.unit():
            assert store.first_time("s", 0)
            with other.unit():
                assert other.first_time("s", 0)
    assert {tuple(r)[:2] for r in store.read("file_hashes").collect()} == {("a", "other"), ("new", "other")}


def written(store, table):
    path = f"{store.root.removeprefix('file://')}/{table}"
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_what_is_written_follows_the_change(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/large")
    many = spark.range(20_000).select(F.concat(F.lit("dir/file"), "id").alias("file_path"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    store.save_hashes(many)
    store.add_failures(many.select("file_path", F.lit("r").alias("reason")))
    for table, change in (
        ("file_hashes", lambda: store.save_hashes(hashes(spark, ("dir/file7", "new"), ("dir/other", "new")))),
        ("file_hashes", lambda: store.remove("file_hashes", paths(spark, "dir/file8"))),
        ("failed_files", lambda: store.remove("failed_files", paths(spark, "dir/file8", "none"))),
        ("failed_files", lambda: store.add_failures(failures(spark, "dir/file1"))),
    ):
        before = written(store, table)
        change()
        fresh = {f: n for f, n in written(store, table).items() if f not in before}
        assert 0 < sum(fresh.values()) < 0.06 * sum(before.values())
    before = written(store, "failed_files") | written(store, "file_hashes"), store._version()
    store.remove("failed_files", paths(spark, "none"))  # nothing goes, nothing is written
    store.remove("file_hashes", paths(spark, "none"))
    assert (written(store, "failed_files") | written(store, "file_hashes"), store._version()) == before
    assert store.read("file_hashes").count() == 20_000 and store.read("failed_files").count() == 20_000
    got = {r.file_path: r.content_hash for r in store.read("file_hashes").where("file_path in ('dir/file7', 'dir/file8', 'dir/other')").collect()}
    assert got == {"dir/file7": "new", "dir/other": "new"}


def test_a_delete_leaves_other_appends_alone(spark, store):
    for f in ("a", "b", "c"):
        store.add_pairs(pairs(spark, (f, 0, "q", "a")))
    before = store._manifest()[1]["tables"]["training_samples"]["pieces"]
    assert store.delete_samples(paths(spark, "b")) == 1
    after = store._manifest()[1]["tables"]["training_samples"]["pieces"]
    assert before[0] in after and before[2] in after and before[1] not in after
    assert sorted(r.dataset_source for r in store.read("training_samples").collect()) == ["repo_file:a", "repo_file:c"]


def test_vacuum(spark, store):
    for i in range(4):
        store.save_hashes(hashes(spark, ("a", str(i)), (f"b{i}", "1")))
        store.add_failures(failures(spark, "x"))
    store._write("failed_files", failures(spark, "lost").select(F.lit(9).alias("failed_id"), "file_path", "reason", store.now.alias("failed_at")))  # of a writer that was lost
    assert store.vacuum() == 0  # all is young
    was = {t: sorted(store.read(t).collect()) for t in ("file_hashes", "failed_files")}
    time.sleep(1.1)
    assert store.vacuum(older_than=1) > 3
    assert {t: sorted(store.read(t).collect()) for t in was} == was and len([n for n, _ in store._names("manifests") if n.isdigit()]) == 1
    assert len(written(store, "file_hashes")) == len(store._manifest()[1]["tables"]["file_hashes"]["pieces"])
    assert store.vacuum(older_than=0) == 0
    store.save_hashes(hashes(spark, ("a", "9")))
    assert store.read("file_hashes").where("content_hash = '9'").count() == 1


def test_a_unit_appears_whole_or_not_at_all(spark, store):
    f = spark.createDataFrame([("a", "r")], "file_path string, reason string")
    other = TableStore(spark, store.root)
    with pytest.raises(ValueError):
        with store.unit():
            store.add_failures(f)
            store.add_pairs(pairs(spark, ("a.py", 0, "q", "a")))
            raise ValueError
    assert store.read("failed_files").count() == store.read("training_samples").count() == 0
    with store.unit():
        store.add_failures(f)
        store.add_pairs(pairs(spark, ("a.py", 0, "q", "a")))
        store.remove("failed_files", paths(spark, "a"))
        assert store.read("conversation_turns").count() == 2 and other.read("conversation_turns").count() == 0
    assert other.read("conversation_turns").count() == 2 and other.read("failed_files").count() == 0


def test_epochs_count_once(store):
    for want in (True, False):
        with store.unit():
            assert store.first_time("s", 0) == want
    with pytest.raises(ValueError):
        with store.unit():
            assert store.first_time("s", 1)
            raise ValueError
    with store.unit():
        assert store.first_time("s", 1) and store.first_time("other", 0)
