"""Versioned Parquet tables.

A version of the store is one manifest for all tables: each table's pieces (folders of Parquet files) and the highest id ever
given out. Tables with a key that rows are replaced by are split into buckets by a hash of it, a piece for each bucket of a
write; an upsert or delete reads and rewrites only the pieces that hold its rows, so what is written follows the change and
not the table. Tables that only grow have a piece for each append, and a delete rewrites only those with rows that go.

What is done within ``unit()`` becomes visible to others by one manifest, so a file's samples, turns, hash and failures
appear together or not at all; a unit sees its own changes, and belongs to its thread. A manifest is written under a temporary name and then takes its
number, which only one writer can; readers keep the version they began with. A unit that comes second is applied anew to the
newer version: appends always can be (their ids were reserved before), replaced pieces as long as the other one left these
pieces, and their buckets, alone. Else, or if a stream's epoch was committed meanwhile, the unit fails and leaves nothing.

``vacuum`` drops versions and unused pieces beyond an age. All files go through Spark's file systems; taking a number is a
rename that fails if the name is taken, or, on a local or mounted disk, a link.
"""

from __future__ import annotations

import copy
import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import source_like, source_tag
from gristmill.operators.conversations import turns_of_pairs
from gristmill.operators.ids import dense_ids, settle
from gristmill.operators.incremental import latest, upsert
from gristmill.schemas import KEYS, TABLES, struct
from gristmill.settings import MODEL_TYPE

#: What the state holds before anything is saved.
FRESH_STATE = {"current_repo_name": None, "processed_repos_count": 0, "current_file_path_in_repo": None, "processed_files_count_in_repo": 0}
#: Buckets of a table with a key, fixed when a store is made.
BUCKETS = 64
#: How often a unit is applied anew after another writer came first.
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Another writer changed what this unit has changed too."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str, now=None, buckets: int = BUCKETS):
        """``now``: a column for times of writing (tests give a constant). ``buckets`` counts for a new store only."""
        self.spark, self.root, self.now = spark, root.rstrip("/"), now if now is not None else F.current_timestamp()
        self._own = threading.local()  # a unit belongs to the thread that began it
        if self._version() < 0 and not self._take({"tables": {t: {"pieces": [], "top": 0} for t in TABLES}, "epochs": {}, "buckets": buckets}, 0):
            self._version()  # another one made it

    @property
    def _open(self) -> dict | None:
        """This thread's unit: the manifest to be."""
        return getattr(self._own, "open", None)

    @_open.setter
    def _open(self, manifest: dict | None) -> None:
        self._own.open, self._own.done = manifest, []

    # files -----------------------------------------------------------------------------------------------------------
    def _path(self, p: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of modification in ms) of what lies in a folder of the store."""
        path, fs = self._path(f"{self.root}/{folder}")
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(path)] if fs.exists(path) else []

    def _version(self) -> int:
        return max([int(n) for n, _ in self._names("manifests") if n.isdigit()], default=-1)

    def _load(self, version: int) -> dict:
        path, fs = self._path(f"{self.root}/manifests/{version}")
        stream = fs.open(path)  # small, and asked for often: no job for it
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict]:
        v = self._version()
        return v, self._load(v)

    def _take(self, manifest: dict, version: int) -> bool:
        """Write a manifest as this version; False if there is one."""
        tmp, fs = self._path(f"{self.root}/manifests/tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to, _ = self._path(f"{self.root}/manifests/{version}")
        if fs.getUri().getScheme() == "file":  # there a rename would replace
            try:
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        if not fs.exists(to) and fs.rename(tmp, to):
            return True
        fs.delete(tmp, False)
        return False

    @contextmanager
    def unit(self) -> Iterator[dict]:
        """One commit for all that is done within; a unit within a unit belongs to the outer one. Gives the manifest to be."""
        if self._open is not None:
            yield self._open
            return
        seen, self._open = self._manifest()
        try:
            yield self._open
            if self._own.done:
                self._commit(seen, self._own.done)
        finally:
            self._open = None

    def _commit(self, seen: int, done: list[dict]) -> None:
        """Make the changes ``done``, worked out on version ``seen``, the next version."""
        base = self._load(seen)
        for i in range(ATTEMPTS):
            version, manifest = self._manifest() if i else (seen, copy.deepcopy(base))
            for change in done:
                _apply(manifest, change, base)
            if self._take(manifest, version + 1):
                return
            time.sleep(0.01 * (i + os.getpid() % 7))
        raise Conflict(f"{ATTEMPTS} other writers came first")

    def _change(self, change: dict) -> None:
        _apply(self._open, change)
        self._own.done.append(change)

    # pieces ----------------------------------------------------------------------------------------------------------
    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(KEYS[table]), F.lit((self._open or self._manifest()[1])["buckets"])).cast("int")

    def _write(self, table: str, df: DataFrame) -> list[str]:
        """Write rows and return the pieces; no rows, no piece."""
        folder, cols = uuid.uuid4().hex, struct(table)
        out = df.select([F.col(f.name).cast(f.dataType) for f in cols])
        if table not in KEYS:
            out.write.parquet(f"{self.root}/{table}/{folder}")
            return [folder]
        out.withColumn("bucket", self._bucket(table)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{table}/{folder}")
        return sorted(f"{folder}/{n}" for n, _ in self._names(f"{table}/{folder}") if n.startswith("bucket="))

    def _rows(self, table: str, pieces: list[str]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], struct(table))
        return self.spark.read.schema(struct(table)).parquet(*[f"{self.root}/{table}/{p}" for p in pieces])

    def _pieces_with(self, table: str, keys: DataFrame, key: str) -> list[str]:
        """The pieces that hold a row with one of the (settled, distinct) keys."""
        pieces = (self._open or self._manifest()[1])["tables"][table]["pieces"]
        if KEYS.get(table) == key:
            touched = {r[0] for r in keys.select(self._bucket(table)).distinct().collect()}  # at most as many as buckets
            pieces = [p for p in pieces if _bucket_of(p) in touched]
        hit = self._rows(table, pieces).select(key, F.input_file_name().alias("file")).join(keys.select(key), key, "left_semi").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()
        found = {r[0] for r in hit.collect()}  # at most as many as pieces
        return [p for p in pieces if any(f.endswith(f"/{table}/{p}") for f in found)]

    # tables ----------------------------------------------------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        return self._rows(table, (self._open or self._manifest()[1])["tables"][table]["pieces"])

    def _reserve(self, table: str, n: int) -> int:
        """The first of n ids that nobody else gets. They are committed at once, so that a unit that must be applied anew keeps them."""
        base = None
        for _ in range(ATTEMPTS):
            version, manifest = self._manifest()
            base = manifest["tables"][table]["top"]
            manifest["tables"][table]["top"] = base + n
            if self._take(manifest, version + 1):
                if self._open is not None:
                    self._open["tables"][table]["top"] = base + n
                return base + 1
        raise Conflict(f"{ATTEMPTS} other writers came first")

    def is_empty(self, table: str) -> bool:
        """Whether nothing was ever stored, or all of it was deleted."""
        return not (self._open or self._manifest()[1])["tables"][table]["pieces"]

    def append(self, table: str, df: DataFrame, id_column: str | None = None, order: list[str] | None = None) -> DataFrame:
        """Append and return the rows as written; ``id_column`` gets ids above any ever given out (also to deleted rows)."""
        with self.unit():
            if id_column:
                df = dense_ids(df, order or df.columns, id_column, 0)  # the rows are settled there
                n = df.count()
                df = df.withColumn(id_column, F.col(id_column) + (self._reserve(table, n) if n else 0))
            pieces = self._write(table, df)
            self._change({"table": table, "drop": [], "add": pieces})
        return self._rows(table, pieces) if not id_column else df

    def replace(self, table: str, df: DataFrame) -> None:
        """Other rows for a whole table."""
        with self.unit() as u:
            self._change({"table": table, "drop": list(u["tables"][table]["pieces"]), "add": self._write(table, df), "alone": "table"})

    def upsert(self, table: str, new: DataFrame, key: list[str]) -> None:
        """Rows of ``new`` in place of those with the same key; reads and writes the buckets that they are in."""
        with self.unit() as u:
            new = settle(new.select(*struct(table).names))
            touched = {r[0] for r in new.select(self._bucket(table)).distinct().collect()}
            old = [p for p in u["tables"][table]["pieces"] if _bucket_of(p) in touched]
            if touched:
                self._change({"table": table, "drop": old, "add": self._write(table, upsert(self._rows(table, old), new, key)), "alone": sorted(touched)})

    def delete(self, table: str, keys: DataFrame, key: str) -> None:
        """Delete the rows with one of these keys; rewrites only pieces that hold some, and nothing if there are none."""
        with self.unit() as u:
            if not u["tables"][table]["pieces"]:
                return
            keys = settle(keys.select(key).distinct())
            if old := self._pieces_with(table, keys, key):
                self._change({"table": table, "drop": old, "add": self._write(table, self._rows(table, old).join(keys, key, "left_anti"))})

    def first_time(self, stream: str, epoch: int) -> bool:
        """Whether this epoch of a stream was not committed yet; if so, it is, with the unit that this is asked in.

        ``stream`` must name the stream's checkpoint: its epochs count from 0 again with another one.
        """
        if self._open is None:
            raise RuntimeError("epochs are asked for within a unit")
        if self._open["epochs"].get(stream, -1) >= epoch:
            return False
        self._change({"stream": stream, "epoch": epoch})
        return True

    def vacuum(self, older_than: float = 7 * 86400.0) -> int:
        """Drop versions but the last, and pieces that no version left names, if they are older than so many seconds; returns how many pieces.

        Readers and writers must be done with a version within that time.
        """
        before = (time.time() - older_than) * 1000
        names = sorted((int(n), t) for n, t in self._names("manifests") if n.isdigit())
        for v, t in names[:-1]:
            if t < before:
                path, fs = self._path(f"{self.root}/manifests/{v}")
                fs.delete(path, False)
        kept = [self._load(v) for v, t in names if t >= before or v == names[-1][0]]
        dropped = 0
        for table in TABLES:
            used = {p for m in kept for p in m["tables"][table]["pieces"]}
            for folder, t in self._names(table):
                inner = [f"{folder}/{n}" for n, _ in self._names(f"{table}/{folder}") if n.startswith("bucket=")]
                if t >= before:
                    continue
                unused = [p for p in inner if p not in used] if any(p in used for p in inner) else [folder] if folder not in used else []
                for p in unused:
                    path, fs = self._path(f"{self.root}/{table}/{p}")
                    fs.delete(path, True)
                dropped += len(unused)
        return dropped

    # what the pipeline stores ----------------------------------------------------------------------------------------
    def add_pairs(self, pairs: DataFrame) -> DataFrame:
        """Store (file_path, place, question, answer) as samples with two turns each; returns them with sample_id."""
        rows = pairs.select("file_path", "place", "question", "answer", source_tag(F.col("file_path")).alias("dataset_source"), self.now.alias("creation_date"), F.lit(MODEL_TYPE).alias("model_type_intended"), F.lit(None).cast("double").alias("sample_quality_score"), F.lit(False).alias("is_multiturn"))
        with self.unit():
            with_ids = self.append("training_samples", rows, "sample_id", ["file_path", "place"])
            self.append("conversation_turns", turns_of_pairs(with_ids), "turn_id", ["sample_id", "turn_index"])
        return with_ids

    def save_hashes(self, hashes: DataFrame) -> None:
        """(file_path, content_hash and, if there, sample_id): the last row for each path replaces the stored one."""
        sample = F.col("sample_id") if "sample_id" in hashes.columns else F.lit(None)
        new = latest(hashes.select("file_path", "content_hash", self.now.alias("last_processed"), sample.cast("long").alias("sample_id")), ["file_path"], [F.col("content_hash").desc()])
        self.upsert("file_hashes", new, ["file_path"])

    def file_hashes(self, paths: DataFrame) -> DataFrame:
        """Look-up of many paths: file_path and content_hash, null if not stored."""
        return looked_up(paths, self.read("file_hashes"))

    def add_failures(self, failures: DataFrame) -> None:
        self.append("failed_files", failures.select("file_path", "reason", self.now.alias("failed_at")), "failed_id", ["file_path", "reason"])

    def remove(self, table: str, paths: DataFrame) -> None:
        """Delete a table's rows of these paths."""
        self.delete(table, paths, "file_path")

    def delete_samples(self, paths: DataFrame, prefix: bool = False) -> int:
        """Delete the samples of these files, turns first; returns how many. ``prefix``: also of longer paths that begin so."""
        with self.unit():
            samples, p = self.read("training_samples"), paths.select("file_path").distinct()
            if prefix:
                ids = samples.join(F.broadcast(settle(p)) if p.count() <= 10_000 else p, source_like(F.col("dataset_source"), F.col("file_path"))).select("sample_id").distinct()
            else:
                ids = samples_of(samples, p).select("sample_id")
            ids = settle(ids)
            if n := ids.count():
                self.delete("conversation_turns", ids, "sample_id")
                self.delete("training_samples", ids, "sample_id")
        return n

    # state -----------------------------------------------------------------------------------------------------------
    def save_state(self, state: dict) -> None:
        """Other keys stay. Values are JSON, so that they come back as they were."""
        if state:
            self.upsert("pipeline_state", self.spark.createDataFrame([(k, json.dumps(v)) for k, v in state.items()], struct("pipeline_state")), ["key"])

    def state(self) -> dict:
        def value(x: str):
            try:
                return json.loads(x)
            except ValueError:
                return x

        return {k: value(v) for k, v in self.read("pipeline_state").collect()}  # a few keys

    def reset_state(self) -> None:
        self.save_state(FRESH_STATE)

    def load_state(self) -> dict:
        return FRESH_STATE | self.state()


def _bucket_of(piece: str) -> int:
    return int(piece.rpartition("bucket=")[2]) if "bucket=" in piece else -1


def _apply(manifest: dict, change: dict, base: dict | None = None) -> None:
    """Make a change to a manifest. With ``base``, the one that it was worked out on, only if nobody has changed the same since."""
    if "stream" in change:
        if base is not None and manifest["epochs"].get(change["stream"], -1) >= change["epoch"]:
            raise Conflict(f"epoch {change['epoch']} of {change['stream']} was committed by another")
        manifest["epochs"][change["stream"]] = change["epoch"]
        return
    t = manifest["tables"][change["table"]]
    if base is not None and (alone := change.get("alone")):  # what must not have grown either
        within = lambda pieces: {p for p in pieces if alone == "table" or _bucket_of(p) in alone} - set(change["add"])
        mine = within(base["tables"][change["table"]]["pieces"])
        if not within(t["pieces"]) <= mine | set(change["drop"]):
            raise Conflict(f"{change['table']}: rows with the same keys may have been written by another")
    if not set(change["drop"]) <= set(t["pieces"]):
        raise Conflict(f"{change['table']}: the same rows were changed by another")
    t["pieces"] = [p for p in t["pieces"] if p not in set(change["drop"])] + change["add"]


def samples_of(samples: DataFrame, paths: DataFrame) -> DataFrame:
    """The samples of these files."""
    return samples.join(paths.select(source_tag(F.col("file_path")).alias("dataset_source")), "dataset_source", "left_semi")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without those of the given samples."""
    return rows.join(ids.select("sample_id"), "sample_id", "left_anti")


def looked_up(paths: DataFrame, hashes: DataFrame) -> DataFrame:
    """file_path and stored content_hash of each path, null where none is stored."""
    return paths.select("file_path").join(hashes.select("file_path", "content_hash"), "file_path", "left")
