"""Sinks: exports as text that matches byte for byte, in parts or as one file, the repository count, and log files."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gristmill.operators.conversations import rendered
from gristmill.operators.ids import settle
from gristmill.operators.incremental import newest


def write_export(conversations: DataFrame, template: str, path: str, key: str = "sample_id", one_file: bool = False, exact: bool = True) -> None:
    """Write rendered conversations in key order as text: a folder of parts, or with ``one_file`` the file ``path`` itself.

    CSV has a header and CRLF line ends; every other format ends records with a line feed. Parts sort by name, and their
    concatenation is the export; the header is in the first part.
    """
    rows = rendered(conversations, template, key, exact)
    if template == "csv":
        head = rows.sparkSession.range(1).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("user_content,assistant_content").alias("line"))
        rows = head.unionByName(rows)
    rows, end = rows.orderBy(F.col(key).asc_nulls_first()).select("line"), "\r\n" if template == "csv" else "\n"
    if one_file:
        write_lines(rows, path, end)
    else:
        rows.write.option("lineSep", end).text(path)


def write_lines(rows: DataFrame, path: str, end: str = "\n") -> None:
    """The strings of ``rows(line)`` in order, each with ``end`` behind it, as one file on a disk that all executors share.

    The rows are settled, so that their partitions stay as they are; the bytes of each give the place at which its task
    writes. No task and no driver has more than a partition, or a number for each. The file takes its name when all is there.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("one file can be written to a mounted disk only; write parts to other stores")
    spark, rows = rows.sparkSession, settle(rows.select("line"))
    sizes = dict(rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(F.coalesce("line", F.lit(""))) + len(end.encode()))).collect())
    places, at = {}, 0
    for part in sorted(sizes):
        places[part] = at
        at += sizes[part]
    target = path.removeprefix("file://")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    spark.dataSource.register(LineFile)
    options = {"target": target, "unfinished": f"{target}.{uuid.uuid4().hex}", "end": end, "places": json.dumps(places), "bytes": str(at)}
    rows.write.format("gristmill_lines").options(**options).mode("append").save()


class LineFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gristmill_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class LineWriter(DataSourceArrowWriter):
    """Each task writes its lines from its place on, a task that is run again the same ones to the same place."""

    def __init__(self, options: dict):
        self.target, self.unfinished, self.end = options["target"], options["unfinished"], options["end"].encode()
        self.places, self.bytes = {int(k): v for k, v in json.loads(options["places"]).items()}, int(options["bytes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, n = TaskContext.get().partitionId(), 0
        with open(os.open(self.unfinished, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            f.seek(self.places.get(part, 0))
            for b in iterator:
                for line in b.column(0):
                    n += f.write((line.as_buffer().to_pybytes() if line.is_valid else b"") + self.end)
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        if (n := sum(m.bytes for m in messages if m)) != self.bytes:
            self.abort(messages)
            raise RuntimeError(f"{n} bytes were written, {self.bytes} were to be")
        open(self.unfinished, "ab").close()  # also without any line
        os.replace(self.unfinished, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.unfinished):
            os.remove(self.unfinished)


def write_count(n: int, data_dir: str, name: str = "repo_count.txt") -> str:
    os.makedirs(data_dir, exist_ok=True)
    path = os.path.join(data_dir, name)
    with open(path, "w") as f:
        f.write(str(n))
    return path


def new_log(folder: str, prefix: str = "pipeline_log", now: float | None = None) -> str:
    """The path of a new log."""
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{prefix}_{time.strftime('%Y%m%d_%H%M%S', time.localtime(now))}.log")


def prune_logs(spark: SparkSession, folder: str, keep: int = 5, prefix: str = "pipeline_log") -> list[str]:
    """Remove all logs but the newest; returns what was removed."""
    found = [(p, os.stat(p).st_mtime_ns) for p in (os.path.join(folder, n) for n in os.listdir(folder) if n.startswith(prefix))]
    logs = spark.createDataFrame(found, "path string, changed long")
    old = sorted(r.path for r in logs.join(newest(logs, [F.col("changed").desc(), F.col("path").desc()], keep), "path", "left_anti").collect())
    for path in old:
        os.remove(path)
    return old


class BesideProgress(logging.StreamHandler):
    """Writes above a progress bar that draws on the same line: clears the line first."""

    def emit(self, record: logging.LogRecord) -> None:
        if getattr(self.stream, "isatty", lambda: False)():
            self.stream.write("\r\x1b[K")
        super().emit(record)


def route_logs(path: str, console_level: int = logging.INFO) -> None:
    """Everything from INFO on into the file; the console from its own level on."""
    root = logging.getLogger()
    for h in list(root.handlers):
        root.removeHandler(h)
    root.setLevel(logging.INFO)
    for h, level in ((logging.FileHandler(path), logging.INFO), (BesideProgress(), console_level)):
        h.setLevel(level)
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        root.addHandler(h)
