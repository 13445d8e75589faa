"""The same work as streams: exactly-once micro-batches over changed files, and question dedupe with bounded state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions.text import sha256
from gristmill.operators.incremental import latest, to_process
from gristmill.operators.store import TableStore
from gristmill.plans.generate import Generator
from gristmill.plans.pipeline import process
from gristmill.settings import Settings


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query wrote into its checkpoint when it first began; a restart keeps it, another checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def prepare_stream(files: DataFrame, store: TableStore, g: Generator, settings: Settings, checkpoint: str, **trigger) -> StreamingQuery:
    """Process a stream of (file_path, content_hash, content, error), such as ``file_stream``. The checkpoint is where a stopped run goes on.

    A batch's pairs, hashes and failures are committed together with its number under the checkpoint's own id, so a batch
    that ran before a crash is left alone when it comes again, and one that did not get to its commit left nothing: each
    counts exactly once. ``trigger`` as of ``writeStream.trigger``; without one, what is there now is worked on.
    """
    known: list[str] = []

    def batch(df: DataFrame, epoch: int) -> None:
        if not known:
            known.append(query_id(df.sparkSession, checkpoint))
        with store.unit():
            if store.first_time(known[0], epoch):
                newest = latest(df, ["file_path"], [F.col("content_hash").desc_nulls_last()])
                process(to_process(newest, store.read("file_hashes")), store, g, settings)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh_questions(asked: DataFrame, event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """A stream of (file_path, question, ...) with each question of a file once; with an event time, state is dropped after the delay."""
    q = asked.withColumn("q_hash", sha256(F.col("question")))
    return q.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["file_path", "q_hash"]) if event_time else q.dropDuplicates(["file_path", "q_hash"])


def failures_by_window(failures: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of failures by reason in tumbling windows of failed_at; rows later than the delay are left out."""
    return failures.withWatermark("failed_at", delay).groupBy(F.window("failed_at", width), "reason").agg(F.count("*").alias("n"))
