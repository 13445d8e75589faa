"""The failure queue as a stream: a failed file comes back after a delay that doubles with each failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gristmill.operators.store import TableStore
from gristmill.plans.generate import Generator
from gristmill.plans.pipeline import retry_paths
from gristmill.schemas import struct
from gristmill.settings import Settings

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "file_path string, failures int, reason string"


class Backoff(StatefulProcessor):
    """For each file: how often it failed, why last, the last failure's id, and one timer. The file is emitted when its timer is due.

    A file is forgotten after ``most`` failures; it stays in the store's queue, where ``retry`` finds it.
    """

    def __init__(self, delay_ms: int, most: int):
        self.delay_ms, self.most = delay_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "failures int, reason string, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, reason, last = self.seen.get() if self.seen.exists() else (0, None, -1)
        new = pd.concat(list(rows)).drop_duplicates("failed_id").sort_values("failed_id")
        new = new[new["failed_id"] > last]  # a row may come again when the store rewrites its piece
        if len(new):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            failures = failures + len(new)
            self.seen.update((failures, new["reason"].iloc[-1], int(new["failed_id"].iloc[-1])))
            if failures <= self.most:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms * 2 ** (failures - 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, reason, _ = self.seen.get()
        yield pd.DataFrame({"file_path": [key[0]], "failures": pd.Series([failures], dtype="int32"), "reason": [reason]})

    def close(self) -> None:
        pass


def due(failures: DataFrame, delay: float, most: int = 10) -> DataFrame:
    """A stream of (file_path, failures, reason): files of the stream ``failures(failed_id, file_path, reason)`` when they are to be tried again.

    The n-th failure is due after ``delay * 2 ** (n - 1)`` seconds of processing time. State and timers are in the stream's
    checkpoint (Spark's RocksDB store, set for the session), by file, so a restarted stream forgets none.
    """
    failures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return failures.select("failed_id", "file_path", "reason").groupBy("file_path").transformWithStateInPandas(Backoff(int(delay * 1000), most), DUE, "Append", "ProcessingTime")


def failure_stream(store: TableStore) -> DataFrame:
    """The failures that are appended to a store. Rows of rewritten pieces come again, and rows of units that failed come too:
    ``due`` tells the former by their ids, and only files that the queue still has are tried again."""
    path, fs = store._path(f"{store.root}/failed_files")
    fs.mkdirs(path)
    return store.spark.readStream.schema(struct("failed_files")).option("recursiveFileLookup", "true").parquet(f"{store.root}/failed_files")


def retry_stream(store: TableStore, g: Generator, settings: Settings, checkpoint: str, delay: float = 60.0, most: int = 10, every: str = "10 seconds") -> StreamingQuery:
    """Work again on the store's failed files as they are due; who fails again comes back later."""

    def batch(df: DataFrame, epoch: int) -> None:
        retry_paths(df.select("file_path").distinct(), store, g, settings)

    return due(failure_stream(store), delay, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
