"""What changed, what is answered, what is left: joins on whole tables instead of look-ups by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import sha256, source_path


def file_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """file_path, content_hash and status: new, updated, unchanged or removed (full outer join on the path)."""
    c, s = current.select("file_path", "content_hash"), stored.select("file_path", F.col("content_hash").alias("stored_hash"))
    status = F.when(F.col("content_hash").isNull(), "removed").when(F.col("stored_hash").isNull(), "new").when(F.col("stored_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return c.join(s, "file_path", "full").select("file_path", "content_hash", status.alias("status"))


def to_process(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``current`` whose stored hash is missing or another one; all its columns stay."""
    s = stored.select("file_path", F.col("content_hash").alias("_stored"))
    return current.join(s, "file_path", "left").where(~F.col("_stored").eqNullSafe(F.col("content_hash"))).drop("_stored")


def removed_files(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracked paths that are no longer there; ``listing`` is of all files, kept or not."""
    return stored.select("file_path").join(listing.select("file_path"), "file_path", "left_anti")


def processed_hashes(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """file_path and q_hash of each question that has an answer."""
    asked = turns.where("role = 'user'").join(turns.where("role = 'assistant'").select("sample_id"), "sample_id", "left_semi")
    return asked.join(samples.select("sample_id", source_path(F.col("dataset_source")).alias("file_path")), "sample_id").select("file_path", sha256(F.col("content")).alias("q_hash")).distinct()


def new_questions(asked: DataFrame, processed: DataFrame) -> DataFrame:
    """``asked(file_path, question, ...)`` without answered ones; duplicates within ``asked`` stay."""
    return asked.withColumn("q_hash", sha256(F.col("question"))).join(processed, ["file_path", "q_hash"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key (whole rows, as INSERT OR REPLACE)."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def resume(rows: DataFrame, key: str, saved: str | None) -> DataFrame:
    """Rows from the saved key on, that one included; all of them if it isn't there."""
    if saved is None or rows.where(F.col(key) == saved).limit(1).count() == 0:
        return rows
    return rows.where(F.col(key) >= saved)


def kept_skipped(listing: DataFrame) -> DataFrame:
    return listing.groupBy("repo").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def distinct_contents(files: DataFrame) -> DataFrame:
    """Different contents and files of each repository."""
    return files.groupBy("repo").agg(F.count_distinct("content").alias("distinct_texts"), F.count("*").alias("n"))


def newest(rows: DataFrame, order: list, keep: int) -> DataFrame:
    """The first ``keep`` rows in ``order``, all others to be removed."""
    return rows.orderBy(*order).limit(keep)


def with_previous(turns: DataFrame, of: str, order: str, value: str) -> DataFrame:
    """Each turn with the value of the one before it in its conversation."""
    return turns.withColumn("before", F.lag(value).over(W.partitionBy(of).orderBy(order)))
