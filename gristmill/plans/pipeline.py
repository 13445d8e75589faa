"""scrape, prepare, retry and export, each a DataFrame plan over whole tables."""

from __future__ import annotations

import logging
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import is_blank
from gristmill.operators.conversations import SAMPLE, collect_conversations, joined_turns
from gristmill.operators.ids import dense_ids, settle
from gristmill.operators.incremental import kept_skipped, new_questions, processed_hashes, removed_files, resume, to_process
from gristmill.operators.store import TableStore
from gristmill.plans.generate import Generator, answer, ask, generator
from gristmill.settings import NO_ANSWER, NO_QUESTIONS, Settings
from gristmill.sources.files import file_list, read_file, repo_table, with_contents
from gristmill.sources.repos import cloned, fetch, git, repo_list, targets
from gristmill.sources.sinks import write_count, write_export

log = logging.getLogger(__name__)


def scrape(spark: SparkSession, settings: Settings, list_path: str = "repos.txt", get=fetch, run=git, pause: float = 1.0) -> int:
    """Clone or update every listed repository, by tasks; returns and writes how many there are."""
    urls = settle(targets(repo_list(spark, list_path), settings.repos_dir, get, pause, settings.lanes_per_host))
    done = settle(cloned(urls, run, pause, settings.lanes_per_host))
    for host, ok, n in done.groupBy("host", "ok").count().collect():  # a few hosts
        (log.info if ok else log.error)("%s: %d %s", host, n, "up to date" if ok else "failed")
    n = repo_table(spark, settings.repos_dir).count()
    write_count(n, settings.data_dir)
    return n


def remembered(store: TableStore, settings: Settings) -> DataFrame | None:
    """The memo's rows that are young enough; None if there is none, or is to be none."""
    if settings.memo_days <= 0 or store.is_empty("memo"):
        return None
    return store.read("memo").where(F.col("made_at") > store.now - F.make_dt_interval(secs=F.lit(settings.memo_days * 86400).cast("decimal(18,6)")))


def process(files: DataFrame, store: TableStore, g: Generator, settings: Settings) -> DataFrame:
    """Ask, answer and store for ``files(file_path, content_hash, content, error)``; returns file_path, success, qa_count.

    A file's pairs are stored only if all its new questions were answered; then its hash is stored and its failures go, all
    in one commit of the store. Blank files and files without new questions succeed with none, and store no hash unless ``mark_seen``. Model calls are
    settled before they are used twice, as they can't be repeated, and remembered with that commit for ``memo_days``.
    """
    files = settle(files.select("file_path", "content_hash", "content", "error"))
    memo = remembered(store, settings)
    unread = files.where("error is not null").select("file_path", F.col("error").alias("reason"))
    full = files.where(F.col("error").isNull() & ~is_blank(F.col("content")))
    asked = settle(ask(full, g, settings, memo))
    silent = asked.where("questions is null").select("file_path", F.coalesce("error", F.lit(NO_QUESTIONS)).alias("reason"))
    each = asked.where("questions is not null").select("file_path", "content", F.posexplode("questions").alias("place", "question"))
    with store.unit():
        fresh = new_questions(each, processed_hashes(store.read("training_samples"), store.read("conversation_turns")))
        answered = settle(answer(fresh, g, settings, memo))
        unanswered = answered.where("answer is null").select("file_path", F.coalesce("error", F.lit(NO_ANSWER)).alias("reason"))
        by_file = settle(answered.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("bad")))
        good = by_file.where("bad = 0")
        failures = settle(unread.unionByName(silent).unionByName(unanswered))
        if not failures.isEmpty():
            store.add_failures(failures)
        stored = store.add_pairs(answered.join(good, "file_path", "left_semi"))
        done = files.join(good, "file_path", "left_semi")
        if settings.mark_seen:
            done = files.join(failures.select("file_path"), "file_path", "left_anti")
        store.save_hashes(done)
        store.remove("failed_files", good)
        if settings.memo_days > 0:
            given = asked.where("fresh and questions is not null").select(F.col("_memo").alias("memo_key"), "questions", F.lit(None).cast("string").alias("answer"))
            said = answered.where("fresh and answer is not null").select(F.col("_memo").alias("memo_key"), F.lit(None).cast("array<string>").alias("questions"), "answer")
            store.upsert("memo", given.unionByName(said).dropDuplicates(["memo_key"]).withColumn("made_at", store.now), ["memo_key"])
    bad = unread.unionByName(silent).select("file_path").distinct().withColumn("success", F.lit(False))
    return files.select("file_path").join(bad, "file_path", "left").join(qa_counts(stored), "file_path", "left").select("file_path", F.coalesce("success", F.lit(True)).alias("success"), F.coalesce("qa_count", F.lit(0)).cast("long").alias("qa_count"))


def qa_counts(pairs: DataFrame) -> DataFrame:
    """Pairs of each file."""
    return pairs.groupBy("file_path").agg(F.count("*").alias("qa_count"))


def without_done(failed: DataFrame, done: DataFrame, key: str = "file_path") -> DataFrame:
    """Failures of what has not succeeded since."""
    return failed.join(done.select(key), key, "left_anti")


def forget_removed(store: TableStore, listing: DataFrame) -> int:
    """Drop samples and hashes of tracked files that are gone; returns how many files."""
    gone = settle(removed_files(store.read("file_hashes"), listing))
    if n := gone.count():
        with store.unit():
            store.delete_samples(gone)
            store.remove("file_hashes", gone)
    return n


def prepare(spark: SparkSession, settings: Settings, store: TableStore | None = None, g: Generator | None = None, read=read_file) -> DataFrame:
    """Bring the store up to date with the file trees; returns one row for each file that was worked on.

    The trees are listed first, by paths alone; then each kept file is opened once.
    """
    store, g = store or TableStore(spark, f"{settings.data_dir}/store"), g or generator(settings)
    listing = settle(file_list(spark, settings))
    for repo, kept, skipped in kept_skipped(listing).orderBy("repo").toLocalIterator():
        log.info("%s: %d files kept, %d skipped", repo, kept, skipped)
    forget_removed(store, listing)
    if not settings.by_repo:
        return process(to_process(with_contents(listing.where("kept"), settings, read), store.read("file_hashes")), store, g, settings)
    return by_repo(spark, settings, store, g, read)


def by_repo(spark: SparkSession, settings: Settings, store: TableStore, g: Generator, read=read_file) -> DataFrame:
    """One commit for each repository, or for each ``batch_files`` files of one, in order, which also keeps the place: a run
    that ends early goes on with the repository it was at, and with the last file of the last batch."""
    repos = repo_table(spark, settings.repos_dir)
    if repos.isEmpty():  # the tree is taken as one
        repos = spark.createDataFrame([(settings.repos_dir.rstrip("/") or "/",)], "repo string")
    state, done = store.load_state(), spark.createDataFrame([], "file_path string, success boolean, qa_count long")
    todo = [r.repo for r in resume(repos, "repo", state["current_repo_name"]).orderBy("repo").collect()]  # a name for each repository
    before = repos.count() - len(todo)
    for i, repo in enumerate(todo):
        again = repo == state["current_repo_name"]
        at, n = (state["current_file_path_in_repo"], state["processed_files_count_in_repo"]) if again else (None, 0)
        store.save_state({"current_repo_name": repo, "processed_repos_count": before + i, "current_file_path_in_repo": at, "processed_files_count_in_repo": n})
        files = file_list(spark, settings).where((F.col("repo") == repo) & F.col("kept"))
        for batch, last, size in in_batches(resume(files, "file_path", at), settings.batch_files):
            with store.unit():
                result = settle(process(to_process(with_contents(batch, settings, read), store.read("file_hashes")), store, g, settings))
                n += size
                if last is not None:
                    store.save_state({"current_file_path_in_repo": last, "processed_files_count_in_repo": n})
            done = done.unionByName(result)
    store.reset_state()
    return done


def in_batches(files: DataFrame, size: int) -> Iterator[tuple[DataFrame, str | None, int]]:
    """(files, last path, how many) of each ``size`` files in order of path; all at once, without a last path, for size 0."""
    if size <= 0:
        yield files, None, 0
        return
    numbered = settle(dense_ids(files, ["file_path"], "_n", 0))
    for k in range(-(-numbered.count() // size)):
        batch = numbered.where(F.col("_n").between(k * size, (k + 1) * size - 1))
        last, n = batch.agg(F.max("file_path"), F.count("*")).first()
        yield batch, last, n


def retry_paths(paths: DataFrame, store: TableStore, g: Generator, settings: Settings, read=read_file) -> DataFrame:
    """Work again on those of ``paths(file_path)`` that have a failure, once each; a path's failures go when it fully succeeds, or
    when the file is gone. Who fails again has a newer row instead."""
    failed = settle(store.read("failed_files").select("file_path", "failed_id").join(paths.select("file_path").distinct(), "file_path", "left_semi"))
    files = settle(failed.select("file_path").distinct())
    names = [r[0] for r in files.limit(NAMED + 1).collect()]
    listing = file_list(store.spark, settings)
    # A few paths are pushed down and looked up; many are found in a listing.
    listing = listing.where(F.col("file_path").isin(names)) if len(names) <= NAMED else listing.join(files, "file_path", "left_semi")
    result = settle(process(with_contents(settle(listing.where("kept")), settings, read), store, g, settings))
    store.delete("failed_files", failed, "failed_id")
    return result


#: Paths that are named in a filter.
NAMED = 1000


def retry(spark: SparkSession, settings: Settings, store: TableStore | None = None, g: Generator | None = None, read=read_file) -> DataFrame:
    """``retry_paths`` for every path with a failure."""
    store, g = store or TableStore(spark, f"{settings.data_dir}/store"), g or generator(settings)
    return retry_paths(store.read("failed_files"), store, g, settings, read)


def conversations(store: TableStore) -> DataFrame:
    return collect_conversations(joined_turns(store.read("training_samples"), store.read("conversation_turns")), keep=SAMPLE).withColumn("is_multiturn", F.coalesce("is_multiturn", F.lit(False)))


def export(spark: SparkSession, settings: Settings, template: str, path: str, store: TableStore | None = None, one_file: bool = False) -> None:
    store = store or TableStore(spark, f"{settings.data_dir}/store")
    write_export(conversations(store), template, path, one_file=one_file)
