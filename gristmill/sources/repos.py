"""Repository lists, listing pages, and clones."""

from __future__ import annotations

import logging
import os
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.html import repo_links
from gristmill.functions.text import strip
from gristmill.functions.urls import clone_path, netloc, url_kind

log = logging.getLogger(__name__)


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """url: lines of the list without blanks and comments; nothing if there is no list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        log.error("%s: no such list", path)
        return spark.createDataFrame([], "url string")
    return lines.select(strip(F.col("value")).alias("url")).where("url <> '' and not startswith(url, '#')")


def fetch(url: str, timeout: float = 30.0) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; gristmill)"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def in_lanes(rows: DataFrame, host: Column, by: Column, lanes: int) -> DataFrame:
    """``rows`` dealt to ``lanes`` lanes for each host, in a column ``host`` beside ``lane``; a lane is in one task, in order."""
    lane = F.pmod(F.xxhash64(by), F.lit(max(1, lanes))).cast("int")
    return rows.withColumn("host", host).withColumn("lane", lane).repartition("host", "lane").sortWithinPartitions("host", "lane", *rows.columns)


def host_of(url: Column) -> Column:
    return F.coalesce(F.nullif(netloc(url), F.lit("")), F.lit("-"))


class Pace:
    """Sleeps so that a lane's requests are ``pause * lanes`` seconds apart: all lanes of a host together keep the pause."""

    def __init__(self, pause: float, lanes: int):
        self.apart, self.last = pause * max(1, lanes), {}

    def wait(self, lane: tuple) -> None:
        left = self.last.get(lane, 0.0) + self.apart - time.monotonic()
        if lane in self.last and left > 0:
            time.sleep(left)
        self.last[lane] = time.monotonic()


def org_repos(pages: DataFrame, get: Callable[[str], str] = fetch, pause: float = 1.0, lanes: int = 4) -> DataFrame:
    """url: links of each listing page in ``pages(url)``, fetched by tasks; a page that can't be had gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(pause, lanes)
        for b in batches:
            for url, host, lane in zip(b["url"], b["host"], b["lane"]):
                pace.wait((host, lane))
                try:
                    yield pd.DataFrame({"url": repo_links(get(url))}, dtype=object)
                except Exception as e:  # one page must not end the rest
                    log.error("%s: %s", url, e)

    return in_lanes(pages.select("url").distinct(), host_of(F.col("url")), F.col("url"), lanes).mapInPandas(run, "url string")


def targets(urls: DataFrame, root: str = "repos", get: Callable[[str], str] = fetch, pause: float = 1.0, lanes: int = 4) -> DataFrame:
    """url and path of each repository to have, listing pages expanded, each once."""
    kind = url_kind(F.col("url"))
    direct, pages = urls.where(kind != "org_page"), urls.where(kind == "org_page")
    return direct.select("url").union(org_repos(pages, get, pause, lanes)).distinct().select("url", clone_path(F.col("url"), root).alias("path"))


def git(args: list[str], cwd: str | None = None) -> tuple[bool, str]:
    try:
        r = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True)
    except OSError as e:
        return False, str(e)
    return r.returncode == 0, r.stdout.strip() if r.returncode == 0 else r.stderr.strip()


def clone_or_update(pairs: Iterable[tuple[str, str]], run: Callable[..., tuple[bool, str]] = git) -> list[tuple[str, bool]]:
    """Bring each (url, path) up to date, one after another: reset then pull what is there, clone what isn't."""
    done = []
    for url, path in pairs:
        if os.path.isdir(path):
            ok, said = run(["reset", "--hard", "HEAD"], cwd=path)
            if ok:
                ok, said = run(["pull"], cwd=path)
        else:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            ok, said = run(["clone", url, path])
        if not ok:
            log.error("%s: %s", url, said)
        done.append((path, ok))
    return done


def cloned(pairs: DataFrame, run: Callable[..., tuple[bool, str]] = git, pause: float = 1.0, lanes: int = 4) -> DataFrame:
    """host, path and ok for ``pairs(url, path)``, brought up to date by tasks. Paths are on a disk that executors and driver share.

    Pairs with one path are in one lane, so they never work on it at the same time. A task that is run again updates what
    it has cloned before.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(pause, lanes)
        for b in batches:
            for url, path, host, lane in zip(b["url"], b["path"], b["host"], b["lane"]):
                pace.wait((host, lane))
                yield pd.DataFrame({"host": [host], "path": [path], "ok": [clone_or_update([(url, path)], run)[0][1]]})

    # Addresses of one path may differ in their host's spelling only; the path decides the lane, and so must its host.
    one = pairs.groupBy("path").agg(F.min(host_of(F.col("url"))).alias("_host"))
    each = pairs.select("url", "path").join(one, "path")
    return in_lanes(each, F.col("_host"), F.col("path"), lanes).mapInPandas(work, "host string, path string, ok boolean")
