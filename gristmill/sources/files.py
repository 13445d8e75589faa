"""File trees as a Spark data source.

``spark.read.format("gristmill_files").option("root", ...)`` reads each repository folder (a folder that holds a ``.git``
folder; without any, the root itself) on the executors. A repository is split by folders, two levels deep, so that a large
one is many partitions. Spark's own file sources leave out empty files and names that begin with an underscore, which
source code has many of. Hidden folders are left out; hidden files, what isn't a regular file, files over ``maxSize`` bytes
or with an excluded suffix (case counts) are listed with kept = false and not read. A file that isn't read within
``timeout`` seconds gets that as its error.

Filters on repo, file_path, size and kept are pushed down: other repositories aren't walked, paths that are named are looked
up without a walk, and no file is opened that a filter leaves out. ``content`` = false lists paths and opens nothing;
``with_contents`` reads what is left of such a listing after joins, which can't be pushed down.

``spark.readStream.format("gristmill_files")`` gives the kept files that changed since the stream's last batch. An offset is
a time: a file belongs to the batch whose interval holds the later one of its times of modification and of change, so that
files that are moved in with an old date count too. Times newer than ``settle`` seconds wait for the next batch, as files may
still be written then. Folders are listed by tasks, at each trigger; the driver plans folders only.
"""

from __future__ import annotations

import contextlib
import hashlib
import operator
import os
import shutil
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from gristmill.functions.text import base_name, cache_dir_model, human_size
from gristmill.schemas import CORPUS, FILE_CONTENTS, FILE_LIST
from gristmill.settings import EXCLUDED_SUFFIXES, MAX_FILE_SIZE, READ_TIMEOUT, Settings

_CHUNK = 1 << 16
#: Partitions of one read; beyond it, folders share them.
MOST_PARTITIONS = 20_000


def find_repos(root: str) -> list[str]:
    """Folders with a ``.git`` folder, sorted; what lies within one isn't searched."""
    found = []
    for folder, names, _ in os.walk(root):
        if ".git" in names:
            found.append(folder)
            names.clear()
    return sorted(found)


def wanted(name: Column, size: Column, max_size: int = MAX_FILE_SIZE, suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES) -> Column:
    """``is_wanted`` as a column."""
    odd = F.lit(False)
    for x in suffixes:
        odd = odd | name.endswith(x)
    return (size <= max_size) & ~odd & ~base_name(name).startswith(".")


def is_wanted(name: str, size: int, max_size: int = MAX_FILE_SIZE, suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES) -> bool:
    return size <= max_size and not name.endswith(tuple(suffixes)) and not os.path.basename(name).startswith(".")


def list_files(root: str, max_size: int = MAX_FILE_SIZE, suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES, deep: bool = True) -> Iterator[tuple[str, int, bool]]:
    """(path, size, kept) of the files under a folder, or right in it; hidden folders are left out."""
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if deep and not n.startswith("."))
        for name in sorted(files):
            path = os.path.join(folder, name)
            regular = os.path.isfile(path)
            size = os.path.getsize(path) if regular else 0
            yield path, size, regular and is_wanted(path, size, max_size, suffixes)


def folders(root: str, levels: int = 2) -> Iterator[tuple[str, bool]]:
    """(folder, whether with all below it) such that each file of the tree is in one."""
    with os.scandir(root) as entries:
        below = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))
    if not below or not levels:
        yield root, True
        return
    yield root, False
    for x in below:
        yield from folders(x, levels - 1)


def within(seconds: float, f: Callable, *args):
    """``f(*args)``, or None if it takes longer; the thread that is stuck is left to itself."""
    got: list = []
    t = threading.Thread(target=lambda: got.append(f(*args)), daemon=True)
    t.start()
    t.join(seconds)
    return got[0] if got else None


def read_file(path: str) -> tuple[str | None, str | None, str | None]:
    """(SHA-256 of the bytes, text without undecodable bytes and with line feeds only, error)."""
    digest, parts = hashlib.sha256(), []
    try:
        with open(path, "rb") as f:
            while part := f.read(_CHUNK):
                digest.update(part)
                parts.append(part)
    except OSError as e:
        return None, None, str(e)
    return digest.hexdigest(), b"".join(parts).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), None


def contents(path: str, timeout: float, read: Callable | None = None) -> tuple[str | None, str | None, str | None]:
    """(hash, text, error) of a file."""
    return within(timeout, read or read_file, path) or (None, None, READ_TIMEOUT)


class FileSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "gristmill_files"

    def schema(self) -> str:
        return CORPUS

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> FileStreamReader:
        return FileStreamReader(self.options)


_TESTS: dict[type, Callable] = {
    D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
    D.In: lambda x, among: x in among, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains, D.IsNull: lambda x, _: x is None, D.IsNotNull: lambda x, _: x is not None,
}
#: What is known of a file before it is opened, in the order of a listing's rows.
_KNOWN = ("repo", "file_path", "size", "kept")


def understood(f: D.Filter) -> tuple[int, Callable, object, bool] | None:
    """(place in a row, test, value, whether it must hold) of a filter on what is known before a file is opened."""
    holds = True
    while isinstance(f, D.Not):
        f, holds = f.child, not holds
    if type(f) not in _TESTS or len(f.attribute) != 1 or f.attribute[0] not in _KNOWN:
        return None
    return _KNOWN.index(f.attribute[0]), _TESTS[type(f)], getattr(f, "value", None), holds


class Lister:
    """Folders of a tree as partitions, and the rows of their files."""

    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/") or "/"
        self.max_size = int(options.get("maxSize", MAX_FILE_SIZE))
        self.suffixes = tuple(options["suffixes"].split(",")) if options.get("suffixes") else EXCLUDED_SUFFIXES
        self.content = options.get("content", "true") == "true"
        self.timeout = float(options.get("timeout", Settings.read_timeout))
        self.tests: list[tuple] = []

    def among(self, column: str) -> set | None:
        """The only values that the filters leave of a column; None if they name none."""
        named = [{value} if test is operator.eq else set(value) for at, test, value, holds in self.tests if holds and _KNOWN[at] == column and test in (operator.eq, _TESTS[D.In])]
        return set.intersection(*named) if named else None

    def repos(self) -> list[str]:
        only = self.among("repo")
        if only is None:
            return find_repos(self.root) or [self.root]
        found = [r for r in sorted(only) if r != self.root and is_repo(self.root, r)]
        return found or ([self.root] if self.root in only and (is_folder_repo(self.root) or not find_repos(self.root)) else [])

    def partitions(self) -> list[D.InputPartition]:
        paths = self.among("file_path")
        each = [(repo, folder, deep) for repo in self.repos() for folder, deep in folders(repo)]
        if paths is not None:
            each = [x for x in each if any(in_folder(p, x[1], x[2]) for p in paths)]
        n = min(len(each), MOST_PARTITIONS)
        return [D.InputPartition(each[i::n]) for i in range(n)]

    def listed(self, folder: str, deep: bool) -> Iterator[tuple[str, int, bool]]:
        paths = self.among("file_path")
        if paths is None:
            return list_files(folder, self.max_size, self.suffixes, deep)
        return named_files(folder, sorted(paths), self.max_size, self.suffixes, deep)

    def files(self, partition: D.InputPartition) -> Iterator[tuple[str, str, int, bool]]:
        """Rows of a listing that pass the pushed filters."""
        for repo, folder, deep in partition.value:
            for row in ((repo, *x) for x in self.listed(folder, deep)):
                if all(bool(test(row[at], value)) == holds for at, test, value, holds in self.tests):
                    yield row

    def with_content(self, row: tuple[str, str, int, bool]) -> tuple:
        return (*row, *(contents(row[1], self.timeout) if row[3] and self.content else (None, None, None)))


class FileReader(Lister, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if (known := understood(f)) is None:
                yield f
            else:
                self.tests.append(known)

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        return map(self.with_content, self.files(partition))


class FileStreamReader(Lister, D.DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        return {"changed_ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        return [D.InputPartition((start["changed_ns"], end["changed_ns"], p.value)) for p in super().partitions()]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        after, upto, value = partition.value
        for row in self.files(D.InputPartition(value)):
            if row[3] and after < changed_ns(row[1]) <= upto:
                yield self.with_content(row)


def changed_ns(path: str) -> int:
    """When a file was last written, moved or linked; 0 if it is gone."""
    try:
        s = os.stat(path)
    except OSError:
        return 0
    return max(s.st_mtime_ns, s.st_ctime_ns)


def is_folder_repo(path: str) -> bool:
    return os.path.isdir(os.path.join(path, ".git"))


def is_repo(root: str, path: str) -> bool:
    """Whether ``find_repos(root)`` has this folder, found out without a walk."""
    if not path.startswith(root.rstrip("/") + "/") or not is_folder_repo(path):
        return False
    names = path[len(root.rstrip("/")) + 1 :].split("/")
    steps = [os.path.join(root, *names[:i]) for i in range(len(names) + 1)]
    return all(names) and not any(map(is_folder_repo, steps[:-1])) and not any(map(os.path.islink, steps[1:]))


def in_folder(path: str, folder: str, deep: bool) -> bool:
    return path.startswith(folder.rstrip("/") + "/") and (deep or "/" not in path[len(folder.rstrip("/")) + 1 :])


def named_files(folder: str, paths: Iterable[str], max_size: int, suffixes: tuple[str, ...], deep: bool) -> Iterator[tuple[str, int, bool]]:
    """The rows that ``list_files`` has for these paths, looked up one by one."""
    for path in paths:
        if not in_folder(path, folder, deep) or not os.path.lexists(path) or os.path.isdir(path):
            continue
        between = path[len(folder.rstrip("/")) + 1 :].split("/")[:-1]
        steps = [os.path.join(folder, *between[: i + 1]) for i in range(len(between))]
        if any(not n or n.startswith(".") for n in between) or any(os.path.islink(x) for x in steps):
            continue
        regular = os.path.isfile(path)
        size = os.path.getsize(path) if regular else 0
        yield path, size, regular and is_wanted(path, size, max_size, suffixes)


def _options(settings: Settings, content: bool) -> dict[str, str]:
    return {"root": settings.repos_dir, "maxSize": str(settings.max_file_size), "content": str(content).lower(), "timeout": str(settings.read_timeout)}


def file_corpus(spark: SparkSession, settings: Settings, content: bool = True) -> DataFrame:
    """All files in columns CORPUS; without ``content`` they are listed only. Turns on Spark's push-down for such sources."""
    spark.dataSource.register(FileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gristmill_files").options(**_options(settings, content)).load()


def file_list(spark: SparkSession, settings: Settings) -> DataFrame:
    """repo, file_path, size and kept of all files, without opening any."""
    return file_corpus(spark, settings, content=False).select(*FILE_LIST)


def file_stream(spark: SparkSession, settings: Settings, settle: float = 1.0) -> DataFrame:
    """The kept files as a stream of changes, in columns CORPUS."""
    spark.dataSource.register(FileSource)
    return spark.readStream.format("gristmill_files").options(**_options(settings, True), settle=str(settle)).load()


def with_contents(files: DataFrame, settings: Settings, read: Callable = read_file) -> DataFrame:
    """``files(repo, file_path, size, kept)`` with content_hash, content and error: each file is opened once, by a task."""
    timeout = settings.read_timeout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):  # some files at a time, so that a task holds few
                part = b.iloc[at : at + 100]
                got = [contents(p, timeout, read) if k else (None, None, None) for p, k in zip(part["file_path"], part["kept"])]
                yield part.assign(**{c: pd.Series([x[i] for x in got], dtype=object, index=part.index) for i, c in enumerate(FILE_CONTENTS)})

    return files.select(*FILE_LIST).mapInPandas(run, CORPUS)


def repo_table(spark: SparkSession, root: str) -> DataFrame:
    """repo: what ``find_repos`` finds, or the root itself; each folder right under the root is searched by a task."""
    if is_folder_repo(root):
        return spark.createDataFrame([(root,)], "repo string")
    with os.scandir(root) if os.path.isdir(root) else contextlib.nullcontext([]) as entries:
        below = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                yield pd.DataFrame({"repo": find_repos(folder)}, dtype=object)

    return spark.createDataFrame([(x,) for x in below], "folder string").repartition(max(1, min(len(below), MOST_PARTITIONS))).mapInPandas(run, "repo string")


def model_cache(spark: SparkSession, root: str) -> DataFrame:
    """Local model folders (``models--a--b`` with weights) with name, path, files and bytes."""
    rows = [(os.path.join(root, d), os.path.join(f, n), os.path.getsize(os.path.join(f, n))) for d in sorted(os.listdir(root)) if d.startswith("models--") for f, _, names in os.walk(os.path.join(root, d)) for n in names] if os.path.isdir(root) else []
    files = spark.createDataFrame(rows, "path string, file string, size long")
    g = sizes(files, "path", F.bool_or(F.col("file").endswith(".safetensors") | F.col("file").endswith(".bin")).alias("weights"))
    return g.where("weights").select(cache_dir_model(base_name(F.col("path"))).alias("name"), "path", "files", "bytes", human_size(F.col("bytes")).alias("size"))


def model_folder(root: str, name: str) -> str:
    return os.path.join(root, "models--" + name.replace("/", "--"))


def model_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """file, bytes and size of a local model, without any if it isn't there."""
    top = model_folder(root, name)
    rows = [(os.path.relpath(p, top), os.path.getsize(p)) for f, _, names in os.walk(top) for p in (os.path.join(f, n) for n in sorted(names)) if os.path.exists(p)]
    return spark.createDataFrame(rows, "file string, bytes long").select("file", "bytes", human_size(F.col("bytes")).alias("size")).orderBy("file")


def remove_model(root: str, name: str, confirmed: Callable[[str], bool]) -> bool:
    """Remove a local model's folder if there is one and ``confirmed(question)``; whether it went."""
    top = model_folder(root, name)
    if os.path.dirname(top) != root.rstrip("/") or not os.path.isdir(top) or not confirmed(f"Remove {top}? [y/N] "):
        return False
    shutil.rmtree(top)
    return True


def sizes(files: DataFrame, by: str, *more: Column) -> DataFrame:
    """Files and bytes of each folder."""
    return files.groupBy(by).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"), *more)
