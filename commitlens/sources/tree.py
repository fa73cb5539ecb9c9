"""The files of a tree as a DataFrame: ``spark.read.format("source_tree").load(root)``.

Paths are relative to the root and start with ``./``. Hidden folders are walked,
links are files and are not followed, entries that can't be read and paths that
aren't UTF-8 are left out. The option ``below`` (paths, one a line) prunes: only folders
that can hold such a path are listed. Folders are dealt out: from the root
down, folders are opened on the driver until there are ``PARTS`` of them or
``DEPTH`` levels are open, so that one big top folder is many tasks. The root must be
mounted on all executors.

``scan`` also takes a root in a store that only Spark's file systems open
(``hdfs://``, ``viewfs://``): the driver lists it, as Spark lists the files of a table,
and a folder that can't be listed ends the scan.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from commitlens.functions import names, predicates


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def walk(root: str, folder: str, deep: bool) -> Iterator[str]:
    """Paths below ``folder`` ("" for the root), relative to the root."""
    pending = [folder]
    while pending:
        here = pending.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{here}/{e.name}" if here else e.name
            try:
                path.encode()
                is_dir = e.is_dir(follow_symlinks=False)
            except (UnicodeEncodeError, OSError):
                continue
            if not is_dir:
                yield f"./{path}"
            elif deep:
                pending.append(path)


#: Folders that are a task each, at least if there are so many; levels that the driver opens for it at most.
PARTS, DEPTH = 64, 4


def _folders(root: str, here: str) -> list[str]:
    try:
        entries = [e.name for e in os.scandir(os.path.join(root, here)) if e.is_dir(follow_symlinks=False)]
    except OSError:
        return []
    return sorted(f"{here}/{n}" if here else n for n in entries)


def may_hold(folder: str, below: tuple[str, ...]) -> bool:
    """Whether a folder ("" for the root) is at, under or above one of the paths; no paths: all may."""
    inside = lambda a, b: b == "" or a == b or a.startswith(f"{b}/")
    return not below or any(inside(folder, p) or inside(p, folder) for p in below)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, below: tuple[str, ...]):
        self.root, self.below = root, below

    def partitions(self) -> list[Folder]:
        shallow, deep = [""], [f for f in _folders(self.root, "") if may_hold(f, self.below)]
        for _ in range(DEPTH):
            if len(deep) >= PARTS or not deep:
                break
            shallow += deep
            deep = [f for d in deep for f in _folders(self.root, d) if may_hold(f, self.below)]
        return [*(Folder(f, False) for f in shallow), *(Folder(f, True) for f in deep)]

    def read(self, partition: Folder) -> Iterator[tuple[str]]:
        for path in walk(self.root, partition.path, partition.deep):
            yield (path,)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], tuple(p for p in self.options.get("below", "").split("\n") if p))


def walk_store(spark: SparkSession, root: str, below: tuple[str, ...]) -> Iterator[str]:
    """As ``walk`` from the root, by Spark's file systems, with the pruning of ``below``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    pending = [("", top)]
    while pending:
        here, at = pending.pop()
        for e in store.listStatus(at):
            name = e.getPath().getName()
            path = f"{here}/{name}" if here else name
            if not e.isDirectory():
                yield f"./{path}"
            elif may_hold(path, below):
                pending.append((path, e.getPath()))


#: A root that is a URI, and the part of one that stands before a local path.
_URI, _LOCAL = re.compile("[A-Za-z][A-Za-z0-9+.-]*:/"), re.compile("^file:(?:///|/(?!/))")


def _files(spark: SparkSession, root: str, below: list[str]) -> DataFrame:
    """path of all files below the root that pruning leaves."""
    root = _LOCAL.sub("/", root)
    if _URI.match(root):
        return spark.createDataFrame([(p,) for p in walk_store(spark, root, tuple(below))], "path string")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("below", "\n".join(below)).load(os.path.abspath(root))


def scan(spark: SparkSession, root: str, prefixes=(), not_contains=()) -> DataFrame:
    """path, lang of the visible files that pass the path filters."""
    path = F.col("path")
    # What a prefix may match, without the ./ in front; one that is above everything prunes nothing.
    below = [posixpath.normpath(p) for p in prefixes]
    files = _files(spark, root, [] if "." in below or "" in prefixes else below)
    files = files.where(predicates.has_prefix(path, prefixes)).where(predicates.contains_none(path, not_contains)).where(predicates.is_visible(path))
    return files.withColumn("lang", names.lang_of(path))
