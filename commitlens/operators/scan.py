"""From files to functions."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions import names, predicates
from commitlens.languages import REGISTRY
from commitlens.schema import ELEMENTS, FILES


class NoFiles(Exception):
    """A set without files was asked for its functions."""


class NotCompatible(Exception):
    """A file of another language was added to a set."""


def rows_of(file: str, lang: str, content: bytes | None) -> list[tuple]:
    """One row a function; one with a status other than ok for a file without readable text."""
    if content is None:
        return [(file, lang, None, None, None, None, None, "unreadable")]
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return [(file, lang, None, None, None, None, None, "not_utf8")]
    return [(file, lang, f.line, f.name, f.receiver, f.capture_index, k, "ok") for k, f in enumerate(REGISTRY[lang].extract(text))]


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ELEMENTS.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """One batch for the functions of many files."""
    columns = zip(*rows, strict=True) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def scan_files(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Rows of ``rows_of`` for all files (path, lang) of supported languages below ``root``."""
    n = tasks or files.sparkSession.sparkContext.defaultParallelism

    def read(path: str) -> bytes | None:
        try:
            with open(os.path.join(root, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def step(batches):
        for b in batches:
            yield _batch([row for path, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in rows_of(path, lang, read(path))])

    return files.where(predicates.is_supported(F.col("lang"))).select("path", "lang").repartition(n).mapInArrow(step, ELEMENTS)


def scan_sources(sources: DataFrame) -> DataFrame:
    """As ``scan_files``, for a table of path, lang, content."""

    def step(batches):
        for b in batches:
            yield _batch([row for path, lang, content in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in rows_of(path, lang, content)])

    return sources.where(predicates.is_supported(F.col("lang"))).select("path", "lang", "content").mapInArrow(step, ELEMENTS)


def _named(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("status") == "ok").withColumn("name", names.qualified_name(F.col("receiver"), F.col("name")))


def elements(scanned: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """file, lang, line, name of the functions, names qualified, those with an excluded term left out."""
    return _named(scanned).where(predicates.contains_none(F.col("name"), exclude)).select("file", "lang", "line", "name", "capture_index")


def redacted(scanned: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """lang, found, redacted: the functions that were found, and those of them that an excluded term leaves out."""
    out = F.count(F.when(~predicates.contains_none(F.col("name"), exclude), 1))
    return _named(scanned).groupBy("lang").agg(F.count("*").alias("found"), out.alias("redacted"))


def problems(scanned: DataFrame) -> DataFrame:
    """file, lang, status of the files whose text could not be read."""
    return scanned.where(F.col("status") != "ok").select("file", "lang", "status")


class FileSet:
    """Files of one language, added one by one, and the terms that leave functions out."""

    def __init__(self, lang: str, root: str = "."):
        self.lang, self.root = lang, root
        self.files: list[str] = []
        self.exclude: tuple[str, ...] = ()

    def add_file(self, path: str, lang: str) -> None:
        """Doesn't look at the disk."""
        if lang != self.lang:
            raise NotCompatible(f"{path}: {lang}, not {self.lang}")
        self.files.append(path)

    def filter_name(self, term: str) -> None:
        self.exclude += (term,)

    def find_functions(self, spark: SparkSession) -> DataFrame:
        if not self.files:
            raise NoFiles(self.lang)
        files = spark.createDataFrame([(p, self.lang) for p in self.files], FILES)
        return elements(scan_files(files, self.root), self.exclude)
