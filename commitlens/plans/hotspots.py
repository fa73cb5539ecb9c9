"""The report over a source tree in a git work tree."""

from __future__ import annotations

import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions import predicates
from commitlens.operators import report, scan
from commitlens.options import ReportOptions
from commitlens.sources import git, tree

log = logging.getLogger("commitlens")


class NoFilesFound(Exception):
    pass


def run(spark: SparkSession, options: ReportOptions = ReportOptions()) -> DataFrame:
    """file, line, name, frequency. Fails outside a repository, and where no file passes the path filters.

    Files are listed and functions extracted once: what is found is held (``persist``) for the join's two sides and the messages.
    """
    root = os.path.abspath(options.root)
    git.check_repository(root)
    began = time.monotonic()
    below = tuple(f"./{p}" for p in options.prefix)
    files = tree.scan(spark, root, below, options.invert_match).persist()
    if not files.limit(1).count():
        raise NoFilesFound(options.root)
    log.debug("files listed in %.1f s", time.monotonic() - began)
    scanned = scan.scan_files(files, root).persist()
    _messages(files, scanned, options)
    found = scan.elements(scanned, options.exclude_func)
    logs = git.line_history(found, root, options.mode)
    return report.ranked(report.with_frequency(found, logs), options.skip, options.total)


def _messages(files: DataFrame, scanned: DataFrame, options: ReportOptions) -> None:
    """What was passed over, at the level asked for; rows come to the driver one partition at a time, and only if they are to be shown."""
    if log.isEnabledFor(logging.WARNING):
        for row in files.where(~predicates.is_supported(F.col("lang"))).toLocalIterator():
            log.warning("%s: unsupported", row["path"])
        for row in scan.problems(scanned).toLocalIterator():
            log.warning("%s: %s", row["file"], row["status"])
    if log.isEnabledFor(logging.INFO):
        began = time.monotonic()
        for row in scan.redacted(scanned, options.exclude_func).orderBy("lang").toLocalIterator():
            log.info("%s: %d functions, %d left out by name", *row)
        log.debug("functions extracted in %.1f s", time.monotonic() - began)
