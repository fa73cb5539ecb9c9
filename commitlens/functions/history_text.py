"""Commit ids in the text of a git log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A header line: only a line feed ends a line (flag d), as carriage returns and U+2028 may stand in messages.
HEADER = r"(?dm)^commit (.{40})"


def commit_ids(log: Column) -> Column:
    return F.regexp_extract_all(log, F.lit(HEADER), F.lit(1))


def commit_count(log: Column) -> Column:
    """Headers in a log, 0 for null."""
    return F.coalesce(F.size(commit_ids(log)), F.lit(0)).cast("long")
