"""Functions with the number of their commits, ranked and paged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import history_text, names


def with_frequency(elements: DataFrame, logs: DataFrame) -> DataFrame:
    """All elements with ``frequency``, the headers in the log of their (file, name); 0 without one."""
    counts = logs.select("file", "name", history_text.commit_count(F.col("log")).alias("n"))
    return elements.join(counts, ["file", "name"], "left").withColumn("frequency", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def top(rows: DataFrame, order: list, skip: int = 0, total: int = 50) -> DataFrame:
    """Rows skip + 1 to skip + total in an order, which should be total."""
    return rows.orderBy(*order).offset(skip).limit(total)


def ranked(rows: DataFrame, skip: int = 0, total: int = 50) -> DataFrame:
    """file, line, name, frequency: most commits first; equal ones by language, file, line, name."""
    order = [F.col("frequency").desc(), names.lang_order(F.col("lang")), F.col("file"), F.col("line"), F.col("name")]
    return top(rows, order, skip, total).select("file", "line", "name", "frequency")
