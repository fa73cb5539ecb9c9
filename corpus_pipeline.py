"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near duplicates stays,
documents that hold benchmark items go, personal data get surrogates, and the
sources are mixed to their weights. All stages but the last return the columns
of ``documents``; the last one adds what the mix takes of each document.

Each stage is one operator over all rows that its predecessor kept, and does with
odd rows what the operator does: null texts are clean, have no shingles, hold no
item and no personal data, and have no words to take, so that they stay until the
mix; rows with a null doc_id have no near duplicates and stay as well. Repeated rows
are all kept or all dropped by the first, third and fourth stage; the second keeps
rows that share the least doc_id of their group. Long texts are whole in every
stage. Ties are settled by doc_id. Columns beyond those of ``documents`` go through
unchanged, whatever their names. An empty table gives an empty result.

Stages are written below spark.checkpoint.dir; a stage's table goes when the next
one's is complete, the last one's stays, as the result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import decontaminate, jaccardjoin, mixture, pii, toxicity
from commitlens.llm.shared import release, shared_folder


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id."""
    return jaccardjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.keep_columns(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least a word of, with the words taken (repeats counted)."""
    return mixture.keep_taken(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("source_mixture", source_mixture),
]

#: A trained classifier, alignment and keyed surrogates can't be said in SQL.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _drop(spark, f"{folder}/{before}")
        release(spark)
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
