"""Mixing sources to target weights by capped water-filling.

Sizes are words. Every source is to give its weight's part of a budget; a
source can give at most ``max_epochs`` times its own words, and what it can't
give is shared among the others by weight until none is above its cap. This
goes in rounds: the level (words for each unit of weight) that the open sources
would get; those above their cap are clamped; again, until none is. A source is
clamped if its cap is below the level, so a round's state is one number, and its
work one aggregate over the table of sources, however many there are.

A source's target is then met exactly (to the rounded word): every document
gets the whole repetitions, and the rest goes over the source's documents in a
seeded order until it is used up; the document it ends in is taken in part.
The order is that of md5(seed:doc_id), with a digest of the text in place of a
null doc_id. Positions in it are prefix sums in two
levels, over 4096 hash ranges of a source and inside each, so that a source
with a third of all rows is no single task.

Nulls: a null source is a source of its own, the last in order; a null text
has size 0. Ties: rows of one place in the order go by doc_id (null last), then
size; repeated rows count each for itself. Texts of any length count as a whole,
in memory in proportion. An empty table gives an empty result. All sizes 0:
targets 0. Other columns are not looked at; ``keep_taken`` returns them and
gives its own two names that aren't taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitlens.llm.shared import cut, fresh, numbered, small

#: Hex digits of md5 that name a hash range.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null: the places where a word begins."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    parts = F.array_remove(F.split(flat, " +"), "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")


def weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """source, source_size -> with weight: 1, 2, ... cycle, repeating in code point order, null last."""
    place = "_place"
    ranked = numbered(sources.orderBy(F.col("source").asc_nulls_last()), place)
    return ranked.withColumn("weight", (F.col(place) % cycle + 1).cast("long")).drop(place)


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, weight -> with target (double). The budget is the sum of all sizes."""
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(full, cap)), F.lit(0))
        row = sources.agg(left.alias("left"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not row["rest"] or row["left"] / row["rest"] <= level:
            break
        level = row["left"] / row["rest"]
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target if row["rest"] else cap.cast("double"))


def mix(docs: DataFrame, max_epochs: int = 3, cycle: int = 3, seed: str = "mix", keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, repeats, taken; with ``keep`` also doc, a struct of all columns of ``docs``."""
    at = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), at.alias("at"), F.substring(at, 1, RANGE_DIGITS).alias("range"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if keep else []),
    )
    ranges = cut(rows.groupBy("key", "source", "range").agg(F.sum("size").alias("words")))
    sources = water_fill(weights(ranges.groupBy("key", "source").agg(F.sum("words").alias("source_size")), cycle), max_epochs)
    offset = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = ranges.select("key", "range", offset.alias("offset")).join(sources.drop("source"), "key")
    plan = small(cut(plan))
    here = W.partitionBy("key", "range").orderBy("at", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    full = rows.withColumn("inside", F.coalesce(F.sum("size").over(here), F.lit(0))).join(plan, ["key", "range"])
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    names = ["doc_id", "source", "size", "source_size", "weight", "target", whole.alias("repeats"), (whole * F.col("size") + part).cast("long").alias("taken")]
    return full.select(*names, *(["doc"] if keep else []))


def keep_taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns, with the whole repeats and the words taken."""
    more = [fresh(docs, "mix_repeats"), fresh(docs, "mix_taken")]
    out = mix(docs, keep=True, **options).where("taken > 0")
    return out.select("doc.*", F.col("repeats").alias(more[0]), F.col("taken").alias(more[1]))


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5('mix:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) as k from documents),
     s as (select source, sum(size)::bigint as source_size from d group by 1),
     w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from s),
     o as (select *, source_size * 3 as cap,
                  (sum(source_size) over ())::bigint as total,
                  coalesce(sum(source_size * 3) over (order by (source_size * 3) / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as below,
                  (sum(weight) over (order by (source_size * 3) / weight, source nulls last rows between current row and unbounded following))::bigint as rest
           from w),
     v as (select *, (total - below) / rest as lev from o),
     l as (select min_by(lev, (cap / weight, coalesce(source, chr(1114111)))) as lev from v where lev * weight <= cap),
     t as (select source, source_size, least(cap::double, coalesce((select lev from l) * weight, cap::double)) as target from v),
     p as (select d.*, t.source_size, t.target,
                  coalesce(sum(size) over (partition by d.source order by k, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
           from d join t on d.source is not distinct from t.source),
     q as (select *, floor(target / greatest(source_size, 1))::bigint as n from p)
select doc_id, size, source_size, target,
       (n * size + greatest(0, least(size, round(target)::bigint - n * source_size - before)))::bigint as taken
from q
"""
