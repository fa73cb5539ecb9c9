"""Exact substring dedup: seed and extend on winnowed anchors.

A word goes if a window of ``WINDOW`` consecutive words covers it whose words
also stand earlier: in a document with a smaller doc_id, or earlier in the
same one. Words are [^\\x20\\x09-\\x0D]+, unchanged; windows are judged on the
input.

1. *Seeds.* Winnowing picks anchors: of each ``WINDOW - SEED + 1`` consecutive
   word ``SEED``-grams the one with the least hash (the last of equal ones).
   What is picked in a window depends on its words only, so equal windows hold
   equal anchors. Anchors are joined by hash, in packed form by hash range; an
   anchor of one document's step is sent once, so one of all documents is one
   entry a step. Anchors that occur once are dropped.
2. *Extend.* Every document gets the places of its repeated anchors. The
   windows around these are the anchors extended both ways by all lengths that
   still hold ``WINDOW`` words; a window counts if the anchor picked in it
   repeats.
   Windows are joined by hash in the same packed form; all but the first in
   (doc_id, place) are repeats.
3. *Maximal repeats.* Repeats of a document that overlap or touch are merged
   into ranges, and the ranges' words removed.

Texts move only where they must: those with a repeated anchor once, those that
lose words once more (where the ids of these are too many to send, all texts).

Windows are compared by 96 bits of two hashes; equal windows always meet,
unequal ones by chance of 2^-96 a pair: among 10^13 windows, with a chance of
about one in a thousand anywhere.

Nulls, empty texts and texts of fewer words than a window lose nothing. A long
text is one step by itself, in time and memory in proportion to it. Any type of
doc_id that can be ordered will do. Rows of equal doc_id are one after the
other in the order of their texts' hashes; a null doc_id comes after all
others. Rows equal in both are copies: the first keeps its words. Other columns,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit
from commitlens.llm.packed import SCHEMA, pack, unpack
from commitlens.llm.shared import BROADCAST_ROWS, cut, numbered, release

WINDOW = 20
SEED = 10
_SECOND = np.uint64(0xD1B54A32D192ED03)
RANGE_ENTRIES = 1_000_000
LEAST_RANGES = 64


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (words) of the anchors of all texts, and their hashes; starts of all windows, and the place of each one's anchor."""
    grams, ok = textkit.ngrams(h, first, SEED)
    span = WINDOW - SEED + 1
    m = len(grams)
    if m < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = grams[: m - span + 1].copy()
    place = np.arange(m - span + 1)
    for k in range(1, span):
        here = grams[k : k + m - span + 1]
        lower = here <= least
        least = np.where(lower, here, least)
        place = np.where(lower, np.arange(k, k + m - span + 1), place)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(m)
    windows = np.flatnonzero(left[: m - span + 1] >= WINDOW)
    picked = np.unique(place[windows])
    return picked, grams[picked], windows, place[windows]


_PLACES = "row long, places array<int>"


def _grouped(row: np.ndarray, place: np.ndarray) -> pa.Table:
    """One line a row with its places."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.table({"row": pa.array(row[start], pa.int64()), "places": lists})


def repeated_anchors(rows: DataFrame, ranges: int) -> DataFrame:
    """row, places: the places of each row's anchors that occur more than once."""

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(1))
            starts, ends, first = textkit.words(buf, offs)
            at, what, _, _ = anchors(textkit.hash_spans(buf, starts, ends), first)
            text = np.searchsorted(first, at, side="right") - 1
            row, place = b.column(0).to_numpy(zero_copy_only=False)[text], (at - first[text]).astype(np.int32)
            order = np.argsort(what, kind="stable")
            what, row, place = what[order], row[order], place[order]
            new = np.concatenate(([True], what[1:] != what[:-1])) if len(what) else np.zeros(0, bool)
            size = np.diff(np.append(np.flatnonzero(new), len(what)))
            many = np.repeat(size > 1, size)
            # Of an anchor that repeats here the places are settled; one entry, of place -1, tells the others.
            kind = np.where(many, 1, 0).astype(np.uint8)
            tell = np.flatnonzero(new & many)
            bucket = np.concatenate((np.where(many, textkit.mix(row.astype(np.uint64)), what) % np.uint64(ranges), what[tell] % np.uint64(ranges))).astype(np.int32)
            what = np.concatenate((np.where(many, np.uint64(0), what), what[tell]))
            row, place = np.concatenate((row, np.zeros(len(tell), np.int64))), np.concatenate((place, np.full(len(tell), -1, np.int32)))
            kind = np.concatenate((kind, np.full(len(tell), 2, np.uint8)))
            order = np.argsort(row, kind="stable")
            yield pack(bucket[order], what[order], row[order], place[order], kind[order])

    def meet(table: pa.Table) -> pa.Table:
        what, row, place, kind = unpack(table, np.uint64, np.int64, np.int32, np.uint8)
        open_ = np.flatnonzero(kind != 1)
        order = open_[np.argsort(what[open_], kind="stable")]
        w = what[order]
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(w)))
        told = np.maximum.reduceat(kind[order], start) == 2 if len(w) else np.zeros(0, bool)
        good = order[np.repeat((size > 1) | told, size)]
        good = np.concatenate((good[kind[good] == 0], np.flatnonzero(kind == 1)))
        return _grouped(row[good], place[good])

    return rows.select("row", "text").mapInArrow(step, SCHEMA).groupBy("bucket").applyInArrow(meet, _PLACES)


def repeated_windows(rows: DataFrame, seeds: DataFrame, ranges: int) -> DataFrame:
    """row, places: where a row's windows start that also stand earlier. ``row`` orders the documents."""
    lists = seeds.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))
    both = _held(rows, seeds).join(lists, "row").select("row", "text", "places")

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(1))
            starts, ends, first = textkit.words(buf, offs)
            h = textkit.hash_spans(buf, starts, ends)
            _, _, w, anchor = anchors(h, first)
            lists = b.column(2)
            values, o = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            hit = np.zeros(len(h) + 1, bool)
            hit[values.astype(np.int64) + np.repeat(first[:-1], np.diff(o))] = True
            # A window whose own anchor doesn't repeat can't repeat.
            w = w[hit[anchor]]
            whole = textkit.ngrams(h, first, WINDOW)[0][w]
            more = (textkit.ngrams(textkit.mix(h ^ _SECOND), first, WINDOW)[0][w] >> np.uint64(32)).astype(np.uint32)
            text = np.searchsorted(first, w, side="right") - 1
            row, place = b.column(0).to_numpy(zero_copy_only=False)[text], (w - first[text]).astype(np.int32)
            # Of equal windows here all but the first are settled; the first one is sent to meet the others.
            order = np.lexsort((place, row, more, whole))
            whole, more, row, place = whole[order], more[order], row[order], place[order]
            new = _new(whole, more)
            bucket = np.where(new, whole, textkit.mix(row.astype(np.uint64) + place.astype(np.uint64))) % np.uint64(ranges)
            order = np.argsort(row, kind="stable")
            yield pack(bucket.astype(np.int32)[order], whole[order], more[order], row[order], place[order], (~new).astype(np.uint8)[order])

    def meet(table: pa.Table) -> pa.Table:
        whole, more, row, place, settled = unpack(table, np.uint64, np.uint32, np.int64, np.int32, np.uint8)
        open_ = np.flatnonzero(settled == 0)
        order = open_[np.lexsort((place[open_], row[open_], more[open_], whole[open_]))]
        later = order[~_new(whole[order], more[order])]
        good = np.concatenate((later, np.flatnonzero(settled == 1)))
        return _grouped(row[good], place[good])

    return both.mapInArrow(step, SCHEMA).groupBy("bucket").applyInArrow(meet, _PLACES)


def _new(whole: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Of sorted pairs: where another pair begins."""
    return np.concatenate(([True], (whole[1:] != whole[:-1]) | (more[1:] != more[:-1]))) if len(whole) else np.zeros(0, bool)


def _held(rows: DataFrame, places: DataFrame, kind: str = "left_semi") -> DataFrame:
    """The rows named in ``places`` (or, with left_anti, the others), before their texts go through a shuffle.

    Only where the names are few enough to send; else all rows, which the join that follows deals with itself.
    """
    ids = _few(places)
    return rows.join(F.broadcast(ids), "row", kind) if ids is not None else rows


def _few(places: DataFrame) -> DataFrame | None:
    ids = places.select("row").distinct()
    return ids if ids.count() <= BROADCAST_ROWS else None


def merged(places: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges (end exclusive) that windows starting at sorted ``places`` cover."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(places, cuts)]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed, of every row."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    # No row is null.
    keyed = _ordered(docs).where("row is not null")
    rows = keyed.select("row", "text")
    n = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = max(LEAST_RANGES, n // 36 // RANGE_ENTRIES)
    seeds = cut(repeated_anchors(rows, ranges))
    release(spark)
    gone = cut(repeated_windows(rows, seeds, ranges))
    del seeds
    release(spark)
    lists = gone.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))
    none = F.lit(None).cast("array<int>").alias("places")
    if (ids := _few(gone)) is not None:
        # Only texts that lose words go through a shuffle.
        touched = keyed.join(F.broadcast(ids), "row", "left_semi").join(lists, "row", "left").select("doc_id", "text", "places")
        both = keyed.join(F.broadcast(ids), "row", "left_anti").select("doc_id", "text", none).union(touched)
    else:
        both = keyed.join(lists, "row", "left").select("doc_id", "text", "places")

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(1))
            starts, ends, first = textkit.words(buf, offs)
            raw, kept, n_words, n_removed = buf.tobytes(), [], np.diff(first), []
            for i, places in enumerate(b.column(2)):
                a, z = int(first[i]), int(first[i + 1])
                left, removed = [], 0
                at = 0
                for lo, hi in [*merged(np.sort(places.values.to_numpy())), (z - a, z - a)] if places.is_valid else [(z - a, z - a)]:
                    left += [raw[s:e] for s, e in zip(starts[a + at : a + lo].tolist(), ends[a + at : a + lo].tolist(), strict=True)]
                    removed += hi - lo
                    at = hi
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                n_removed.append(removed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"]
            )

    return both.mapInArrow(step, f"doc_id {kind}, kept string, n_words long, n_removed long")


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: an integer doc_id itself where no two rows share one and none is null; else a number in the rows' order."""
    docs = docs.select("doc_id", "text")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        plain = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
        twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not twice and plain["n"] == plain["ids"]:
            return docs.withColumn("row", F.col("doc_id").cast("long"))
    return numbered(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text"), "row")


def op4(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with t as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from t),
x as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as g from p),
r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from x),
g as (select distinct doc_id, i + j as i from r, range(0, 20) s(j) where k > 1),
l as (select doc_id, list(i) as gone from g group by 1)
select t.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), ' ')) as kept_sha256
from t left join l on t.doc_id = l.doc_id
"""
