"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of code points above 127, in
lower case (A-Z), so punctuation and line breaks don't matter. A seed is four
words of a benchmark item, consecutive or with one word left out (``PATTERNS``),
however many documents hold it: an item in which no two of three consecutive
words are edited has one, wherever the edits are, and so does one with every
third word changed. An item of fewer than four words is a seed as a whole. A pass
over the documents joins them with items on seeds, and aligns each item with
the stretch of the document around its seeds by Smith-Waterman (match 1,
mismatch and gap -1/2, words compared by hash). An item is found in a document
where score / words of the item >= ``THRESHOLD``, that is with up to a third of
its words replaced. Of copies with 10 to 33 % of the words replaced, dropped or
doubled at random, measured recall against alignment of all pairs is 0.97 to 0.99
(``tests/llm/test_decontaminate.py`` asserts 0.9); what is lost has no
seed left. Common phrases bring many documents that hold no
copy; an exact bound goes first: words of the item that the text lacks can't
match, so no stretch of the item scores more than 1 for each word that the
text has and -1/2 for each that it lacks.

Different items go in blocks of about ``BLOCK_CHARS`` characters (or one item,
where that is longer), each block to all executors in one pass, so a benchmark
of any size works and what is sent has a bound.

Nulls and empty texts hold nothing and match nothing. Rows with a null id keep
it. Repeated documents and repeated items each get their own row; of several
places with the same score the first counts. A long text is one step by itself.
An empty table gives an empty result. Other columns, whatever their names, are
not looked at; ``keep_clean`` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit
from commitlens.llm.shared import cut, numbered, small, without

#: Places of a seed's words; an item of fewer words than these is one seed.
PATTERNS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SHORT = ((0,), (0, 1), (0, 1, 2))
THRESHOLD = 0.5
BLOCK_CHARS = 4_000_000
_BITS = 22

_CLASS = np.full(256, 32, np.uint8)
_CLASS[48:58] = np.arange(48, 58)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = textkit.text_buffer(col)
    flat = _CLASS[buf]
    starts, ends, first = textkit.words(flat, offs)
    return textkit.hash_spans(flat, starts, ends), first


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local score, and the stretch of ``text`` (end exclusive) that it covers."""

    def best(a, b):
        ramp = np.arange(len(b) + 1) * 0.5
        h, top, end = np.zeros(len(b) + 1), 0.0, 0
        for x in a:
            new = np.maximum(h - 0.5, 0)
            new[1:] = np.maximum(new[1:], h[:-1] + np.where(b == x, 1.0, -0.5))
            h = np.maximum.accumulate(new + ramp) - ramp
            k = int(h.argmax())
            if h[k] > top + 1e-9:
                top, end = float(h[k]), k
        return top, end

    score, end = best(item, text)
    if not score:
        return 0.0, 0, 0
    _, back = best(item[::-1], text[:end][::-1])
    return score, end - back, end


def seeds_of(h: np.ndarray, first: np.ndarray, pattern: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Words where a seed of the pattern starts, and the seeds' hashes."""
    m = len(h) - pattern[-1]
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    acc = np.full(m, np.uint64(sum(1 << k for k in pattern)))
    for k in pattern:
        acc = textkit.mix(acc ^ h[k : k + m])
    at = np.flatnonzero(left[:m] > pattern[-1])
    return at, acc[at]


class Block:
    """A bounded block of items, as it goes to executors."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids = ids
        self.words, self.first = word_hashes(texts)
        size = np.diff(self.first)
        self.patterns = [p for p in PATTERNS if (size > p[-1]).any()] + [p for p in SHORT if (size == len(p)).any()]
        grams, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in self.patterns:
            at, gram = seeds_of(self.words, self.first, p)
            item = np.searchsorted(self.first, at, side="right") - 1
            mine = size[item] == len(p) if p in SHORT else np.ones(len(at), bool)
            grams.append(gram[mine])
            items.append(item[mine])
            places.append((at - self.first[item])[mine])
        gram = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = np.concatenate(items)[order], np.concatenate(places)[order]
        self.seeds, self.edge = np.unique(gram[order], return_index=True)
        self.edge = np.append(self.edge, len(gram))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words where seeds start, in order, and which."""
        places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in self.patterns:
            at, gram = seeds_of(h, first, p)
            some = self.maybe[(gram >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, gram = at[some], gram[some]
            k = np.minimum(np.searchsorted(self.seeds, gram), len(self.seeds) - 1)
            good = self.seeds[k] == gram
            places.append(at[good])
            which.append(k[good])
        at, k = np.concatenate(places), np.concatenate(which)
        order = np.argsort(at, kind="stable")
        return at[order], k[order]


def _reachable(own: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of items with the words ``own``, ``size`` each, which the words of ``text`` let reach the threshold: an upper bound of the score, doubled."""
    gain = np.where(np.isin(own, text), 2, -1)
    after = np.cumsum(gain)
    # Falls by more than any sum at each new item, so that the running minimum starts again.
    fall = np.repeat(np.arange(len(size)), size) * (4 * len(own) + 1)
    lowest = np.minimum.accumulate(after - gain - fall) + fall
    return np.maximum.reduceat(after - lowest, np.cumsum(size) - size) >= 2 * THRESHOLD * size


def _aligned(block: Block, h: np.ndarray, at: np.ndarray, k: np.ndarray, base: int):
    """Items found in one text, whose words are ``h``; seeds ``k`` stand at ``at - base``."""
    size = block.edge[k + 1] - block.edge[k]
    each = np.repeat(at - base, size)
    entry = np.repeat(block.edge[k], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    item, lead = block.item[entry], each - block.place[entry]
    order = np.lexsort((lead, item))
    item, lead = item[order], lead[order]
    some, start = np.unique(item, return_index=True)
    leads = np.split(lead, start[1:])
    size = block.first[some + 1] - block.first[some]
    words = block.words[np.repeat(block.first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    for x in np.flatnonzero(_reachable(words, size, h)).tolist():
        i, mine = int(some[x]), leads[x]
        own = block.words[block.first[i] : block.first[i + 1]]
        slack = max(8, len(own) // 2)
        best = (0.0, 0, 0)
        for part in np.split(mine, np.flatnonzero(np.diff(mine) > slack) + 1):
            a, b = max(0, int(part[0]) - slack), min(len(h), int(part[-1]) + len(own) + slack)
            if not _reachable(own, size[x : x + 1], h[a:b])[0]:
                continue
            score, start, end = smith_waterman(own, h[a:b])
            best = max(best, (score, -(a + start), a + end))
        if best[0] >= THRESHOLD * len(own):
            yield i, best[0] / len(own), -best[1], best[2]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every item found in a document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item long, score double, first_word long, last_word long"
    items = benchmark.select("item_id", "text").where("text is not null")
    different = numbered(items.select("text").distinct(), "item")
    size = different.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_blocks = -(-size // BLOCK_CHARS)
    out = spark.createDataFrame([], schema)
    for i in range(n_blocks):
        mine = different.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == i).toArrow()
        block = Block(mine.column("item").to_pylist(), mine.column("text"))
        if len(block.seeds):
            out = out.union(docs.select("doc_id", "text").mapInArrow(_matcher(block), schema))
    named = items.join(different, "text").select("item", "item_id")
    # One row for each item and document that match, so few; items are as many as the benchmark has.
    return out.join(small(cut(named)), "item").select("doc_id", "item_id", "score", "first_word", "last_word")


def _matcher(block: Block):
    def step(batches):
        for b in textkit.slices(batches):
            h, first = word_hashes(b.column(1))
            at, k = block.hits(h, first)
            text = np.searchsorted(first, at, side="right") - 1
            rows = []
            for i in np.unique(text).tolist():
                lo, hi = np.searchsorted(text, [i, i + 1])
                for found in _aligned(block, h[first[i] : first[i + 1]], at[lo:hi], k[lo:hi], int(first[i])):
                    rows.append((i, *found))
            if rows:
                doc, item, score, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array([block.ids[x] for x in item]), pa.array(score), pa.array(start, pa.int64()), pa.array([e - 1 for e in end], pa.int64())],
                    names=["doc_id", "item", "score", "first_word", "last_word"],
                )

    return step


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those in which an item was found."""
    return without(docs, find(docs, benchmark).select("doc_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
