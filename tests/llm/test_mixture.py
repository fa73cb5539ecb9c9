import random

import pytest
from pyspark.sql import functions as F

from commitlens.llm import mixture


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, max_epochs=3, cycle=3):
    """By rounds: share by weight, clamp, share the excess among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % cycle + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > sizes[s] * max_epochs}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(sizes[s] * max_epochs)
            left -= out[s]
        open_ -= over
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_word_count(spark):
    texts = [None, "", " ", "a", " a b ", "a\tb\nc\x0bd\x0ce\rf", "   x", "a\x1cb \x85"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.n for r in df.orderBy("i").select(mixture.word_count(F.col("text")).alias("n")).collect()] == [words(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_against_rounds(spark, seed):
    r = random.Random(seed)
    sources = ["a", "b", "é", "z", None, "", "A"][: 3 + seed]
    docs = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(sources + [sources[0]] * 6)) for i in range(120)] + [(500, None, sources[0]), (None, "x y", sources[1]), (7, "again", sources[0])]
    rows = mixture.mix(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    sizes: dict = {}
    for _, text, s in docs:
        sizes[s] = sizes.get(s, 0) + words(text)
    want = brute_targets(sizes)
    taken: dict = {}
    for x in rows:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source], rel=1e-9)
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6
    assert sorted(map(repr, rows)) == sorted(map(repr, mixture.mix(frame(spark, docs)).repartition(7).collect()))


def test_empty_and_zero(spark):
    assert mixture.mix(frame(spark, []).limit(0)).collect() == []
    assert [(x.target, x.taken) for x in mixture.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [(0.0, 0), (0.0, 0)]


def test_keep_taken_with_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c d", "x"), (2, "e", "y"), (3, "", "x")])
    docs = docs.withColumn("size", F.lit("mine")).withColumn("mix_taken", F.lit(7)).withColumn("doc", F.lit(1))
    out = mixture.keep_taken(docs)
    assert out.columns == [*docs.columns, "mix_repeats", "_mix_taken"]
    rows = {x.doc_id: x for x in out.collect()}
    assert 3 not in rows and rows[1].size == "mine" and rows[1].mix_taken == 7 and rows[1].text == "a b c d"


def test_many_sources_long_texts_and_rows_without_ids(spark):
    """300 sources of very different sizes; a third of all rows without an id; a text of 100,000 words."""
    r = random.Random(2)
    docs = [(i if i % 3 else None, "w " * r.choice([1, 3, 50, 400]), f"s{r.randrange(300):03}") for i in range(900)] + [(5000, "w " * 100_000, "s000")]
    rows = mixture.mix(frame(spark, docs)).collect()
    sizes: dict = {}
    for _, text, s in docs:
        sizes[s] = sizes.get(s, 0) + words(text)
    want, taken = brute_targets(sizes), {}
    assert len(rows) == len(docs)
    for x in rows:
        assert x.target == pytest.approx(want[x.source], rel=1e-9) and 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(n - want[s]) <= 0.5 + 1e-6 for s, n in taken.items()) and sum(want.values()) == pytest.approx(sum(sizes.values()))
