import random

import numpy as np
import pyarrow as pa
import pytest

from commitlens.llm import decontaminate as D


def test_smith_waterman_against_the_table():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 9)), r.integers(0, 4, r.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        score, start, end = D.smith_waterman(a.astype(np.uint64), b.astype(np.uint64))
        assert score == h.max() and (not score or 0 <= start < end <= len(b))


def test_copies_and_edits(spark):
    r = random.Random(4)
    item = [f"w{r.randrange(5000)}" for _ in range(60)]
    edit = [w if r.random() > 0.15 else f"x{r.randrange(99)}" for w in item]
    filler = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    docs = [(1, filler(300) + " " + " ".join(item) + ". " + filler(50)), (2, " ".join(edit)), (3, filler(400)), (4, None), (5, ""), (6, ", ".join(item).upper()), (7, " ".join(item[:20])), (1, "again " + " ".join(item)), (None, " ".join(item))]
    docs += [(100 + i, "start " + " ".join(item) + f" end{i}") for i in range(30)]
    bench = [(1, " ".join(item)), (2, filler(40)), (3, "too short"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    got = {(x.doc_id, x.item_id): x for x in D.find(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) == {(i, 1) for i in (1, 2, 6, None, *range(100, 130))}
    assert got[(6, 1)].score == 1.0 and (got[(6, 1)].first_word, got[(6, 1)].last_word) == (0, 59)
    assert got[(2, 1)].score < 1 and (got[(100, 1)].first_word, got[(100, 1)].last_word) == (1, 60)
    kept = D.keep_clean(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == df.columns and sorted((x.doc_id for x in kept.collect()), key=repr) == sorted([3, 4, 5, 7, None], key=repr)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    items = [(i, " ".join(f"i{i}_{k}" for k in range(8))) for i in range(6)]
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in items], "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id, x.score) for x in D.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(i, i, 1.0) for i in range(6)]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert D.find(docs, bench).collect() == [] and D.find(one, bench).collect() == []


@pytest.mark.parametrize("copies", [4, 1000])
def test_the_same_edited_or_truncated_passage_in_many_documents(spark, copies):
    item = [f"w{k}" for k in range(60)]
    edit = [f"x{k}" if k % 15 == 7 else w for k, w in enumerate(item)]
    passages = {0: " ".join(edit), 1: " ".join(item[:40])}
    docs = [(2 * i + k, f"start{i} {passages[k]} end{i}") for i in range(copies) for k in passages]
    found = {}
    for k in passages:
        df = spark.createDataFrame([d for d in docs if d[0] % 2 == k], "doc_id long, text string")
        found[k] = {x.doc_id: x.score for x in D.find(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {0: {2 * i: 0.9 for i in range(copies)}, 1: {2 * i + 1: 40 / 60 for i in range(copies)}}


def test_common_phrases_seed_and_the_bound_loses_nothing(spark):
    """Documents that share only a phrase of all documents with an item are aligned as well; results equal aligning all pairs."""
    r = random.Random(6)
    items = [(i, "which of the following is " + " ".join(f"v{r.randrange(30)}" for _ in range(r.randrange(0, 30)))) for i in range(8)]
    docs = []
    for i in range(150):
        own = r.choice(items)[1].split()
        docs.append((i, " ".join(w if k < 4 or r.random() > 0.35 else f"v{r.randrange(30)}" for k, w in enumerate(own) if k < 4 or r.random() > 0.1)))
    got = {(x.doc_id, x.item_id): x.score for x in D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = (D.word_hashes(pa.array([t]))[0] for t in (item, text))
            score = D.smith_waterman(a, b)[0] / len(a)
            if score >= D.THRESHOLD:
                want[d, i] = score
    assert got == want and len(want) > 150


def run(spark, docs, items):
    found = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(x.doc_id, x.item_id): x.score for x in found.collect()}


def test_short_items_are_found_whole(spark):
    items = [(1, "cat"), (2, "Two words"), (3, "three word item"), (4, "three word item"), (5, "...")]
    docs = [(1, "a cat sat"), (2, "two, WORDS"), (3, "a three word item here"), (4, "three word"), (5, "words two"), (6, "catalogue")]
    assert run(spark, docs, items) == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (3, 4): 1.0}


def test_evenly_spread_edits(spark):
    """Every fourth or every third word changed, at any offset."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(30 + i))) for i in range(12)]
    docs = [(100 * step + 20 * off + i, "pad pad " + " ".join(f"x{k}" if k % step == off else w for k, w in enumerate(t.split())) + " pad") for i, t in items for step in (3, 4) for off in range(3)]
    got = run(spark, docs, items)
    assert {(d, d % 20) for d, _ in docs if (30 + d % 20 - len(range(d // 20 % 5, 30 + d % 20, d // 100)) * 1.5) / (30 + d % 20) >= D.THRESHOLD} <= set(got)


def test_recall_of_random_edits(spark):
    """10 to 33 % of the words replaced, dropped or doubled at random: recall against alignment of all pairs."""
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice([8, 15, 30, 80])))) for i in range(30)]
    docs = []
    for d in range(600):
        out = []
        rate = r.uniform(0.1, 0.33)
        for w in r.choice(items)[1].split():
            out += [w] if r.random() > rate else r.choice([[f"w{r.randrange(300)}"], [], [w, w]])
        docs.append((d, " ".join([f"w{r.randrange(300)}" for _ in range(20)] + out)))
    got = run(spark, docs, items)
    want = set()
    hashed = {i: D.word_hashes(pa.array([t]))[0] for i, t in items}
    for d, text in docs:
        h = D.word_hashes(pa.array([text]))[0]
        want |= {(d, i) for i, own in hashed.items() if D.smith_waterman(own, h)[0] >= D.THRESHOLD * len(own)}
    assert set(got) <= want and len(got) >= 0.9 * len(want) and len(want) > 400


def test_long_text_hot_copies_and_repeated_items(spark):
    item = " ".join(f"q{k}" for k in range(25))
    docs = [(i, f"x{i} {item}") for i in range(300)] + [(900, "w " * 100_000 + item + " w" * 100_000), (901, None), (901, "")]
    got = run(spark, docs, [(1, item), (2, item), (2, item)])
    assert set(got) == {(d, i) for d in [*range(300), 900] for i in (1, 2)}
