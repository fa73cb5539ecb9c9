import random

import numpy as np
import pytest

from commitlens.llm import jaccardjoin, shared


def brute(docs):
    sets = {}
    for k, (i, text) in enumerate(docs):
        w = (text or "").encode().lower().split()
        sets[k] = (i, {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in sets.items():
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in sets.items())


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(seed, size=40):
    r = random.Random(seed)
    texts = [None, "", "  ", "one", "One", "a b c d", "a b c d e", "A b c d e", "a b c d e f"]
    common = [f"c{k}" for k in range(60)]
    for _ in range(size // 8):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 9, 14, 30, 80, 300]))]
        texts += [" ".join(edited(r, base, r.randrange(0, 1 + len(base) // 20 + 1))) for _ in range(4)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base + common), " ".join(common + [f"u{r.randrange(10**6)}" for _ in range(30)])]
    r.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccardjoin.groups(df).collect()) == brute(docs)


def test_short_near_copies(spark):
    """Pairs of 3 to 12 shingles whose common features may all fall outside the counted part, with no other document like them."""
    r = random.Random(9)
    docs = []
    for i in range(400):
        base = [f"d{i}w{r.randrange(10**6)}" for _ in range(r.randrange(8, 17))]
        m = len(base) - 4
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: len(base) - r.randrange(1, m // 4 + 1)]))]
    want = brute(docs)
    assert all(c == i - i % 2 for i, _, c in want)
    got = jaccardjoin.groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_part_enum_shares_a_signature():
    """All pairs at or above the threshold share one, over many sizes and differences."""
    r = np.random.default_rng(5)
    for size in [*range(4, 60), 100, 250, 700]:
        for _ in range(20):
            both = r.integers(0, 1 << 63, size, dtype=np.uint64)
            k = int(r.integers(0, size // 4 + 1))
            extra = r.integers(0, 1 << 63, max(0, (4 * (size - k) - 3 * size) // 3), dtype=np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate((both[k:], extra)))
            same = len(np.intersect1d(a, b))
            if 4 * same < 3 * (len(a) + len(b) - same) or np.array_equal(a, b):
                continue
            x = {s for band in jaccardjoin.bands_of(len(a)) for s in jaccardjoin.part_enum(a, band).tolist()}
            y = {s for band in jaccardjoin.bands_of(len(b)) for s in jaccardjoin.part_enum(b, band).tolist()}
            assert x & y, (size, k, len(extra))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 30), (20, 40), (20, 50), (6, 6)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 30: 20, 40: 20, 50: 20}


def test_empty_null_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccardjoin.groups(empty).collect() == []
    rows = [(1, "a b c d e f", 1, "x"), (2, "A b c d e f", 2, "y"), (2, "A b c d e f", 2, "y"), (None, "a b c d e f", 3, "z"), (5, None, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep long, class string")
    got = sorted(map(tuple, jaccardjoin.groups(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 2, 1), (5, 0, 5)], key=repr)
    kept = jaccardjoin.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)


@pytest.mark.parametrize("kind, ids", [("long", [2**60, -1, 2**62 + 5, -(2**63), 7, 0, 2**63 - 1]), ("string", ["b", "a", "é", "B", "", "aa", "z" * 300])])
def test_ids_of_any_kind(spark, kind, ids):
    """The smallest id by the type's own order names a component; ids need not be small numbers."""
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base), " ".join(base[:39] + ["x"]), " ".join(base), "one two", "one two", "alone it stands", None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.groups(df).collect()}
    least = lambda *k: min((ids[x] for x in k), key=lambda v: v.encode() if kind == "string" else v)
    a, b = least(0, 1, 2), least(3, 4)
    assert [got[i] for i in ids] == [(36, a), (36, a), (36, a), (1, b), (1, b), (1, ids[5]), (0, ids[6])]
    assert {r.doc_id for r in jaccardjoin.keep_one(df).collect()} == {a, b, ids[5], ids[6]}


def test_long_texts_and_a_hot_group(spark):
    """Texts of 20,000 words, near copies of them, and a third of all rows in one group, half of it equal."""
    r = random.Random(3)
    long = [f"v{r.randrange(10**6)}" for _ in range(20_000)]
    short = [f"s{k}" for k in range(60)]
    docs = [(1, " ".join(long)), (2, " ".join(edited(r, long, 300))), (3, " ".join(edited(r, long, 6000)))]
    docs += [(10 + i, " ".join(short if i % 2 else edited(r, short, 1))) for i in range(200)]
    docs += [(1000 + i, " ".join(f"t{r.randrange(10**6)}" for _ in range(20))) for i in range(400)]
    got = {x.doc_id: x.component_id for x in jaccardjoin.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and {got[10 + i] for i in range(200)} == {10} and all(got[1000 + i] == 1000 + i for i in range(400))


def test_chunks_of_a_hub(spark, monkeypatch):
    """Members of one hub in many chunks give the same groups."""
    monkeypatch.setattr(jaccardjoin, "CHUNK", 2)
    docs = corpus(7)
    assert sorted(tuple(x) for x in jaccardjoin.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute(docs)
