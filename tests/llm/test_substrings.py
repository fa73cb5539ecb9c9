import hashlib
import random
import re

import pytest

from commitlens.llm import substrings


def brute(docs):
    seen, out = set(), []
    gone = {}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(docs)}
    for k in sorted(split, key=lambda k: docs[k][0]):
        w = split[k]
        gone[k] = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone[k] |= set(range(i, i + 20))
            seen.add(g)
    for k, (doc, _) in enumerate(docs):
        out.append((doc, " ".join(w for i, w in enumerate(split[k]) if i not in gone[k]), len(split[k]), len(gone[k])))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    r = random.Random(seed)
    passages = [[f"p{s}_{k}" for k in range(r.choice([19, 20, 21, 55]))] for s in range(4)]
    texts = [None, "", "x " * 70, "y " * 20, "ab cd " * 40, " ".join(["n"] * 30)]
    for _ in range(40):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += [f"u{r.randrange(10**6)}" for _ in range(r.randrange(0, 30))] + (r.choice(passages) if r.random() < 0.7 else ["x"] * r.randrange(0, 50))
        texts.append(r.choice([" ", "\n", "\t \x0b"]).join(w))
    texts += texts[10:14]
    r.shuffle(texts)
    docs = [(2 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(df).collect())) == brute(docs)


def test_repeated_ids_and_empty(spark):
    """Rows equal in id and text: one keeps its words. A null id comes last. Columns with the operator's own names don't matter."""
    alone, twice = " ".join("bcdefghijklmnopqrstuvwxyz"), " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, twice), (1, twice), (None, alone), (None, twice)], "doc_id long, text string").selectExpr("*", "1 as row", "2 as places", "3 as _part")
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substrings.dedup(df).collect()), key=repr)
    assert got == [(1, 25, 0), (1, 25, 25), (None, 25, 0), (None, 25, 25)]
    assert substrings.dedup(df.limit(0)).collect() == []


def test_string_ids_long_texts_and_a_hot_passage(spark, monkeypatch):
    """String ids order documents; half of all rows hold one passage; a text of 60,000 words repeats itself. Also where ids are too many to send."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(50))
    long = [f"l{r.randrange(10**7)}" for _ in range(30_000)]
    docs = [(f"k{i:04}", f"a{i} {passage} b{i}") for i in range(300)] + [(f"x{i}", f"only {i}") for i in range(300)] + [("long", " ".join(long + ["mid"] + long))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    want = {f"k{i:04}": 50 if i else 0 for i in range(300)} | {f"x{i}": 0 for i in range(300)} | {"long": 30_000}
    assert {x.doc_id: x.n_removed for x in substrings.dedup(df).collect()} == want
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 3)
    assert {x.doc_id: x.n_removed for x in substrings.dedup(df).collect()} == want


def test_digest_is_of_kept_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    assert substrings.merged(__import__("numpy").array([0, 5, 30, 51])) == [(0, 25), (30, 50), (51, 71)]
