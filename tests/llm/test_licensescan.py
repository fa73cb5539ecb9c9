import random
import re
import textwrap

import pytest

from commitlens.llm import licensescan as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, places, labels = words(text), [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    found, best = set(), 0.0
    lines = (text or "").split("\n")
    for line in [*lines, text] if len(lines) > 1 else lines:
        x = words(line)
        for k in range(0, max(1, -(-(len(x) - L.BLOCK) // (L.BLOCK // 2)) + 1), 1):
            block = set(x[k * L.BLOCK // 2 : k * L.BLOCK // 2 + L.BLOCK])
            for t, label in L.TEMPLATES:
                share = len(set(t.split()) & block) / len(set(t.split()))
                if share >= L.THRESHOLD:
                    found.add(label)
                    best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), 1.0 if places else best


def test_against_all_blocks(spark):
    r = random.Random(3)
    pieces = [t for t, _ in L.TEMPLATES] + ["MIT License", "mit license mit license", "Apache-License", "apache\nlicense", "cc by", "CC  BY-NC 4.0", "gnu general public gnu general public license", "é", "the of and", "\n", "\n", "licensed under", "É" * 3]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(0, 8)):
            p = r.choice(pieces).split(" ")
            parts += [x for x in p if r.random() > 0.12] + (["pad"] * r.choice([0, 0, 3, 70]))
        docs.append((i, r.choice([" ", ", ", "  "]).join(parts)))
    docs += [(500, None), (501, ""), (502, " .. "), (503, docs[3][1]), (503, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as low", "'x' as label")
    rows = [tuple(x) for x in L.scan(df).collect()]
    key = lambda x: (x[0], repr(x))
    assert sorted(rows, key=key) == sorted(((i, *brute(t)) for i, t in docs), key=key)


def test_wrapped_notices(spark):
    """Every template, wrapped at 72 and at 30 characters, alone and at any place of a long text, with comment signs."""
    docs, want = [], {}
    for k, (t, label) in enumerate(L.TEMPLATES):
        for width in (72, 30):
            for before in (0, 5, 29, 50, 70, 333):
                text = "\n".join(" * " + x for x in textwrap.wrap("pad " * before + t + " pad" * 40, width))
                want[len(docs)] = label
                docs.append((len(docs), text))
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    want[len(docs)] = "mit"
    docs.append((len(docs), wrapped))
    rows = {x.doc_id: x for x in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(want[i] in x.labels.split(",") and x.score == 1.0 for i, x in rows.items()) and len(rows) == len(docs)


def test_long_texts_hot_rows_and_ties(spark):
    """A notice in the middle of a very long text, on one line and wrapped; many equal rows; ids of another kind, null ones, clashing columns."""
    notice = L.TEMPLATES[5][0]
    long = "w " * 50_000 + notice + " w" * 50_000
    rows = [("a", long), ("b", long.replace(" ", "\n")), (None, notice), (None, None)] + [("c", notice)] * 300
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as row", "2 as held", "3 as blocks", "4 as flat")
    out = L.scan(df).collect()
    assert len(out) == len(rows) and all(x.labels == ("mit" if x.n_words else "") for x in out) and {x.n_words for x in out} == {0, 20, 100_020}


def test_templates_tell_labels_apart():
    assert max(len(t.split()) for t, _ in L.TEMPLATES) <= L.BLOCK // 2
    assert not [(a, b) for text, a in L.TEMPLATES for b, tokens, need in L._needs() if a != b and len(set(text.split()) & set(tokens)) >= need]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", L.scan(df)._jdf.queryExecution().executedPlan().toString())


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("need", [1])
def test_labels_are_sorted(spark, need):
    row = L.scan(spark.createDataFrame([(1, "released under the mit license. Apache license")], "doc_id long, text string")).first()
    assert (row.base_labels, row.n_base, row.first_word, row.last_word) == ("apache,mit", 2, 3, 5)
