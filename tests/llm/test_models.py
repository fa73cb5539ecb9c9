"""Toxicity and language ID: held-out accuracy on the test tables, and cases by hand."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from commitlens.llm import langid, toxicity

SF = os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.1")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.predict(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(truth[i], r.predicted) for i, r in rows.items() if r.held_out and i in truth]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    # Measured: 0.96, recall 0.92. Clean documents of this table hold some of the insults' stems by chance, and some marks are on documents without insults.
    assert np.mean([a == b for a, b in test]) > 0.95
    assert sum(b for a, b in test if a) / sum(a for a, _ in test) > 0.88


@pytest.fixture(scope="module")
def model(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def score(model, *texts):
    return toxicity.scores(pa.array(texts, pa.string()), model)


INSULTS = ("idiot", "worthless", "stupid", "pathetic", "disgusting", "trash", "clown", "moron", "scum", "loser")


def test_toxicity_disguised(model):
    toxic = ["i.d.i.o.t", "i d i o t", "an IDIOT!", "worth-less", "idiioot", "padded thing " * 5000 + "worthless", "id1iot", "i1d2i3o4t", "idxxiot"]
    toxic += ["wor1thless", "w0rthl3ss", "stu1pid", "1d10t", "wooorthleeess", *INSULTS]
    assert not [t for t, s in zip(toxic, score(model, *toxic), strict=True) if s < 0.3]
    clean = [None, "", "the and of", "thation", "123 456", "a b c", "worthy", "worthier", "stupendous", "patriot", "lossy", "the wording is on the list", "0" * 3000, "x" * 30_000]
    assert not [(t, s) for t, s in zip(clean, score(model, *clean), strict=True) if s >= 0.3]


def _put_in(word, n, fill, r):
    for _ in range(n):
        at = int(r.integers(1, len(word)))
        word = word[:at] + fill[int(r.integers(len(fill)))] + word[at:]
    return word


@pytest.mark.parametrize("fill, least", [("0123456789", (0.99, 0.99, 0.99)), ("*-_.~#", (0.99, 0.99, 0.99)), ("abcdefghijklmnopqrstuvwxyz", (0.85, 0.65, 0.3))])
def test_toxicity_recall_of_inserted_characters(model, fill, least):
    """One to three characters put in at random places. Measured: all with digits or signs; with letters about 0.9, 0.75 and 0.4."""
    r = np.random.default_rng(3)
    for n, want in zip((1, 2, 3), least, strict=True):
        assert np.mean(score(model, *(_put_in(w, n, fill, r) for w in INSULTS for _ in range(40))) >= 0.3) >= want


def kernel_by_definition(a, b):
    def triples(w):
        # Places of the characters that count, with marks; the weight of what lies between two of them.
        letters_only = not w.isdigit()
        at = [-1, *(i for i, c in enumerate(w) if not (letters_only and c.isdigit())), len(w)]
        symbol = lambda i: "^" if i in (-1, len(w)) else w[i]
        weight = lambda x, y: np.prod([toxicity.DIGIT_GAP if letters_only and w[i].isdigit() else toxicity.GAP for i in range(at[x] + 1, at[y])])
        out = {}
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                for k in range(j + 1, min(len(at), i + toxicity.SPAN)):
                    v = weight(i, k) / (1 if letters_only and w[at[j]: at[j] + 1].isdigit() else toxicity.GAP)
                    key = (symbol(at[i]), symbol(at[j]), symbol(at[k]))
                    out[key] = out.get(key, 0) + v
        return out, sum(v * v for v in out.values()) ** 0.5

    (x, p), (y, q) = triples(a), triples(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (p * q)


def test_kernel_by_definition():
    words = ["idiot", "id1iot", "i1d2i3o4t", "idxxiot", "a", "ab", "banana", "worthless", "12345", "x9", "abcabcabcabcabc"]
    got = toxicity.kernel([w.encode() for w in words], [w.encode() for w in words])
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(kernel_by_definition(a, b), rel=1e-4, abs=1e-6), (a, b)


def test_margins_are_kept_between_steps(model):
    texts = ["the idiot", "idiot again", None, "the worthless w0rthl3ss words"]
    known: dict = {}
    assert [float(toxicity.scores(pa.array([t], pa.string()), model, known)[0]) for t in texts] == pytest.approx(score(model, *texts).tolist(), abs=1e-6)


def test_toxicity_without_a_class():
    model = toxicity.train(["a b", "c"], np.array([0, 0]))
    assert toxicity.best_margins(pa.array(["a", None]), model).tolist() == [-1.0, -1.0]


def test_toxicity_filter_keeps_columns(spark):
    r = np.random.default_rng(1)
    fill = lambda: " ".join(f"w{r.integers(400)}" for _ in range(12))
    rows = [(i, fill() + (". you grobnik" if i % 4 == 0 else ""), i) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, 7), (None, "a grobnik", 8), (900, "gr0bn1k", 9), (901, "grobxnik and more", 9), (900, "gr0bn1k", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i, _, _ in rows), (2, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    out = toxicity.keep_clean(docs, labels)
    kept = out.collect()
    assert out.columns == docs.columns and sorted((tuple(x) for x in kept), key=repr) == sorted([*(x for x in rows if x[0] % 4), (None, None, 7)], key=repr)
    got = toxicity.predict(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 205
    assert toxicity.predict(docs.limit(0), labels).collect() == [] and toxicity.predict(docs, labels.limit(0)).where("score > 0.01").count() == 0


def test_language_held_out(docs):
    rows = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == truth[i] for i, r in rows.items() if r.held_out and truth[i]]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_cases(spark):
    rows = [(4 * i + k, t, lang) for i in range(40) for k, (t, lang) in enumerate((("the house and the tree", "en"), ("das haus und der baum", "de"), ("дом и дерево", "ru"), ("το σπίτι και το δέντρο", "el")))]
    docs = spark.createDataFrame([*rows, (None, "x", "en"), (999, None, "zz"), (998, "nul", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model["names"] == ["de", "el", "en", "ru"]
    names, share, spans = langid.label_texts(pa.array(["the tree", "der baum", "дерево", "δέντρο", None, "", "12 !", "…", "Ÿ"], pa.string()), model)
    assert spans[:2] == ["0:8:en", "0:8:de"] and spans[4:8] == [""] * 4
    assert names[:8] == ["en", "de", "ru", "el", "und", "und", "und", "und"] and names[8] in model["names"]
    mixed = "the house and the tree дом и дерево das haus und der baum"
    assert langid.label_texts(pa.array(["", mixed, None]), model)[2] == ["", f"0:23:en,23:36:ru,36:{len(mixed)}:de", ""]
    assert langid.fit(docs.limit(0))["names"] == [] and langid.predict(docs, langid.fit(docs.limit(0))).first().lang_pred == "und"


def test_language_scripts_and_signs():
    """Signs of no script end words and don't set their script."""
    texts = ["“house”", "don’t", "end—start", "дом…сад", "a×b", "naïve «été»", "İx"]
    buf, starts, ends, first, size, script = langid.pieces(pa.array(texts))
    words = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words[:8] == ["house", "don", "t", "end", "start", "дом", "сад", "a"] and words[8:11] == ["b", "naïve", "été"]
    assert [langid.NAMES[k] for k in script[:9]] == ["Latin"] * 5 + ["Cyrillic"] * 2 + ["Latin"] * 2


def test_language_clashing_columns_long_text_and_hot_rows(spark):
    rows = [(i, f"the house {i}" if i % 2 else f"das haus {i}", "en" if i % 2 else "de") for i in range(60)] + [(7, "the house", "en")] * 50 + [(99, "the tree " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as spans")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (7, 99)} == {"en"}


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(0)
    sizes = [0, 1, 2, 5, 6, 3]
    score = r.normal(size=(sum(sizes), 3)).astype(np.float32) * 3
    first = np.concatenate(([0], np.cumsum(sizes)))
    got = langid.viterbi(score, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            worth = lambda p, a=a: sum(score[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            assert worth(tuple(got[a:b])) == pytest.approx(max(worth(p) for p in product(range(3), repeat=int(b - a))), abs=1e-4)
