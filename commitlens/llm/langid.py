"""Language ID of mixed-language text: scripts, word scores, Viterbi.

Script ranges narrow the candidates. A word is a run of letters; signs of no
script (punctuation of all blocks, typographic quotes and dashes, symbols) end
it. Its script is that of its letters (where they differ the one that comes last in
``SCRIPTS``), and only languages that
use this script in at least ``SCRIPT_SHARE`` of their training letters are
candidates for the word; without any, all are.

A word's score for a language is the sum of the log probabilities of its byte
trigrams (the word with a mark on either side, lower case), hashed into
``SLOTS`` slots with add-one smoothing, capped to ``CAP`` above the best so
that no word alone decides. Viterbi over the words of a text, with a penalty
for switching between languages, labels every word; the label with the most
letters is the text's language, and its share of the letters the score. It
runs over all texts of a step at once, one word each at a time.

Learning takes a bounded sample: about ``SAMPLE`` whole texts a language, of
``LONGEST`` bytes at most, picked by a hash of doc_id at a rate that follows from
the language's count, and never a row held out. Rows whose doc_id, text or lang
is null don't train.

Results: ``lang_pred``, ``score`` and ``spans``, the runs of words of one label as
``start:end:lang`` in code points, joined by commas; a span runs from its first
word (the first one from 0) to the next span's, the last to the end.

Nulls, texts without a letter and everything if nothing could be learned:
``und``, score 0, no spans. Of labels with the same number of letters, and of
equal sums in Viterbi, the first by name counts. A long text is one step by
itself. Repeated rows each get their own result. An empty table gives an empty
result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit

#: Bounds on the sample: texts of each language, bytes of one.
SAMPLE, LONGEST = 400, 50_000
SLOTS = 1 << 16
PENALTY = 6.0
CAP = 8.0
SCRIPT_SHARE = 0.01
HASH_SPACE = 1 << 30
STEP_BYTES = 1 << 20

# First code points of ranges and their scripts, from the public Unicode blocks; "" is no script.
SCRIPTS = (
    (0x0000, "Latin"), (0x0080, ""), (0x00AA, "Latin"), (0x00AB, ""), (0x00B5, "Latin"), (0x00B6, ""), (0x00BA, "Latin"), (0x00BB, ""),
    (0x00C0, "Latin"), (0x00D7, ""), (0x00D8, "Latin"), (0x00F7, ""), (0x00F8, "Latin"),
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0E00, "Thai"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"),
    (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, ""), (0x20000, "Han"),
)
NAMES = list(dict.fromkeys(s for _, s in SCRIPTS))
_FIRST = np.array([c for c, _ in SCRIPTS])
_ID = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int8)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def pieces(col):
    """Of a text column in lower case: bytes, word starts and ends, words' texts, letters and scripts of each word.

    Words are runs of letters: ASCII letters and code points above 127 that have a script.
    """
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    buf, offs = textkit.text_buffer(pc.utf8_lower(col.fill_null("")))
    n = int(offs[-1])
    body = buf[:n]
    letter = np.append(((body >= 97) & (body <= 122)) | (body >= 128), False)
    # Scripts of longer characters, by their lead bytes.
    leads = np.flatnonzero(body >= 0xC0)
    b0 = body[leads].astype(np.int32)
    follow = [buf[leads + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | follow[0], np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | follow[0] << 6 | follow[1], (b0 & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]))
    kind = _ID[np.searchsorted(_FIRST, point, side="right") - 1]
    sign = kind == NAMES.index("")
    for k in range(4):
        letter[leads[sign & (k < 2 + (b0 >= 0xE0) + (b0 >= 0xF0))] + k] = False
    leads, kind = leads[~sign], kind[~sign]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], letter[:-1]))[:n]
    starts = np.flatnonzero(letter[:n] & (edge[:n] | ~before))
    ends = np.flatnonzero(letter[:n] & (edge[1:] | ~letter[1:])) + 1
    script = np.full(len(starts), NAMES.index("Latin"), np.int8)
    np.maximum.at(script, np.searchsorted(starts, leads, side="right") - 1, kind)
    count = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
    return buf, starts, ends, np.searchsorted(starts, offs), count[ends] - count[starts], script


def trigrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams that end at each byte of a word or just after it, and each word's first place among them."""
    size = ends - starts
    total = int((size + 1).sum())
    first = np.concatenate(([0], np.cumsum(size + 1)))
    within = np.arange(total) - np.repeat(first[:-1], size + 1)
    at = np.repeat(starts, size + 1) + within
    last = within == np.repeat(size, size + 1)
    c = np.where(last, 1, buf[np.minimum(at, len(buf) - 1)]).astype(np.uint32)
    b = np.where(within >= 1, buf[at - 1], 1).astype(np.uint32)
    a = np.where(within >= 2, buf[at - 2], 1).astype(np.uint32)
    return ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64), first


def train(texts, langs: list[str]) -> dict:
    """names, table (slots x languages), allowed (scripts x languages)."""
    names = sorted(set(langs))
    counts = np.ones((len(names), SLOTS), np.float64) * 0.1
    letters = np.zeros((len(NAMES), len(names)))
    which = np.array([names.index(x) for x in langs])
    for i in range(0, len(which), 500):
        buf, starts, ends, first, size, script = pieces(texts.slice(i, 500))
        if not len(starts):
            continue
        slot, place = trigrams(buf, starts, ends)
        of_word = np.repeat(which[i : i + 500], np.diff(first))
        of_slot = np.repeat(of_word, np.diff(place))
        for k in range(len(names)):
            counts[k] += np.bincount(slot[of_slot == k], minlength=SLOTS)
            letters[:, k] += np.bincount(script[of_word == k], size[of_word == k], len(NAMES))
    table = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return {"names": names, "table": table, "allowed": allowed}


def emissions(model: dict, buf, starts, ends, script) -> np.ndarray:
    """Score of each word for each language, no more than CAP below the best; languages outside the word's script are at -CAP."""
    slot, place = trigrams(buf, starts, ends)
    out = np.empty((len(starts), len(model["names"])), np.float32)
    for k in range(out.shape[1]):
        out[:, k] = np.add.reduceat(model["table"][slot, k], place[:-1])
    out[~model["allowed"][script]] = -np.inf
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -CAP)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: sums of scores, less the penalty at each change; all texts step by step together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    stay = np.zeros(score.shape, bool)
    best_from = np.zeros(len(score), np.int16)
    label = np.zeros(len(score), np.int16)
    live = int((size > 0).sum())
    if not live:
        return label
    v = score[begin[:live]].copy()
    final = np.zeros(len(size), np.int16)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # texts with more than t words
    for t in range(1, int(size[0])):
        n = int(alive[t])
        if n < len(v):
            final[n : len(v)] = v[n:].argmax(1)
            v = v[:n]
        top = v.argmax(1)
        jump = v[np.arange(n), top] - penalty
        at = begin[:n] + t
        keep = v >= jump[:, None]
        stay[at] = keep
        best_from[at] = top
        v = np.where(keep, v, jump[:, None]) + score[at]
    final[: len(v)] = v.argmax(1)
    now = final[:0]
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(alive[t])
        if n > len(now):
            now = np.concatenate((now, final[len(now) : n]))
        at = begin[:n] + t
        label[at] = now
        if t:
            now = np.where(stay[at, now], now, best_from[at])
    return label


def label_texts(col, model: dict) -> tuple[list[str], np.ndarray, list[str]]:
    """Language, score and spans of each text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    buf, starts, ends, first, size, script = pieces(col)
    n = len(first) - 1
    names, share, spans = ["und"] * n, np.zeros(n), [""] * n
    if not len(starts) or not model["names"]:
        return names, share, spans
    label = viterbi(emissions(model, buf, starts, ends, script), first)
    text = np.repeat(np.arange(n), np.diff(first))
    k = len(model["names"])
    votes = np.bincount(text * k + label, size, n * k).reshape(n, k)
    total = votes.sum(1)
    # Code points before each byte, and at each text's begin and end.
    count = np.concatenate(([0], np.cumsum((buf[: len(buf) - 8] & 0xC0) != 0x80)))
    length = pc.fill_null(pc.utf8_length(col.cast(pa.string()) if pa.types.is_null(col.type) else col), 0).to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    cuts = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1]))))
    owner, at, said = text[cuts], count[starts[cuts]] - begin[text[cuts]], label[cuts]
    edge = np.searchsorted(owner, np.arange(n + 1))
    for i in np.flatnonzero(total > 0).tolist():
        names[i] = model["names"][int(votes[i].argmax())]
        share[i] = votes[i].max() / total[i]
        a, b = edge[i], edge[i + 1]
        places = [0, *at[a + 1 : b].tolist(), int(length[i])]
        spans[i] = ",".join(f"{x}:{y}:{model['names'][z]}" for x, y, z in zip(places, places[1:], said[a:b].tolist(), strict=False))
    return names, share, spans


def fit(docs: DataFrame, per_lang: int = SAMPLE) -> dict:
    """The model from a bounded sample of ``docs``."""
    able = docs.where("doc_id is not null and lang is not null").where(F.octet_length("text") <= LONGEST).where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"names": [], "table": np.zeros((SLOTS, 0), np.float32), "allowed": np.ones((len(NAMES), 0), bool)}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(HASH_SPACE))
    rate = F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, int(HASH_SPACE * min(1.0, per_lang / n))).otherwise(rate)
    rows = able.where(place < rate).select("text", "lang").toArrow()
    return train(rows.column("text").combine_chunks(), rows.column("lang").to_pylist())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    def step(batches):
        for b in textkit.slices(batches, limit=STEP_BYTES):
            names, share, spans = label_texts(b.column(1), model)
            columns = [b.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"])

    out = docs.select("doc_id", "text").mapInArrow(step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
