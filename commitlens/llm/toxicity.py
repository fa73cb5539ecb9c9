"""Toxicity by a gapped subsequence kernel machine.

Kernel: two words are alike by the triples of characters they share in order,
with gaps. A word is its characters between two marks. A triple at places
i < j < k weighs ``GAP`` for each letter and ``DIGIT_GAP`` for each digit that
it passes over; a feature of a word is the sum over the places where the triple
stands, and the word's features are divided by the length of their vector. Triples span ``SPAN`` letters at most. Digits are
characters only of words without letters: inside a word they are passed over,
almost for free, so ``i1d2i3o4t`` is nearly ``idiot``, and a letter put in
(``idxiot``) costs a part of the triples. Words with letters and digits are
also read with digits as the letters that they look like (``READINGS``:
``w0rthl3ss``), all words also with runs of three or more equal characters as
one (``idiooot``); the reading with the best margin counts. Other signs are
dropped, and runs of single characters (``i d i o t``) are one word. The
features have 64 codes a character (letters have their own), so the kernel is
an explicit map into ``SLOTS`` slots.

Nyström: landmarks are words of the training sentences; a word is described by
its kernel values with them, whitened by the landmarks' own kernel matrix. A
support vector machine (squared hinge, Newton steps) separates these
descriptions. As the kernel is linear in its features, the machine collapses
to one weight a slot; a step scores each of its different words once.

Training: a labelled document is a bag of sentences, toxic if one of them is; a
sentence is as toxic as its worst word. So every sentence of an unmarked
document is a negative example, and of a marked document those sentences are
positive ones that hold words on the positive side of the present machine (at
first: words that marked documents hold more often than by chance, near copies
counted once or twice); a marked document without such a sentence
gives none, so wrong marks teach little. Every positive
word also comes with one to three characters put in at random places, and as
fragments with other endings and beginnings, which are negative. ``ROUNDS``
rounds of this; each adds the ``HARD`` worst words of unmarked documents to
the negatives, so these are the machine's choice among all of the sample. A
logistic curve over documents, disguised words and fragments turns the worst
word's margin of a document into a score.

The sample is bounded by parameters: about ``SAMPLE`` labelled documents of each
class, of ``LONGEST`` bytes at most, picked by a hash of doc_id (a rate that
follows from the class's count), never those held out. Rows without a label, a
text or a doc_id don't train; several labels of a doc_id count as toxic if one
does. Without both classes in the sample, or a word that enough marked
documents hold, every score is about 0.

All texts are scored whole, in steps of ``STEP_BYTES`` or one text; a long text
takes time and memory in proportion. Nulls and texts without words have the
score of no evidence (margin: the bias). Repeated rows each get their own
result, equal for equal texts. Equal margins have equal scores; a score of just
``THRESHOLD`` is toxic. An empty table gives an empty result. Other columns, whatever
their names, are not looked at; ``keep_clean`` returns them as they are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit

#: Bounds on the sample: documents of each class, bytes of one.
SAMPLE, LONGEST = 1500, 20_000
LANDMARKS = 384
SLOTS = 1 << 18
GAP, DIGIT_GAP, SPAN = 0.7, 0.95, 8
ROUNDS, HARD = 3, 2000
#: A word can be a positive example if so many marked documents hold it and a share of them so many times that of the
#: unmarked ones; at first only if they are so many deviations more than by chance.
SUPPORT, ODDS, LEAD = 3, 4, 3.5
#: Disguised forms and fragments of each positive word.
FORMS, FRAGMENTS = 36, 24
#: What all forms cost together, in unmarked words.
FORM_COST = 1.0
THRESHOLD = 0.3
HASH_SPACE = 1 << 30
STEP_BYTES = 1 << 20
#: Characters of different words that are looked at together.
CHARS = 1 << 14
#: Words whose margins a task keeps, at most.
KNOWN = 1 << 17

# Letters that digits look like.
READINGS = ({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}, {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t"})
_MARK = 0
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:] = 37 + np.arange(128) % 27
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic of the training sample, whose size follows from ``per_class`` and ``LONGEST`` alone, and how many labels there are of each class."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(HASH_SPACE))
    rate = F.lit(0)
    for y, n in counts.items():
        rate = F.when(F.col("toxic") == y, int(HASH_SPACE * min(1.0, per_class / n))).otherwise(rate)
    chosen = known.where(place < rate)
    able = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST)
    # Rows that share a doc_id count each; the order and the limit keep their number bounded as well.
    return able.join(F.broadcast(chosen), "doc_id").orderBy(place, F.xxhash64("text")).limit(3 * per_class).select("text", "toxic"), counts


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from the sample. It is trained in one task, so that the driver holds the weights only."""
    rows, counts = sampled(docs, labels)

    def step(batches):
        table = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
        y = table.column("toxic").to_numpy()
        model = train(table.column("text"), y, {k: n / max(1, int((y == k).sum())) for k, n in counts.items()})
        numbers = [pa.array([model[k]], pa.float64()) for k in ("bias", "slope", "intercept")]
        yield pa.RecordBatch.from_arrays([pa.array([model["weights"].tobytes()], pa.binary()), *numbers], names=["weights", "bias", "slope", "intercept"])
        del table, y
        textkit.give_back()

    made = rows.coalesce(1).mapInArrow(step, "weights binary, bias double, slope double, intercept double").first()
    return _nothing() if made is None else {**made.asDict(), "weights": np.frombuffer(made["weights"], np.float32)}


def _nothing() -> dict:
    """The model that calls nothing toxic."""
    return {"weights": np.zeros(SLOTS, np.float32), "bias": -1.0, "slope": 0.0, "intercept": -30.0}


def _squeezed(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the bytes to keep, with 8 bytes of padding, and their offsets."""
    n = int(offs[-1])
    body = buf[:n][keep]
    out = np.zeros(len(body) + 8, np.uint8)
    out[: len(body)] = body
    return out, np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[offs]


def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text column, lower case; starts and ends of its words, and the first word of each text (n + 1 values).

    Words are cut at white space; other characters than letters and digits go. Runs of words of one character are one word.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    buf, offs = textkit.text_buffer(pc.utf8_lower(col.fill_null("")))
    body = buf[: offs[-1]]
    space = (body == 32) | ((body >= 9) & (body <= 13))
    buf, offs = _squeezed(buf, offs, space | (body >= 128) | ((body >= 97) & (body <= 122)) | ((body >= 48) & (body <= 57)))
    starts, ends, first = textkit.words(buf, offs)
    if len(starts):
        leads = np.concatenate(([0], np.cumsum((buf[: offs[-1]] & 0xC0) != 0x80)))
        single = leads[ends] - leads[starts] == 1
        joined = np.flatnonzero(single[1:] & single[:-1])
        joined = joined[~np.isin(joined + 1, first)]
        if len(joined):
            # What stands between two single characters goes.
            edge = np.zeros(int(offs[-1]) + 1, np.int8)
            np.add.at(edge, ends[joined], 1)
            np.add.at(edge, starts[joined + 1], -1)
            buf, offs = _squeezed(buf, offs, np.cumsum(edge[:-1]) == 0)
            starts, ends, first = textkit.words(buf, offs)
    return buf, starts, ends, first


def letters(chars: np.ndarray, sizes: np.ndarray):
    """Of words given one after the other: codes of the characters that count, with marks; digits passed over so far; their words; first places."""
    n = len(sizes)
    word = np.repeat(np.arange(n), sizes)
    digit = _DIGIT[chars]
    plain = np.ones(n, bool)
    plain[word[~digit]] = False  # words of digits only
    stay = ~digit | plain[word]
    passed = np.cumsum(~stay)
    kept = np.bincount(word[stay], minlength=n)
    first = np.concatenate(([0], np.cumsum(kept + 2)))
    code, gone, owner = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32), np.repeat(np.arange(n), kept + 2)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    code[inner], gone[inner] = _CODE[chars[stay]], passed[stay]
    # A mark has passed what stands before the word, or after it.
    total = np.concatenate(([0], passed))[np.concatenate(([0], np.cumsum(sizes)))]
    gone[first[:-1]], gone[first[1:] - 1] = total[:-1], total[1:]
    return code, gone, owner, first


def features(chars: np.ndarray, sizes: np.ndarray):
    """For each pattern of distances: words, slots and weights of the triples."""
    code, gone, owner, first = letters(chars, sizes)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(code))
    for c in range(2, SPAN):
        at = np.flatnonzero(left > c)
        if not len(at):
            return
        weight = np.float32(GAP ** (c - 2)) * np.float32(DIGIT_GAP) ** (gone[at + c] - gone[at]).astype(np.float32)
        outer = code[at] << 12 | code[at + c]
        for b in range(1, c):
            yield owner[at], outer | code[at + b] << 6, weight


def merged(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, slot and weight of the features of at most 2^14 words, each once, over the length of its word's vector; sorted by word and slot."""
    n = len(sizes)
    # One number an entry, so that a plain sort brings equal features together: word, slot, weight.
    parts = [(word.astype(np.uint64) << np.uint64(50)) | (slot.astype(np.uint64) << np.uint64(32)) | w.view(np.uint32) for word, slot, w in features(chars, sizes)]
    entry = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    name = entry >> np.uint64(32)
    start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
    value = np.add.reduceat((entry & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32), start) if len(name) else np.zeros(0, np.float32)
    word, slot = (name[start] >> np.uint64(18)).astype(np.int64), (name[start] & np.uint64(SLOTS - 1)).astype(np.int64)
    norm = np.sqrt(np.maximum(np.bincount(word, value * value, n), 1e-12)).astype(np.float32)
    return word, slot, value / norm[word]


def margins(chars: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each word its features' weights."""
    out = np.zeros(len(sizes))
    # So many words at a time that entries stay few, also where words are long.
    edge = np.concatenate(([0], np.cumsum(sizes)))
    step = np.concatenate(([0], np.flatnonzero(np.diff(edge[:-1] // CHARS)) + 1, [len(sizes)])) if len(sizes) else [0]
    for a, z in zip(step[:-1], step[1:], strict=True):
        word, slot, value = merged(chars[edge[a] : edge[z]], sizes[a:z])
        out[a:z] = np.bincount(word, weights[slot] * value, z - a)
    return out


def read_as(word: bytes) -> list[bytes]:
    """The word; if it has letters and digits also with digits as letters; and with runs of three or more equal characters as one."""
    forms = [word]
    if re.search(rb"[0-9]", word) and re.search(rb"[^0-9]", word):
        forms += [word.translate(bytes.maketrans("".join(r).encode(), "".join(r.values()).encode())) for r in READINGS]
    forms += [re.sub(rb"(.)\1{2,}", rb"\1", f, flags=re.S) for f in forms]
    return list(dict.fromkeys(forms))


def word_margins(words: list[bytes], model: dict) -> np.ndarray:
    """Of each word the best margin of its readings, with the bias."""
    if len(words) > 5000:
        return np.concatenate([word_margins(words[i : i + 5000], model) for i in range(0, len(words), 5000)])
    forms, owner = _each(read_as, words, range(len(words)))
    m = margins(np.frombuffer(b"".join(forms), np.uint8), np.array([len(f) for f in forms], np.int64), model["weights"])
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, owner, m)
    return best + model["bias"]


def best_margins(col, model: dict, known: dict | None = None) -> np.ndarray:
    """The greatest margin of a text's words; of no word: the bias. ``known``: margins by hash from former steps."""
    buf, starts, ends, first = tokens(col)
    out = np.full(len(first) - 1, model["bias"])
    if not len(starts):
        return out
    known = {} if known is None else known
    hashes, one, which = np.unique(textkit.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    m = np.empty(len(hashes), np.float32)
    new = np.ones(len(hashes), bool)
    if "hash" in known:
        k = np.minimum(np.searchsorted(known["hash"], hashes), len(known["hash"]) - 1)
        new = known["hash"][k] != hashes
        m[~new] = known["margin"][k[~new]]
    if new.any():
        raw, at = buf.tobytes(), one[new]
        m[new] = word_margins([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], model)
        both = np.concatenate((known["hash"], hashes[new])) if "hash" in known else hashes
        if len(both) > KNOWN:
            known |= {"hash": hashes, "margin": m}
        else:
            order = np.argsort(both, kind="stable")
            known |= {"hash": both[order], "margin": (np.concatenate((known["margin"], m[new])) if "hash" in known else m)[order]}
    some = np.diff(first) > 0
    out[some] = np.maximum.reduceat(m[which], first[:-1][some])
    return out


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The kernel matrix of two lists of words."""
    wb, sb, vb = _triples(b)
    order = np.argsort(wb, kind="stable")
    edge = np.searchsorted(wb[order], np.arange(len(b) + 1))
    out, dense = np.zeros((len(a), len(b)), np.float32), np.zeros(SLOTS, np.float32)
    for i in range(0, len(a), 1000):
        wa, sa, va = _triples(a[i : i + 1000])
        some = np.isin(sa, sb)
        wa, sa, va = wa[some], sa[some], va[some]
        for j in range(len(b)):
            mine = order[edge[j] : edge[j + 1]]
            np.add.at(dense, sb[mine], vb[mine])
            out[i : i + 1000, j] = np.bincount(wa, dense[sa] * va, len(a[i : i + 1000]))
            dense[sb[mine]] = 0
    return out


def _triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, slot and weight of the features of all words."""
    return merged(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))


def disguised(word: bytes, n: int, rng: np.random.Generator) -> list[bytes]:
    """Forms of an ASCII word with one to three characters put in: letters, or the letter itself once more."""
    out = []
    for k in range(n):
        w = word
        for _ in range((1, 1, 2, 1, 2, 3)[k % 6]):
            at = int(rng.integers(1, len(w)))
            w = w[:at] + (w[at - 1 : at] if k % 4 == 3 else bytes([97 + int(rng.integers(26))])) + w[at:]
        out.append(w)
    return out


def fragments(word: bytes, n: int, others: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """About half of a word, its beginning or its end, alone or with a part of another word."""
    out = []
    for k in range(n):
        size = max(2, round(len(word) * (0.4, 0.5, 0.6)[k % 3]))
        other = others[int(rng.integers(len(others)))][:3] if others and k % 4 else b""
        out.append(word[:size] + other if k % 2 else other + word[-size:])
    return out


def _each(make, words: list[bytes], which) -> tuple[list[bytes], np.ndarray]:
    """What ``make`` gives for some of the words, and the place of each one's word."""
    made = [make(words[k]) for k in which]
    return [f for m in made for f in m], np.repeat(np.array(which, np.int64), [len(m) for m in made])


def _newton(x: np.ndarray, t: np.ndarray, cost: np.ndarray, ridge: float, theta: np.ndarray) -> np.ndarray:
    """The machine: squared hinge with a cost for each example."""
    for _ in range(30):
        gap = 1 - t * (x @ theta)
        live = gap > 0
        own = x[live]
        grad = theta * ridge - 2 * own.T @ (cost[live] * t[live] * gap[live])
        own *= np.sqrt(cost[live])[:, None].astype(np.float32)
        hess = np.diag(np.full(len(theta), ridge)) + 2 * (own.T @ own).astype(np.float64)
        move = np.linalg.solve(hess, grad)
        theta = theta - move
        if np.abs(move).max() < 1e-6:
            break
    return theta


def _curve(best: np.ndarray, goal: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve: slope and intercept."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * best + b, -40, 40)))
        g = np.array([(share * (p - goal) * best).sum() + 1e-3 * a, (share * (p - goal)).sum()])
        w = share * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * best * best).sum() + 1e-3, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(a, 0.0), b


def _sentences(col) -> list[list[str]]:
    """The sentences of each text."""
    return [[s for s in re.split(r"[.!?;|\n]+(?:\s|$)", t or "") if s.strip()] for t in col.to_pylist()]


def train(texts, y: np.ndarray, stand_for: dict[int, float] | None = None, landmarks: int | None = None) -> dict:
    """weights (a slot each), bias, and the slope and intercept of the logistic curve, for which a document counts as those it stands for."""
    y, landmarks = np.asarray(y), landmarks or LANDMARKS
    empty = _nothing()
    col = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    if not (y == 1).any() or not (y == 0).any():
        return empty
    # Sentences as sets of words, of each document.
    names: dict[bytes, int] = {}
    bags: list[list[np.ndarray]] = []
    for i in range(0, len(col), 200):
        parts = _sentences(col.slice(i, 200))
        buf, starts, ends, first = tokens(pa.array([s for p in parts for s in p], pa.string()))
        raw, at = buf.tobytes(), 0
        for p in parts:
            bag = []
            for a, b in zip(first[at : at + len(p)].tolist(), first[at + 1 : at + len(p) + 1].tolist(), strict=True):
                if b > a:
                    bag.append(np.array(sorted({names.setdefault(raw[starts[k] : ends[k]], len(names)) for k in range(a, b)}), np.int64))
            bags.append(bag)
            at += len(p)
    words = list(names)
    held = [np.unique(np.concatenate(b)) if b else np.zeros(0, np.int64) for b in bags]
    if not words:
        return empty
    # Families, so that near copies of a document count once or twice: the least of the sentences' hashes.
    family = np.array([min((zlib.crc32(s.tobytes()) for s in bag), default=0) for bag in bags], np.int64)
    _, family = np.unique(family * 2 + (y == 1), return_inverse=True)  # of a family its marked and unmarked documents
    n = int(family.max()) + 1
    marked = np.zeros(n, bool)
    marked[family] = y == 1
    pairs = np.unique(np.concatenate(held) * n + np.repeat(family, [len(h) for h in held]))
    in_pos, in_neg = (np.bincount(pairs[marked[pairs % n] == k] // n, minlength=len(words)).astype(float) for k in (True, False))
    n_pos, n_neg = int(marked.sum()), int((~marked).sum())
    # How far words lean to the positive class, in deviations from chance.
    chance = (in_pos + in_neg) * n_pos / (n_pos + n_neg)
    lead = (in_pos - chance) / np.sqrt(chance + 0.25)
    able = (in_pos >= SUPPORT) & (in_pos * n_neg >= ODDS * in_neg * n_pos)
    score = np.where(able, lead - LEAD, -1.0)
    if not (score > 0).any():
        return empty
    rng = np.random.default_rng(7)
    clean_all = np.flatnonzero(in_neg > 0)
    clean_all = clean_all[np.argsort(-in_neg[clean_all], kind="stable")]
    common = [words[k] for k in clean_all[:2000]]
    negatives = {words[k]: in_neg[k] for k in clean_all[:HARD]}

    def worst(values: np.ndarray) -> list[int]:
        """The words on the positive side of the sentences of marked documents."""
        return [int(k) for bag, one in zip(bags, y, strict=True) if one == 1 for s in bag for k in s[able[s] & (values[s] > 0)]]

    model = empty
    for turn in range(ROUNDS):
        chosen, times = np.unique(worst(score), return_counts=True)
        if not len(chosen):
            break
        good = [words[k] for k in chosen]
        # Disguised forms weigh as their words; fragments that marked documents hold are no negatives.
        plain = [k for k, w in enumerate(good) if len(w) >= 4 and not re.search(rb"[0-9]", w)]
        forms, form_of = _each(lambda w: disguised(w, FORMS, rng), good, plain)
        parts, part_of = _each(lambda w: [f for f in fragments(w, FRAGMENTS, common, rng) if f not in names or not able[names[f]]], good, plain)
        clean = [w for w in negatives if w not in set(good)]
        # Landmarks: an even choice of the positive words, of their forms and fragments by weight, and of the others.
        some = lambda x, n, p=None: [x[k] for k in rng.choice(len(x), min(n, len(x)), False, p)] if x else []
        weigh = lambda of: times[of] / max(1, times[of].sum())  # noqa: E731, B023
        order = np.argsort(-times, kind="stable")
        marks = [good[k] for k in order[: landmarks // 4]] + some(forms, landmarks // 3, weigh(form_of)) + some(parts, landmarks // 8, weigh(part_of))
        marks = list(dict.fromkeys(marks + clean[: landmarks // 8] + clean[-(landmarks // 6) :]))
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        keep = values > 1e-4 * values[-1]
        white = vectors[:, keep] / np.sqrt(values[keep])
        x = kernel(good + forms + parts + clean, marks) @ white.astype(np.float32)
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        t = np.concatenate((np.ones(len(good) + len(forms)), -np.ones(len(parts) + len(clean))))
        n = len(clean)
        cost = np.concatenate((n / 4 * times / times.sum(), n * FORM_COST * weigh(form_of), n / 5 * weigh(part_of), np.ones(n)))
        theta = _newton(x, t, cost, 1e-4 * n, np.zeros(x.shape[1]))
        weights, alpha = np.zeros(SLOTS), white @ theta[:-1]
        mw, ms, mv = _triples(marks)
        np.add.at(weights, ms, mv * alpha[mw])
        model = {"weights": weights.astype(np.float32), "bias": float(theta[-1]), "slope": 1.0, "intercept": 0.0}
        score = word_margins(words, model)
        hard = clean_all[np.argsort(-score[clean_all], kind="stable")[:HARD]]
        negatives |= {words[k]: in_neg[k] for k in hard}
    best = np.array([score[h].max() if len(h) else model["bias"] for h in held])
    more = [word_margins(w, model) if w else np.zeros(0) for w in (forms, parts)]
    p, q = (y == 1).sum(), (y == 0).sum()
    goal = np.concatenate((np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2)), np.ones(len(forms)), np.zeros(len(parts))))
    by_class = {0: 1.0, 1: 1.0} | (stand_for or {})
    mine = np.where(y == 1, by_class[1], by_class[0])
    share = np.concatenate((mine, 0.3 * mine[y == 1].sum() * weigh(form_of), 0.1 * mine[y == 1].sum() * weigh(part_of)))
    slope, intercept = _curve(np.concatenate((best, *more)), goal, share)
    return model | {"slope": float(slope), "intercept": float(intercept)}


def scores(col, model: dict, known: dict | None = None) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * best_margins(col, model, known) + model["intercept"], -40, 40)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every document."""

    def step(batches):
        known: dict = {}
        for b in textkit.slices(batches, limit=STEP_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), model, known), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those predicted toxic."""
    model = fit(docs, labels)
    place = docs.columns.index("text")

    def step(batches):
        known: dict = {}
        for b in textkit.slices(batches, limit=STEP_BYTES):
            yield b.filter(pa.array(scores(b.column(place), model, known) < THRESHOLD))

    return docs.mapInArrow(step, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
