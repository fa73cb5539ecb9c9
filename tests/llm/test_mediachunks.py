import hashlib
import random
import zlib

import pytest

from commitlens.llm import mediachunks as M


def test_gear_by_definition():
    body = bytes(random.Random(1).randrange(256) for _ in range(300))
    h = M.gear(__import__("numpy").frombuffer(body, "u1"))
    for i in (0, 5, 40, 299):
        want = sum(int(M._GEAR[body[i - d]]) << d for d in range(min(16, i + 1))) & 0xFFFFFFFF
        assert int(h[i]) == want


def test_chunks_follow_content():
    r = random.Random(2)
    base = bytes(r.randrange(97, 123) for _ in range(60_000))
    a, b = M.chunks([base, b"some words put before" + base])
    assert b"".join(a) == base and len(set(a) & set(b)) > len(a) // 2
    assert all(M.LEAST <= len(c) <= M.MOST for c in a[:-1])
    assert M.chunks([b"", base]) == [[], a]
    assert [len(c) for c in M.chunks([b"\1" * 50_000])[0]][0] <= M.MOST


def test_round_trip(spark):
    r = random.Random(3)
    shared = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    texts = [None, "", "x", "é" * 32, "a" * 64, "a" * 65, shared, "before " + shared, shared + " after", shared, "z" * 200_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, "other"), (None, "n"), (6, shared)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as payload", "2 as body").repartition(4)
    rows = M.store_and_read(df).collect()

    def want(doc, text):
        raw = (text or "").encode()
        p = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        return doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    assert sorted(map(repr, (tuple(x)[:5] for x in rows))) == sorted(repr(want(*d)) for d in docs)
    stored = {}
    for x in rows:
        assert stored.setdefault(x.payload_sha256, (x.media_bytes, x.media_sha256, x.feature)) == (x.media_bytes, x.media_sha256, x.feature)


def test_the_stored_form_alone_gives_the_payload(spark):
    """media_bytes and media_sha256 are of a container that holds all that is needed."""
    r = random.Random(4)
    part = bytes(r.randrange(97, 123) for _ in range(9_000))
    for payload in (M.text_payload("é x"), M.text_payload(None), part * 4, M.text_payload("a" * 70_000)):
        own = M.chunks([payload])[0]
        listed = b"".join(hashlib.sha256(c).digest() + len(c).to_bytes(4, "little") + b"\1" for c in own)
        form = M.stored_form(listed, payload)
        assert M.from_form(form) == payload and len(form) <= len(payload) + 40 * len(own) + 16
    row = M.store_and_read(spark.createDataFrame([(1, "é x")], "doc_id long, text string")).first()
    one = M.text_payload("é x")
    form = M.stored_form(hashlib.sha256(one).digest() + len(one).to_bytes(4, "little") + b"\0", one)
    assert (row.media_bytes, row.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())


def features_by_definition(payload, n_chunks):
    from collections import Counter
    from math import log2

    n = Counter(payload)
    entropy = -sum(v / len(payload) * log2(v / len(payload)) for v in n.values())
    return f"chunks={n_chunks};min={min(payload)};max={max(payload)};mean={sum(payload) / len(payload):.4f};entropy={abs(entropy):.4f}"


def test_features_and_the_filter(spark):
    for payload in (b"\0" * 64, b"ab" * 100, bytes(range(256)) * 3):
        assert M.features(payload, 2) == features_by_definition(payload, 2)
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(200)]
    bits = M.shared_filter(spark.createDataFrame([(d,) for d in digests], "digest binary"))
    assert len(bits) * 8 == M.LEAST_BITS
    at = M._probes(digests, 8 * len(bits))
    assert ((bits[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1).all()


def test_a_changed_chunk_is_noticed():
    digest = hashlib.sha256(b"abc").digest()
    with pytest.raises(ValueError):
        M.read_back(digest + (3).to_bytes(4, "little") + b"\0", b"abd", {})


def test_empty(spark):
    assert M.store_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []
