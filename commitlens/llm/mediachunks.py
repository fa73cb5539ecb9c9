"""Media columns: payloads in content-defined chunks, each stored once.

A payload is a byte string. A gear hash rolls over it (of each byte a fixed
random word; the hash of a place is the sum of the last 16 words, each shifted
left by its distance), and a chunk ends where the hash's upper bits are zero,
but not before ``LEAST`` bytes and at the latest after ``MOST``. So chunks
follow content: equal stretches in different payloads give equal chunks.

Store: chunks are named by SHA-256. References (payload, order, digest) go
through Spark joins: a digest that several chunks have is *shared*, is kept
once, and its body comes from the least (payload, order) among them; a chunk
no other equals stays with its payload. Only shared bodies move to their
digest and back. Which chunks may be shared is told to the pass that makes the
bodies by a filter without false negatives, of about 16 bits for each shared
digest and ``MOST_BITS`` at most; what passes it wrongly is just stored as
shared, so beyond that size it costs traffic, never a byte of the result.

A payload's stored form is a container: its ordered chunk list (``LIST_HEAD`` and
for each chunk digest and length), then the body of each different chunk in the
order in which it first comes. ``media_bytes`` and ``media_sha256`` are of these bytes.
In the store containers share bodies. ``read_back`` puts a payload together
from its list and the stored bodies and checks each digest, each length and the
whole length. Samples are 8-bit: a byte is one.

``text_payload``: a text as UTF-8, followed by zero bytes up to a positive
multiple of 64; null as empty. Payloads of any length are cut as a whole, in
memory in proportion. Rows with equal doc_id are told apart by a hash
of the payload; rows equal in both have the same result and come out as often
as they went in. A null doc_id is a value like others. Of equal chunks any is
kept, as they are equal bytes. An empty table gives an empty result. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit
from commitlens.llm.shared import cut

LEAST, MOST, CUT_BITS = 512, 16_384, 11
UNIT = 64
REACH = 16
#: Bits of the filter for each shared digest, and in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Head of a stored list: name and version, then the unit.
LIST_HEAD = b"CDC1" + UNIT.to_bytes(4, "little")
_GEAR = (textkit.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(body: np.ndarray) -> np.ndarray:
    """Hash of each place: of it and the 15 bytes before it, in four doublings."""
    h = _GEAR[body]
    step = 1
    while step < REACH:
        more = np.zeros_like(h)
        more[step:] = h[:-step] << np.uint32(step)
        h = h + more
        step *= 2
    return h


def cut_points(places: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the payload [start, end), of sorted places where the hash allows one."""
    out, at = [], start
    k = int(np.searchsorted(places, start))
    places = places[k : int(np.searchsorted(places, end))].tolist()
    for p in places:
        while p + 1 - at > MOST:
            at += MOST
            out.append(at)
        if p + 1 - at >= LEAST:
            at = p + 1
            out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunks(payloads: list[bytes]) -> list[list[bytes]]:
    raw = b"".join(payloads)
    body = np.frombuffer(raw, np.uint8)
    places = np.flatnonzero(gear(body) >> np.uint32(32 - CUT_BITS) == 0) if len(body) else np.zeros(0, np.int64)
    out, start = [], 0
    for p in payloads:
        ends = cut_points(places, start, start + len(p))
        out.append([raw[a:b] for a, b in zip([start, *ends], ends, strict=False)])
        start += len(p)
    return out


def text_payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def _name(payload: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)


def _payloads(batches, column: int):
    """Of Arrow batches the ids, payloads and chunks; a payload that repeats in a step has no chunks the second time."""
    for b in textkit.slices(batches):
        payloads = [text_payload(x) for x in b.column(column).to_pylist()]
        yield b, payloads, chunks(payloads)


def references(docs: DataFrame) -> DataFrame:
    """payload (a hash), place, digest, size, of each chunk of each different payload of a step."""

    def step(batches):
        seen: set[int] = set()
        for _, payloads, parts in _payloads(batches, 0):
            rows = []
            for p, own in zip(payloads, parts, strict=True):
                name = _name(p)
                if name not in seen:
                    seen.add(name)
                    rows += [(name, k, hashlib.sha256(c).digest(), len(c)) for k, c in enumerate(own)]
            if rows:
                name, place, digest, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(place, pa.int32()), pa.array(digest, pa.binary()), pa.array(size, pa.int32())], names=["payload", "place", "digest", "size"])

    return docs.select("text").mapInArrow(step, "payload long, place int, digest binary, size int")


def _probes(digests: list[bytes], n_bits: int) -> np.ndarray:
    h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    return (h[:, :3] % np.uint64(n_bits)).astype(np.int64)


def shared_filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of shared digests, in bytes; its size follows from their number. A few tasks make one each."""
    n_bits = LEAST_BITS
    n = shared.count()
    while n_bits < min(MOST_BITS, BITS_EACH * n):
        n_bits *= 2

    def step(batches):
        bits = np.zeros(n_bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                at = _probes(b.column(0).to_pylist(), n_bits).reshape(-1)
                np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(n_bits // 8, np.uint8)
    for x in shared.select("digest").repartition(8).mapInArrow(step, "bits binary").toLocalIterator():
        out |= np.frombuffer(x["bits"], np.uint8)
    return out


def bodies(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row for each payload of a step: what stays with it; and one for each chunk that may be shared.

    kind 0: payload, doc ids (repeats of the step), n_bytes, list (digests and sizes of all chunks), body (those that
    aren't shared, in order, compressed), away (how many are shared). kind 1: list (the digest), body (compressed).
    """
    import zstandard

    def maybe(digests: list[bytes]) -> np.ndarray:
        at = _probes(digests, 8 * len(bits))
        return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)

    def step(batches):
        pack = zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()
        for b, payloads, parts in _payloads(batches, 1):
            texts = b.column(1).to_pylist()
            out: dict[int, list] = {}
            loose = []
            for doc, text, p, own in zip(b.column(0).to_pylist(), texts, payloads, parts, strict=True):
                name = _name(p)
                if name in out:
                    out[name][1].append(doc)
                    continue
                digests = [hashlib.sha256(c).digest() for c in own]
                away = maybe(digests)
                listed = b"".join(d + len(c).to_bytes(4, "little") + (b"\1" if w else b"\0") for d, c, w in zip(digests, own, away, strict=True))
                out[name] = [name, [doc], len((text or "").encode()), listed, pack.compress(b"".join(c for c, w in zip(own, away, strict=True) if not w)), int(away.sum())]
                for d, c, w in zip(digests, own, away, strict=True):
                    if w and d not in sent:
                        sent.add(d)
                        loose.append((d, pack.compress(c)))
            name, ids, n, listed, own, gone = zip(*out.values(), strict=True)
            m = len(name)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * m + [1] * len(loose), pa.int8()),
                    pa.array([*name, *[None] * len(loose)], pa.int64()),
                    pa.array([*ids, *[None] * len(loose)], pa.list_(b.schema.field(0).type)),
                    pa.array([*n, *[None] * len(loose)], pa.int64()),
                    pa.array([*listed, *[d for d, _ in loose]], pa.binary()),
                    pa.array([*own, *[c for _, c in loose]], pa.binary()),
                    pa.array([*gone, *[0] * len(loose)], pa.int32()),
                ],
                names=["kind", "payload", "ids", "n_bytes", "list", "body", "away"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"kind tinyint, payload long, ids array<{kind}>, n_bytes long, list binary, body binary, away int")


def parse_list(listed: bytes) -> list[tuple[bytes, int, bool]]:
    return [(listed[k : k + 32], int.from_bytes(listed[k + 32 : k + 36], "little"), listed[k + 36] == 1) for k in range(0, len(listed), 37)]


def stored_form(listed: bytes, payload: bytes) -> bytes:
    """The container: the ordered chunk list, then each different chunk's body. Where the store keeps a chunk doesn't show."""
    bodies_, at = {}, 0
    for digest, size, _ in parse_list(listed):
        bodies_.setdefault(digest, payload[at : at + size])
        at += size
    return LIST_HEAD + (len(listed) // 37).to_bytes(4, "little") + b"".join([*(listed[k : k + 36] for k in range(0, len(listed), 37)), *bodies_.values()])


def from_form(form: bytes) -> bytes:
    """The payload of a container alone."""
    n, at = int.from_bytes(form[len(LIST_HEAD) : len(LIST_HEAD) + 4], "little"), len(LIST_HEAD) + 4
    listed = [(form[at + 36 * k : at + 36 * k + 32], int.from_bytes(form[at + 36 * k + 32 : at + 36 * k + 36], "little")) for k in range(n)]
    at += 36 * n
    bodies_: dict[bytes, bytes] = {}
    for digest, size in listed:
        if digest not in bodies_:
            bodies_[digest] = form[at : at + size]
            at += size
    return b"".join(bodies_[digest] for digest, _ in listed)


def read_back(listed: bytes, own: bytes, shared: dict[bytes, bytes]) -> bytes:
    """The payload from its chunk list, its own bodies and the shared ones; every chunk is verified."""
    out, at = [], 0
    for digest, size, away in parse_list(listed):
        if away:
            body = shared[digest]
        else:
            body = own[at : at + size]
            at += size
        if len(body) != size or hashlib.sha256(body).digest() != digest:
            raise ValueError("a chunk differs from its list")
        out.append(body)
    return b"".join(out)


def features(payload: bytes, n_chunks: int) -> str:
    """chunks, least, greatest and mean sample, and the entropy of samples in bits, of a payload."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    some = np.flatnonzero(n)
    p = n[some] / n.sum()
    return f"chunks={n_chunks};min={some[0]};max={some[-1]};mean={(n * np.arange(256)).sum() / n.sum():.4f};entropy={abs((p * np.log2(p)).sum()):.4f}"


def store_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks: all but n_bytes from what was read back."""
    import zstandard

    kind = docs.schema["doc_id"].dataType.simpleString()
    refs = references(docs)
    shared = cut(refs.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    bits = shared_filter(shared)
    # The store: what is read from here on comes from it.
    made = cut(bodies(docs, bits))
    records = made.where("kind = 0").select("payload", "ids", "n_bytes", "list", "body", "away")
    store = made.where("kind = 1").select(F.col("list").alias("digest"), "body").groupBy("digest").agg(F.min("body").alias("body"))

    # The shared chunks each payload needs, by the lists that it is stored with.
    def wanted(batches):
        for b in batches:
            rows = [(n, d) for n, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for d in {d for d, _, away in parse_list(listed) if away}]
            if rows:
                name, digest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(digest, pa.binary())], names=["payload", "digest"])

    needs = records.where("away > 0").select("payload", "list").mapInArrow(wanted, "payload long, digest binary").distinct()
    got = needs.join(store, "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "body")).alias("shared"))

    def assemble(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for ids, n_bytes, listed, own, bodies_ in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                payload = read_back(listed, unpack.decompress(own) if own else b"", {x["digest"]: unpack.decompress(x["body"]) for x in bodies_ or []})
                if len(payload) % UNIT or not n_bytes <= len(payload) < n_bytes + UNIT + (not n_bytes):
                    raise ValueError("a payload differs from what was stored")
                form, n = stored_form(listed, payload), len(listed) // 37
                row = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(payload, n), n)
                for i in ids:
                    for c, v in zip(cols, (i, *row), strict=True):
                        c.append(v)
            if cols[0]:
                kinds = [b.schema.field(0).type.value_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*"doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature n_chunks".split()])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    # Payloads without shared chunks are complete where they are; the others meet theirs by a join.
    columns = ["ids", "n_bytes", "list", "body", "shared"]
    alone = records.where("away = 0").withColumn("shared", F.lit(None).cast(got.schema["shared"].dataType)).select(*columns)
    return alone.union(records.where("away > 0").join(got, "payload", "left").select(*columns)).mapInArrow(assemble, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
