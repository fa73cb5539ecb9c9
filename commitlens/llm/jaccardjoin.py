"""Exact n-gram Jaccard join by PartEnum signatures, and its groups.

A document's features are its distinct word 5-grams (A-Z in lower case).
Documents with equal sets form one class and only classes are joined, so
copies cost nothing. Two classes link at Jaccard 0.75 or more, a ratio of
integers; no link between different sets is lost:

1. *Partners exist at all?* A set linked with another shares at least 3/4 of
   its features with it. So a class for which more than a quarter of its
   features occur in no other class can't have links. Features of a fixed
   part of the domain are counted over all documents (fewer counted features
   only keep more classes), in packed form: blobs of hashes by hash range,
   combined before the shuffle, so a feature of all documents is one entry a
   step.
   What is left is peeled: only sets that are left, and of sizes that could
   link, count as those other classes.
2. *PartEnum.* Sizes fall into bands such that linked sets are in the same or
   in neighbouring bands; a set signs for its band and the next one. In a band
   with sizes up to r, linked sets differ in at most k = 2r/7 features. The
   domain is cut into n1 parts, and each into N2 second-level parts: in one of
   the n1 parts at most K2 features differ, so on some N2 - K2 of its
   second-level parts the two sets are equal. Each such subset's content is a
   signature, and linked sets share one. Spare parts make it safe to leave out
   signatures of empty content, which sets that have nothing in common share.
3. *Candidates, without all pairs.* Sets that share a signature are a run; the
   member with most company in all runs is the hub of the run's others. Sets are
   first held against their hubs, and verified. Then members outside a hub's
   component are held, in chunks, against all members of other components: any two sets that share a signature are members of one hub. Before
   verification an exact bound goes over parity sketches: the population count of
   their difference is at most the number of features that differ. Only pairs
   that pass it, of different components, come into being as rows.
4. Components are labelled by Spark joins.

Nulls and texts without words have no features, link with nothing and are
their own components. A null doc_id is kept, with no links. Repeated rows have
equal sets, hence one component.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import textkit
from commitlens.llm.packed import SCHEMA, pack, unpack
from commitlens.llm.shared import components, cut, numbered, release, small, without

WORDS = 5
#: Linked: DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
#: Of 65,536 equal parts of the domain, those whose features are counted in step 1.
COUNTED = 26_000
#: Entries that one hash range is meant to hold.
RANGE_ENTRIES = 1_000_000
LEAST_RANGES = 64
#: Differences that a first-level part may have, and its second-level parts.
K2, N2 = 1, 3
#: Members of a hub that are one side of a group at most, and bytes of their sketches.
CHUNK, CHUNK_BYTES = 4096, 8 << 20
#: Peeling ends when a round over the whole domain leaves this share of the features, or more.
LITTLE = 0.9


def _domain(features: np.ndarray) -> np.ndarray:
    return features[(features & np.uint64(0xFFFF)) < np.uint64(COUNTED)]


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, counted (features in the counted part), class (digest of the set, null if empty)."""

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(1))
            sets = textkit.shingle_sets(textkit.lower_ascii(buf), offs, words)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([len(_domain(s)) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "counted", "class"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n_shingles long, counted long, class binary")


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") | 1


def _combined(features: np.ndarray, name: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Blobs of features and whose they are, by range. A feature of several names is one entry, named 0, and is counted for its names here."""
    what = features >> np.uint64(16)
    order = np.lexsort((name, what))
    what, name = what[order], name[order]
    first = np.concatenate(([True], what[1:] != what[:-1])) if len(what) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(first), len(what)))
    many = np.repeat(size > 1, size)
    known, count = np.unique(name[many], return_counts=True)
    name = np.where(many, np.uint64(0), name)
    what, name = what[first | ~many], name[first | ~many]
    bucket = np.concatenate((what % np.uint64(ranges), textkit.mix(known) % np.uint64(ranges))).astype(np.int32)
    # Counts go with the ranges, as entries without a feature.
    is_count = np.concatenate((np.zeros(len(what), np.uint8), np.ones(len(known), np.uint8)))
    what, name = np.concatenate((what, count.astype(np.uint64))), np.concatenate((name, known))
    order = np.argsort(name, kind="stable")
    return pack(bucket[order], *_narrow(what[order]), name[order], is_count[order])


def _met(table: pa.Table) -> pa.Table:
    """Short, shared: for every name how many of its features have another name beside it."""
    low, high, name, is_count = unpack(table, np.uint32, np.uint16, np.uint64, np.uint8)
    what = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    said = is_count == 1
    names, counts = [name[said]], [what[said].astype(np.int64)]
    what, name = what[~said], name[~said]
    order = np.lexsort((name, what))
    what, name = what[order], name[order]
    if len(what):
        new = np.concatenate(([True], (what[1:] != what[:-1]) | (name[1:] != name[:-1])))
        # One step's "several" (name 0) counts for any class beside it, also where it is there once.
        first = np.flatnonzero(np.concatenate(([True], what[1:] != what[:-1])))
        size = np.diff(np.append(first, len(what)))
        differ = np.repeat(np.maximum.reduceat(name, first) != np.minimum.reduceat(name, first), size)
        credited = name[differ & new & (name != 0)]
        names.append(credited)
        counts.append(np.ones(len(credited), np.int64))
    uniq, inverse = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(uniq)).astype(np.int64)
    return pa.table({"short": uniq.astype(np.int64), "shared": total})


def shared_features(docs: DataFrame, ranges: int, words: int = WORDS) -> DataFrame:
    """short (of a class), shared: how many counted features of a class occur in another one; at least that many where copies repeat."""

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(0))
            sets = textkit.shingle_sets(textkit.lower_ascii(buf), offs, words)
            own: dict[int, np.ndarray] = {}
            for s in sets:
                if len(s):
                    own.setdefault(_short(hashlib.blake2b(s.tobytes(), digest_size=16).digest()), _domain(s))
            if not own:
                continue
            name = np.repeat(np.array(list(own), np.uint64), [len(x) for x in own.values()])
            yield _combined(np.concatenate(list(own.values())), name, ranges)

    blobs = docs.select("text").mapInArrow(step, SCHEMA)
    met = blobs.groupBy("bucket").applyInArrow(_met, "short long, shared long")
    return met.groupBy("short").agg(F.sum("shared").alias("shared"))


def _narrow(what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (what & np.uint64(0xFFFFFFFF)).astype(np.uint32), (what >> np.uint64(32)).astype(np.uint16)


def band_top(band: int) -> int:
    """The largest size in a band: a set in band i links only within bands i - 1, i and i + 1."""
    top = 0
    for _ in range(band):
        top = max(top + 1, (top + 1) * DEN // NUM)
    return top


def bands_of(size: int) -> list[int]:
    """The bands that a set signs for: its own and the next, but for those whose sets must be equal to link."""
    band = 0
    while band_top(band) < size:
        band += 1
    return [x for x in (band, band + 1) if 2 * band_top(x) * (DEN - NUM) // (DEN + NUM)]


def part_enum(features: np.ndarray, band: int) -> np.ndarray:
    """Signatures of a set for a band.

    Of n1 = k // (K2 + 1) + 1 + spare first-level parts at least 1 + spare have K2 differences at most.
    A signature is of K2 differing second-level parts left out; one of only empty parts says nothing and
    is left out as well, if no more than ``spare`` parts have one: then some part with a telling signature
    is left for every partner. A set with more such parts signs with all, as its partners of that kind do.
    """
    k = 2 * band_top(band) * (DEN - NUM) // (DEN + NUM)
    n1 = k // (K2 + 1) + 1
    spare = -(-n1 // 7)
    n1 += spare
    place = textkit.mix(features ^ np.uint64(0x5151 + band))
    part = (place >> np.uint64(40)).astype(np.int64) % n1 * N2 + (place & np.uint64(0xFFFFF)).astype(np.int64) % N2
    sums = np.zeros(n1 * N2, np.uint64)
    np.add.at(sums, part, place)
    sums = sums.reshape(n1, N2)
    empty = sums == 0
    every = (empty.sum(1) >= N2 - K2).sum() > spare
    sums = textkit.mix(sums)
    out = []
    for c, subset in enumerate(combinations(range(N2), N2 - K2)):
        acc = np.full(n1, np.uint64(band * 64 + c + 1)) + np.arange(n1, dtype=np.uint64) * textkit.GOLD
        for x in subset:
            acc = textkit.mix(acc ^ sums[:, x])
        out.append(acc if every else acc[~empty[:, list(subset)].all(1)])
    return np.concatenate(out)


def peeled(sets: DataFrame, ranges: int, part: int = 1 << 16) -> DataFrame:
    """rep, bands: of ``sets`` those, and the bands, for which at most a quarter of a set's features occur in
    no other set that signs for the band; for others a set has no link. ``part``: how much of the domain is looked at."""

    def step(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                yield from one(b.slice(i, 500))

    def one(b):
        whats, names = [], []
        for rep, own, bands in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            own = own.values.to_numpy(zero_copy_only=False).view(np.uint64)
            own = own[(own & np.uint64(0xFFFF)) < np.uint64(part)]
            for band in bands:
                whats.append(textkit.mix(own ^ np.uint64(0xB0 + band)))
                names.append(np.full(len(own), (rep + 1) << 8 | band, np.int64))
        if whats:
            yield _combined(np.concatenate(whats), np.concatenate(names).view(np.uint64), ranges)

    blobs = sets.select("rep", "features", "bands").mapInArrow(step, SCHEMA)
    met = blobs.groupBy("bucket").applyInArrow(_met, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))
    met = met.select((F.shiftright("short", 8) - 1).alias("rep"), F.col("short").bitwiseAND(255).cast("int").alias("band"), "shared")
    looked = F.size("features") if part == 1 << 16 else F.size(F.filter("features", lambda x: x.bitwiseAND(0xFFFF) < part))
    own = sets.select("rep", F.explode("bands").alias("band"), F.size("features").alias("n"), looked.alias("looked"))
    # A set that met nothing has no row in ``met``; it may stay if few of its features were looked at.
    none = F.coalesce("shared", F.lit(0))
    alive = own.join(met, ["rep", "band"], "left").where((F.col("looked") - none) * DEN <= F.col("n") * (DEN - NUM))
    return alive.groupBy("rep").agg(F.sort_array(F.collect_set("band")).alias("bands"))


def runs(sets: DataFrame, ranges: int) -> DataFrame:
    """sig, rep: the members of runs, sets that share a signature. Runs of the same members are one; ``sig`` names them."""

    def step(batches):
        sigs, who = [], []
        for b in batches:
            for rep, own, bands in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = own.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for band in bands:
                    sigs.append(part_enum(own, band))
                    who.append(np.full(len(sigs[-1]), rep, np.int64))
                if sum(map(len, sigs)) > 2_000_000:
                    yield blobs_of(sigs, who)
                    sigs, who = [], []
        if sigs:
            yield blobs_of(sigs, who)

    def blobs_of(sigs, who):
        sig, name = np.concatenate(sigs), np.concatenate(who)
        return pack((sig % np.uint64(ranges)).astype(np.int32), sig, name)

    def meet(table: pa.Table) -> pa.Table:
        sig, who = unpack(table, np.uint64, np.int64)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        if len(sig):
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])))
            sig, who = sig[new], who[new]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            several = np.repeat(size > 1, size)
            first, who = first[size > 1], who[several]
            size = size[size > 1]
            at = np.concatenate(([0], np.cumsum(size)))
            total = np.concatenate(([np.uint64(0)], np.cumsum(textkit.mix(who.view(np.uint64)))))
            name = textkit.mix(total[at[1:]] - total[at[:-1]])
            name, one = np.unique(name, return_index=True)
            lists = [who[at[k] : at[k + 1]] for k in one.tolist()]
            return pa.table({"sig": name.view(np.int64), "reps": pa.array(lists, pa.list_(pa.int64()))})
        return pa.table({"sig": pa.array([], pa.int64()), "reps": pa.array([], pa.list_(pa.int64()))})

    blobs = sets.select("rep", "features", "bands").mapInArrow(step, SCHEMA)
    met = blobs.groupBy("bucket").applyInArrow(meet, "sig long, reps array<long>")
    return met.dropDuplicates(["sig"]).select("sig", F.explode("reps").alias("rep"))


def sketch_bits(size: int) -> int:
    """Bits of a set's parity sketch: a power of two, four or more for each feature. The halves of a sketch, added, are one of half the bits."""
    return max(1024, 1 << (4 * size - 1).bit_length())


def feature_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """rep, features (sorted), sketch, bands, of documents (rep, text, class); rows whose set has another digest are dropped."""

    def step(batches):
        for b in textkit.slices(batches):
            buf, offs = textkit.text_buffer(b.column(1))
            sets = textkit.shingle_sets(textkit.lower_ascii(buf), offs, words)
            right = [i for i, (s, c) in enumerate(zip(sets, b.column(2).to_pylist(), strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c]
            sets, reps = [sets[i] for i in right], b.column(0).take(pa.array(right, pa.int64()))
            sketches = []
            for own in sets:
                n = sketch_bits(len(own))
                bits = np.bincount((own >> np.uint64(20)).astype(np.int64) % n, minlength=n).astype(np.uint8) & 1
                sketches.append(np.packbits(bits, bitorder="little").view(np.uint64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32)
            at = np.zeros(len(sets) + 1, np.int32)
            at[1:] = np.cumsum([len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    reps,
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches).view(np.int64) if sketches else np.zeros(0, np.int64))),
                    pa.array([bands_of(len(s)) for s in sets], pa.list_(pa.int32())),
                ],
                names=["rep", "features", "sketch", "bands"],
            )

    return docs.select("rep", "text", "class").mapInArrow(step, "rep long, features array<long>, sketch array<long>, bands array<int>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs a, b, with the components ca, cb, those that link. The bound on sketches goes first, so few sets move."""
    slim = sets.select("rep", F.size("features").alias("n"), "sketch")
    near = pairs.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b")
    a_is_long = F.size("sa") > F.size("sb")
    long, short = F.when(a_is_long, F.col("sa")).otherwise(F.col("sb")), F.when(a_is_long, F.col("sb")).otherwise(F.col("sa"))
    m = F.size(short)
    half = F.zip_with(F.slice(long, F.lit(1), m), F.slice(long, m + 1, m), lambda x, y: x.bitwiseXOR(y))
    differ = F.aggregate(F.zip_with(F.when(F.size(long) > m, half).otherwise(long), short, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    near = near.where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
    near = near.where(differ * (DEN + NUM) <= (F.col("na") + F.col("nb")) * (DEN - NUM)).select("a", "b", "ca", "cb")
    full = sets.select("rep", "features")
    both = near.join(full.toDF("a", "fa"), "a").join(full.toDF("b", "fb"), "b")
    same = F.size(F.array_intersect("fa", "fb"))
    return both.where(same * DEN >= (F.size("fa") + F.size("fb") - same) * NUM).select("a", "b", "ca", "cb")


def hubs(run: DataFrame) -> DataFrame:
    """hub, rep: in each run the member with most company in all runs is the hub of its others, and of itself."""
    run = cut(run)
    weight = run.groupBy("sig").agg((F.count("*") - 1).alias("others"))
    central = run.join(weight, "sig").groupBy("rep").agg(F.sum("others").alias("central"))
    ranked = run.join(central, "rep").select("sig", "rep", F.struct(-F.col("central"), F.col("rep")).alias("rank"))
    first = ranked.groupBy("sig").agg(F.min("rank").alias("first")).select("sig", F.col("first.rep").alias("hub"))
    return ranked.select("sig", "rep").join(first, "sig").select("hub", "rep").distinct()


def near_pairs(member: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, ca, cb: of the members (hub, rep, component) of a hub those of different components that the
    bound on sketches lets through.

    Of two such members one at least is outside the hub's own component. Those outside and all members go
    in chunks of about ``CHUNK`` or ``CHUNK_BYTES``, and a chunk of either is a group, so that no group is large; in it
    only pairs that pass come into being.
    """
    slim = sets.select("rep", F.size("features").alias("n"), "sketch")
    main = cut(member.where("rep = hub").select("hub", F.col("component").alias("main")))
    member = member.join(small(main), "hub").join(sets.select("rep", (F.size("sketch") * 8).alias("bytes")), "rep")
    out = F.col("component") != F.col("main")
    size = member.groupBy("hub").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count(F.when(out, 1)).alias("n_out"), F.sum(F.when(out, F.col("bytes"))).alias("b_out")
    )
    chunks = lambda n, b: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(b) / CHUNK_BYTES)).cast("int")
    size = cut(size.where("n_out > 0").select("hub", chunks("n", "b").alias("cols"), chunks("n_out", "b_out").alias("lines")))
    rows = member.join(small(size), "hub").join(slim, "rep")
    keep = ["hub", "rep", "component", "n", "sketch"]
    part = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    outside = rows.where("component <> main").select(*keep, F.lit(True).alias("outside"), part("lines").alias("i"), every("cols").alias("j"))
    inside = rows.select(*keep, F.lit(False).alias("outside"), part("cols").alias("j"), every("lines").alias("i")).select(*outside.columns)

    def meet(table: pa.Table) -> pa.Table:
        rep, comp, n, out = (table.column(c).to_numpy() for c in ("rep", "component", "n", "outside"))
        sketch = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in table.column("sketch")]
        width = np.array([len(x) for x in sketch])
        found: list[tuple[int, int]] = []
        for w in np.unique(width).tolist():
            # Pairs of which the shorter sketch has this width.
            wide = np.flatnonzero(width >= w)
            folded = np.stack([np.bitwise_xor.reduce(sketch[k].reshape(-1, w), 0) for k in wide])
            there = np.flatnonzero(~out[wide])
            for at in np.flatnonzero(out[wide]).tolist():
                k = wide[at]
                x = wide[there]
                ok = (comp[x] != comp[k]) & (np.minimum(width[x], width[k]) == w) & (DEN * np.minimum(n[x], n[k]) >= NUM * np.maximum(n[x], n[k]))
                other = there[ok]
                if len(other):
                    differ = np.bitwise_count(folded[other] ^ folded[at]).sum(1, dtype=np.int64)
                    near = other[differ * (DEN + NUM) <= (n[wide[other]] + n[k]) * (DEN - NUM)]
                    found += [(k, y) for y in wide[near].tolist()]
        x, y = (np.array([f[c] for f in found], np.int64) for c in (0, 1))
        return pa.table({"a": np.minimum(rep[x], rep[y]), "b": np.maximum(rep[x], rep[y]), "ca": np.minimum(comp[x], comp[y]), "cb": np.maximum(comp[x], comp[y])})

    met = outside.union(inside).groupBy("hub", "i", "j").applyInArrow(meet, "a long, b long, ca long, cb long")
    return met.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.max("cb").alias("cb"))


def linked_components(run: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node, component of the sets that link with others; None if none does.

    First every set is held against its hubs, which joins most of what links. Then all members of a hub
    are held against each other, as far as they are of different components.
    """
    star = cut(hubs(run))
    pairs = star.where("hub <> rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    found = cut(verified(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), sets))
    labels = cut(components(found.select("a", "b"))) if found.limit(1).count() else None
    member = star.withColumn("component", F.col("rep"))
    if labels is not None:
        member = star.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = cut(verified(near_pairs(member.select("hub", "rep", "component"), sets), sets))
    if not more.limit(1).count():
        return labels
    moved = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    single = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    if labels is None:
        labels = single.withColumn("component", F.col("node"))
    else:
        labels = labels.union(single.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    every = cut(classes(docs, words))
    total = every.agg(F.sum("counted").alias("n")).first()["n"] or 0
    one = every.where("class is not null and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("counted").alias("counted"), F.count("*").alias("copies")
    )
    left = _with_partners(docs, one, max(LEAST_RANGES, total // RANGE_ENTRIES), words)
    release(spark)
    sets = _peeled_sets(docs, left, words)
    n = sets.agg(F.sum(F.size("features")).alias("n")).first()["n"] or 0
    labels = linked_components(runs(sets, max(LEAST_RANGES, 3 * n // RANGE_ENTRIES)), sets)
    linked = _named(left, labels) if labels is not None else left.select("class", F.col("least").alias("component")).limit(0)
    # Only classes of several documents or with links need a name: for others it is their own document's.
    name = F.coalesce("component", "least")
    names = one.join(linked, "class", "left").where("copies > 1 or component is not null").select("class", name.alias("name"))
    member = every.join(small(cut(names)), "class", "left")
    return member.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def _with_partners(docs: DataFrame, one: DataFrame, ranges: int, words: int) -> DataFrame:
    """class, least, rep (a number): the classes that may have links, by the features of step 1."""
    shared = shared_features(docs, ranges, words)
    none = F.coalesce("shared", F.lit(0))
    able = one.withColumn("short", _short_column(F.col("class"))).join(shared, "short", "left")
    return cut(numbered(able.where((F.col("counted") - none) * DEN <= F.col("n") * (DEN - NUM)).select("class", "least"), "rep"))


def _peeled_sets(docs: DataFrame, left: DataFrame, words: int) -> DataFrame:
    """rep, features, sketch, bands of the sets that may still have links after all rounds of peeling."""
    few = small(left)
    sets = cut(feature_sets(docs.join(few, few["least"] == docs["doc_id"]).select("rep", "text", "class"), words))
    if sets.count() > left.count():  # rows that share a doc_id and a text
        sets = cut(sets.dropDuplicates(["rep"]))
    every, features = sets, F.sum(F.size("features")).alias("n")
    n = sets.agg(features).first()["n"] or 0
    for part in (COUNTED, 1 << 16, 1 << 16):
        alive = cut(peeled(sets, max(LEAST_RANGES, 2 * n // RANGE_ENTRIES), part))
        release(docs.sparkSession)
        sets = every.drop("bands").join(small(alive), "rep").select("rep", "features", "sketch", "bands")
        before, n = n, sets.agg(features).first()["n"] or 0
        if part == 1 << 16 and n >= LITTLE * before:
            break
    return sets


def _named(left: DataFrame, labels: DataFrame) -> DataFrame:
    """class, component: the least doc_id of the component that a class is in, of the classes with links."""
    both = left.join(labels, left["rep"] == labels["node"]).select("class", "least", F.col("component").alias("_number"))
    least = both.groupBy("_number").agg(F.min("least").alias("component"))
    return both.select("class", "_number").join(least, "_number").select("class", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the least doc_id of their component; rows without an id stay."""
    return without(docs, groups(docs).where("doc_id <> component_id").select("doc_id"))


def _short_column(digest):
    """The first eight bytes, little endian, odd: what ``_short`` gives, as a signed long."""
    swapped = F.concat(*[F.substring(digest, k, 1) for k in range(8, 0, -1)])
    low = F.conv(F.hex(F.substring(swapped, 5, 4)), 16, 10).cast("long")
    high = F.conv(F.hex(F.substring(swapped, 1, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseOR(F.lit(1).cast("long"))


def op2(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
with recursive t as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, case when w is null or len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from t),
n as (select doc_id, len(s)::bigint as n from s),
f as materialized (select doc_id, hash(unnest(s)) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from f a join f b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
m as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
l as (select a, b from m union all select b, a from m),
c as (select doc_id as a, doc_id as b from n union select c.a, l.b from c join l on c.b = l.a)
select n.doc_id, n.n as n_shingles, min(c.b) as component_id from n join c on c.a = n.doc_id group by 1, 2
"""
