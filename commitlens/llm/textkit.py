"""Vectorised work on whole columns of text, shared by the Arrow-backed operators.

A text column is one byte buffer with offsets; words, their 64-bit hashes and
hashes of word n-grams come from whole-array operations on that buffer. Words
are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as runs of code points other than those. Nulls count as empty texts.

Memory: ``slices`` cuts Arrow batches so that one step holds about
``STEP_BYTES`` of text, or a single text where that one is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STEP_BYTES = 3 << 20
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, with 8 bytes of padding, and its n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    buf = np.zeros(len(body) + 8, np.uint8)
    buf[: len(body)] = body
    return buf, offs - offs[0]


def slices(batches, column: str = "text", limit: int = STEP_BYTES):
    """Arrow batches, cut by rows so that ``column`` of each holds about ``limit`` bytes at most."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if not n:
            continue
        lengths = np.fromiter((x or 0 for x in _lengths(col)), np.int64, n)
        step = np.maximum(np.cumsum(lengths) - 1, 0) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        at = 0
        for to in [*cuts.tolist(), n]:
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, where the C library can: workers stay, idle, for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _lengths(col):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    n = int(offs[-1])
    body = buf[:n]
    inside = np.ones(n + 1, bool)
    inside[:n] = ~((body == 32) | ((body >= 9) & (body <= 13)))
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[:n] & (edge[:n] | ~np.concatenate(([False], inside[: n - 1])) if n else inside[:n]))
    ends = np.flatnonzero(inside[:n] & (edge[1:] | ~inside[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_KEEP = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], np.uint64)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; eight bytes of all spans at a time."""
    wide = np.ndarray(max(0, len(buf) - 7), np.dtype("<u8"), buf, 0, (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * GOLD + np.uint64(seed))
    live = np.arange(len(starts))
    at = 0
    while len(live):
        rest = size[live] - at
        out[live] = mix(out[live] ^ ((wide[starts[live] + at] & _KEEP[np.minimum(rest, 8)]) * GOLD + M1))
        at += 8
        live = live[rest > 8]
    return out


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at each word (0 where a text ends before), and whether one does."""
    m = len(h)
    ok = np.zeros(m, bool)
    out = np.zeros(m, np.uint64)
    if m >= n:
        left = np.repeat(first[1:], np.diff(first)) - np.arange(m)
        ok = left >= n
        acc = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            acc += h[k : k + m - n + 1]
            acc *= GOLD | np.uint64(1)
            acc ^= acc >> np.uint64(29)
        out[: m - n + 1] = mix(acc + np.uint64(n))
        out[~ok] = 0
    return out, ok


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; a text of fewer words gives its whole sequence, one without words nothing."""
    starts, ends, first = words(buf, offs)
    h = hash_spans(buf, starts, ends)
    grams, ok = ngrams(h, first, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], np.array([0, b - a]), b - a)[0][:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
