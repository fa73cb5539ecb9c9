"""Rows of a few numeric columns that travel as blobs, one a bucket.

What must meet by hash (n-grams, windows, signatures) is far more rows than a
row-at-a-time shuffle should move. So each step sorts its rows by bucket and
sends a blob for each. In a blob the columns' bytes are laid out plane by
plane (all first bytes, all second bytes, ...), which makes the upper bytes of
ids and places runs, and compressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, blob binary"


def pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Blobs by bucket, rows in the order in which they come."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    names = [int(bucket[a]) for a in edges[:-1]]
    planes = lambda c: np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()
    blobs = [np.uint64(b - a).tobytes() + squeeze(b"".join(planes(c[a:b]) for c in columns)) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def unpack(table: pa.Table, *kinds) -> list[np.ndarray]:
    """The columns of all blobs of a table."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        n, at = int(np.frombuffer(raw, np.uint64, 1)[0]), 0
        body = np.frombuffer(open_(memoryview(raw)[8:]), np.uint8)
        for part, kind in zip(parts, kinds, strict=True):
            size = np.dtype(kind).itemsize
            part.append(np.ascontiguousarray(body[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
            at += n * size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]
