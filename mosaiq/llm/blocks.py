"""Packed exchange blocks.

An exchange of hundreds of millions of small keys pays mostly for row overhead.
Here a task groups its keys by destination and ships one binary block for each
destination, so a key costs its own bytes only. A block is a list of NumPy arrays.
The number of blocks is bounded both by tasks x destinations and by the keys.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import mix

SCHEMA = "kind int, bucket int, blob binary"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        parts.append(a.tobytes())
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<H", blob), 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", blob, at)
        a = np.frombuffer(blob, dtype=np.dtype("<" + kind.decode()), count=size, offset=at + 10)
        at += 10 + a.nbytes
        out.append(a)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def rows(found: list[tuple[int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (kind, bucket, blob) rows, each batch of bounded size."""
    lo = 0
    while lo < len(found):
        hi, size = lo, 0
        while hi < len(found) and (hi == lo or size + len(found[hi][2]) <= limit):
            size += len(found[hi][2])
            hi += 1
        part = found[lo:hi]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.binary())],
            schema=ARROW,
        )
        lo = hi


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket with entries, the indices of these in their order."""
    small = bucket.astype(np.uint16) if n <= 1 << 16 else bucket
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [len(values)])))


def squeeze(ordered: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as zstd-compressed byte planes of their differences."""
    delta = np.diff(ordered, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()
    return struct.pack("<Q", len(ordered)) + pa.compress(planes, codec="zstd", asbytes=True)


def expand(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", blob)
    if not n:
        return np.zeros(0, np.uint64)
    planes = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    delta = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(delta, dtype=np.uint64)


def locate(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, n: int, kind: int) -> list[tuple[int, int, bytes]]:
    """Blocks that carry positions home: one for each bucket of documents."""
    home = (mix(doc.astype(np.uint64) ^ (tag.astype(np.uint64) << np.uint64(17))) % np.uint64(n)).astype(np.int64)
    out = []
    for b, idx in by_bucket(home, n):
        idx = idx[np.lexsort((pos[idx], tag[idx], doc[idx]))]
        d, t = doc[idx], tag[idx]
        starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
        out.append((kind, b, pack(d[starts].astype(np.int64), t[starts].astype(np.uint32), narrow(np.diff(np.concatenate((starts, [len(idx)])))), narrow(pos[idx]))))
    return out


LOCATED = "key_id bigint, key_tag bigint, positions binary"


def regroup(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All ``locate`` blocks of a bucket to one row for each document, positions sorted and distinct."""
    docs, tags, poss = [], [], []
    for batch in it:
        for blob in batch.column(batch.schema.get_field_index("blob")):
            d, t, c, p = unpack(blob.as_py())
            docs.append(np.repeat(d, c.astype(np.int64)))
            tags.append(np.repeat(t, c.astype(np.int64)))
            poss.append(p.astype(np.int64))
    if not docs:
        return
    d, t, p = np.concatenate(docs), np.concatenate(tags), np.concatenate(poss)
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
    ends = np.concatenate((starts[1:], [len(d)]))
    for lo in range(0, len(starts), 1000):
        s, e = starts[lo : lo + 1000], ends[lo : lo + 1000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[s], pa.int64()), pa.array(t[s].astype(np.int64), pa.int64()), pa.array([np.unique(p[a:b]).astype("<u4").tobytes() for a, b in zip(s, e, strict=True)], pa.binary())],
            schema=pa.schema([("key_id", pa.int64()), ("key_tag", pa.int64()), ("positions", pa.binary())]),
        )
