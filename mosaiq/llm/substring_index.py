"""Substring deduplication by a log-structured index of window fingerprints.

The index is a set of immutable runs. A run holds, for each bucket of the hash
space, the sorted distinct fingerprints of all windows of the batches it covers.
A new batch is hashed, dealt to the buckets once, and there merge-joined with the
runs: a window is a repeat if its sequence is in a run (documents of earlier
batches precede those of later ones) or starts in a document of the same batch
with a smaller id. The same pass writes the batch's own run. When ``fanout`` runs of one
size tier are live, that pass merges them into the new one, which is of the next tier,
so compaction costs no exchange of its own and a window is rewritten as often as there
are tiers. The index keeps the highest id it holds and refuses a batch with one not
above it; a manifest names its runs, so that a later session can go on with it.

A fingerprint joins a bucket number and 40 bits of one hash with 24 bits of a
second hash with its own word values and base; the first is the key of the merge
join and the second verifies what the key finds. Nothing but a collision in both
can make a false repeat (about 1e-5 expected in 130 million windows).

Defined results: null and empty texts have no words; documents shorter than a
window are never cut; rows with the same id never cut each other; a null id comes
after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import blocks
from .store import buckets, write_shared, write_table
from .textops import Poly, buffers, coverage, frugal, slice_rows, slices, window_starts, word_bounds

WINDOWS, RUN, HIT, OLD = 0, 1, 2, 3  # OLD: a run that is matched, not merged
LAST = (1 << 63) - 1

_A, _B, _WA, _WB = Poly(1), Poly(2), Poly(3), Poly(4)


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """The two columns by which what is found about a row is joined to it again."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its key hash, its check hash, its row, its position in words."""
    s, e, first = word_bounds(data, offsets)
    at, rows = window_starts(first, width)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), rows, at
    a = _A.spans(_A.bytes(data), s, e)
    key = _WA.spans(_WA.prefix(a), at, at + width)
    b = _B.spans(_B.bytes(data), s, e)
    check = _WB.spans(_WB.prefix(b), at, at + width)
    return key, check, rows, at - first[:-1][rows]


@frugal
def _emit(it: Iterator[pa.RecordBatch], width: int, n: int, flush: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out():
        key, check, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        # what this task sees in a smaller document itself is decided here: a window of a
        # hot passage is sent once for each task, not once for each document
        whole = (key & ~np.uint64(0xFFFFFF)) | (check & np.uint64(0xFFFFFF))
        order = np.argsort(whole)
        starts, counts = blocks.runs_of(whole[order])
        smallest = np.empty(len(doc), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(doc[order], starts), counts)
        known = doc > smallest
        found = blocks.locate(doc[known], tag[known], pos[known], n, HIT) if known.any() else []
        key, check, doc, tag, pos = (x[~known] for x in (key, check, doc, tag, pos))
        for b, i in blocks.by_bucket((key % np.uint64(n)).astype(np.int64), n):
            d, t = doc[i], tag[i]
            starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
            counts = np.diff(np.concatenate((starts, [len(i)])))
            k, c = key[i] >> np.uint64(24), check[i]
            found.append((WINDOWS, b, blocks.pack(d[starts], t[starts], blocks.narrow(counts), (k >> np.uint64(32)).astype(np.uint8), k.astype(np.uint32), (c >> np.uint64(16)).astype(np.uint8), c.astype(np.uint16), blocks.narrow(pos[i]))))
        yield from blocks.rows(found)

    for batch in it:
        data, offsets = buffers(batch.column(2))
        ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets):
            key, check, rows, pos = fingerprints(*slice_rows(data, offsets, lo, hi), width)
            if len(key):
                held.append((key, check, ids[lo:hi][rows], tags[lo:hi][rows].astype(np.uint32), pos))
                size += len(key)
            if size >= flush:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


@frugal
def _merge_join(it: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """One partition: the batch's windows against the runs of the same bucket; a new run of them and the runs to merge."""
    held: dict[int, dict[int, list[bytes]]] = {RUN: {}, OLD: {}, WINDOWS: {}}
    for batch in it:
        kinds, buckets_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield batch.filter(pa.array(kinds == HIT))  # decided before
        for i, (k, b) in enumerate(zip(kinds.tolist(), buckets_.tolist(), strict=True)):
            if k != HIT:
                held[k].setdefault(b, []).append(batch.column(2)[i].as_py())
    for b in sorted(set().union(*held.values())):
        merge = [blocks.expand(x) for x in held[RUN].pop(b, [])]
        old = merge + [blocks.expand(x) for x in held[OLD].pop(b, [])]
        keys, docs, tags, poss = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for blob in held[WINDOWS].pop(b, []):
            d, t, c, k1, k0, c1, c0, p = blocks.unpack(blob)
            c = c.astype(np.int64)
            key = (k1.astype(np.uint64) << np.uint64(32)) | k0
            check = (c1.astype(np.uint64) << np.uint64(16)) | c0
            keys.append((key << np.uint64(24)) | check)
            docs.append(np.repeat(d, c))
            tags.append(np.repeat(t, c))
            poss.append(p.astype(np.int64))
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        starts, counts = blocks.runs_of(key[order])
        distinct = key[order][starts] if len(starts) else key
        if len(starts):
            known = np.zeros(len(starts), bool)
            for run in old:
                at = np.searchsorted(run, distinct)
                known |= run[np.minimum(at, len(run) - 1)] == distinct if len(run) else False
            smallest = np.minimum.reduceat(doc[order], starts)
            repeat = np.repeat(known, counts) | (doc[order] > np.repeat(smallest, counts))
            hit = order[repeat]
            if len(hit):
                yield from blocks.rows(blocks.locate(doc[hit], np.concatenate(tags)[hit], np.concatenate(poss)[hit], n, HIT))
        if merge:
            distinct = np.unique(np.concatenate([distinct, *merge]))
        if len(distinct):
            yield from blocks.rows([(RUN, b, blocks.squeeze(distinct))])


class WindowIndex:
    """The log-structured index: its live runs, oldest first, as (tier, path), in ``n`` buckets.

    Runs go to ``folder``, which must be one that all executors share, or else to the
    session's shared folder, where they stay until the session's tables are released.
    """

    def __init__(self, n: int, width: int = 13, fanout: int = 2, flush: int = 1_000_000, folder: str | None = None):
        self.n, self.width, self.fanout, self.flush, self.folder = n, width, fanout, flush, folder
        self.runs: list[tuple[int, str]] = []
        self.last: int | None = None  # the highest id

    def append(self, batch: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Match a batch against all runs and itself, add its run; returns the repeats' positions in packed blocks.

        All ids must be above those of earlier batches (null counts as the highest), as
        what is found here is decided for good.
        """
        spark = batch.sparkSession
        key_id, key_tag = row_key(doc_id, text)
        low, high = batch.agg(F.min(key_id), F.max(key_id)).first()
        if low is not None and self.last is not None and low <= self.last:
            raise ValueError(f"id {low} comes after {self.last}")
        dealt = batch.select(key_id.alias("i"), key_tag.alias("t"), F.col(text).alias("x")).mapInArrow(partial(_emit, width=self.width, n=self.n, flush=self.flush), blocks.SCHEMA)
        tier = 0
        while sum(t == tier for t, _ in self.runs) >= self.fanout:
            tier += 1
        for t, path in self.runs:
            dealt = dealt.unionByName(spark.read.schema(blocks.SCHEMA).parquet(path).where(F.col("kind") == RUN).withColumn("kind", F.lit(RUN if t < tier else OLD)))
        found = dealt.repartitionById(self.n, F.col("bucket")).mapInArrow(partial(_merge_join, n=self.n), blocks.SCHEMA)
        if self.folder:
            path = f"{self.folder.rstrip('/')}/window-run-{uuid.uuid4().hex}"
            write_table(found, path)
        else:
            path = write_shared(found, "window-run")
        self.runs = [r for r in self.runs if r[0] >= tier] + [(tier, path)]
        self.last = self.last if high is None else high
        return spark.read.schema(blocks.SCHEMA).parquet(path).where(F.col("kind") == HIT)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the manifest."""
        held = {k: getattr(self, k) for k in ("n", "width", "fanout", "flush", "folder", "runs", "last")}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WindowIndex:
        """The index that a manifest names."""
        held = json.loads(spark.read.text(path).first().value)
        out = cls(held["n"], held["width"], held["fanout"], held["flush"], held["folder"])
        out.runs, out.last = [(t, p) for t, p in held["runs"]], held["last"]
        return out


@frugal
def _cut(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in it:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            texts, found = part.column(1), part.column(2)
            n_words, n_removed, kept, spans = [], [], [], []
            for i in range(len(part)):
                words = (texts[i].as_py() or "").encode().split()
                merged = []
                removed = 0
                if found[i].is_valid:
                    merged = coverage(np.frombuffer(found[i].as_py(), "<u4").astype(np.int64), width).tolist()
                    stay = bytearray(b"\1") * len(words)
                    for a, b in merged:
                        stay[a:b] = bytes(b - a)
                        removed += b - a
                    n_words.append(len(words))
                    words = list(compress(words, stay))
                else:
                    n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(words).decode())
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, schema.field("removed_spans").type)], schema=schema)


def cut_points(docs: DataFrame, doc_id: str, batches: int) -> list[int]:
    """Ids that divide the rows into about equal batches, by approximate quantiles."""
    found = docs.select(F.col(doc_id).cast("long").alias("i")).where(F.col("i").isNotNull())
    points = found.approxQuantile("i", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(p) for p in points})


def substring_dedup(docs: DataFrame, width: int = 13, batches: int = 4, fanout: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut from every document the words of windows that also start in a document with a smaller id.

    Documents enter the index in ``batches`` ranges of ids. Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space) and removed_spans (word
    positions, end exclusive).
    """
    index = WindowIndex(buckets(docs), width, fanout)
    hits = None
    edges = [None, *cut_points(docs, doc_id, batches), None]
    ident = F.col(doc_id).cast("long")
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = docs
        if lo is not None:
            part = part.where((ident > lo) | ident.isNull() if hi is None else ident > lo)
        if hi is not None:
            part = part.where(ident <= hi)
        found = index.append(part, doc_id, text)
        hits = found if hits is None else hits.unionByName(found)
    key_id, key_tag = row_key(doc_id, text)
    where = hits.repartitionById(index.n, F.col("bucket")).mapInArrow(blocks.regroup, blocks.LOCATED)
    joined = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key_id.alias("key_id"), key_tag.alias("key_tag")).join(where, ["key_id", "key_tag"], "left")
    return joined.select("doc_id", "text", "positions").mapInArrow(partial(_cut, width=width), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed_spans array<struct<start:bigint,end:bigint>>")


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, derived from the operator's own result."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
