"""Exact removal of long repeated strings by run-compressed indexes.

Contract: a string of ``length`` bytes that starts at two or more places, of the same
or of different documents, is a repeat, and all bytes it covers are removed.

1. Each string of ``length`` bytes has one anchor, the smallest hash among its grams of
   ``gram`` bytes (the leftmost of equals). Equal strings have equal anchors at equal
   distances, so strings need to be compared only below the same anchor. A task sends
   each distinct anchor once, in packed blocks; anchors that a second place has too are
   sent back to their documents. What a task sees twice itself it decides itself, so a
   group of copies costs one entry for each task.
2. For each repeated anchor the strings that have it form one stretch of text, the
   context; a context holds no string of another anchor. Contexts are dealt by anchor
   hash; equal contexts count once, with their multiplicity.
   An anchor with more than ``hot`` places is split: its stretches are cut once more by a
   second anchor under another hash, and are dealt by both anchors and their distance.
   So a common line of the length of a gram does not bring all contexts to one shard.
3. Each shard builds a run-length index of its distinct contexts: the Burrows-Wheeler
   transform, kept as its runs, with the text position and the longest common prefix
   sampled at the ends of each run. Matching statistics (the longest match of each
   suffix anywhere else) are streamed through the text from these samples: between two
   samples the match only gets shorter by one for each byte. A string whose statistic
   reaches ``length`` is a repeat.
4. Ranges of repeats go back to their documents, whose covered bytes are removed.

Defined results: null and empty texts are empty; texts shorter than ``length`` are never
cut; matches never cross documents; repeated rows are repeats of each other; rows of the
same id and text count as two places; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks
from .store import buckets, materialize
from .substring_index import row_key
from .textops import Poly, buffers, frugal, mix, slice_rows, slices

ANCHOR, CONTEXT, HIT, HOT = 0, 1, 2, 3
SHARD_SYMBOLS = 1 << 21
HOT_BYTES = 64 << 20  # of hot anchors' hashes that are broadcast; if there are more, all anchors are taken as hot

_GRAM, _TEXT, _SECOND = Poly(41), Poly(42), Poly(43)


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, by: Poly = _GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of window starts with the same anchor: first start, last start (inclusive), anchor position, anchor hash.

    Positions are in ``data``; no window crosses a row.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - gram + 1)
    h = by.spans(by.bytes(data), at, at + gram)
    bits = max(21, int(len(h) - 1).bit_length())  # the same for all slices, so that they agree on the smallest
    low = np.uint64((1 << bits) - 1)
    ranked = (h & ~low) | at.astype(np.uint64)  # leftmost of equals
    w = length - gram + 1
    pad = -len(ranked) % w
    grid = np.concatenate((ranked, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(ranked) - w + 1], ahead[w - 1 : len(ranked)]) & low
    # windows that stay in their row
    inside = np.ones(len(least), np.int32)
    for end in offsets[1:-1]:
        inside[max(0, end - length + 1) : end] = 0
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    anchor = least[starts].astype(np.int64)
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [len(starts) - 1]))
    anchor = anchor[first]
    return starts[first], starts[last], anchor, h[anchor]


def _twice(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value whether it occurs twice or more, and the index of the first of each distinct one and how often it occurs."""
    order = np.argsort(values, kind="stable")
    starts, counts = blocks.runs_of(values[order])
    many = np.zeros(len(values), bool)
    many[order] = np.repeat(counts > 1, counts)
    return many, order[starts] if len(starts) else np.zeros(0, np.int64), counts


@frugal
def _anchors(it: Iterator[pa.RecordBatch], length: int, gram: int, n: int, flush: int) -> Iterator[pa.RecordBatch]:
    """ANCHOR blocks: each distinct anchor once, with where it is if it was seen once; HIT blocks of those seen twice."""
    held, size = [], 0

    def out():
        h, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        many, one, times = _twice(h)
        found = blocks.locate(doc[many], tag[many], pos[many], n, HIT) if many.any() else []
        for b, i in blocks.by_bucket((h[one] % np.uint64(n)).astype(np.int64), n):
            k = one[i]
            single = k[~many[k]]
            found.append((ANCHOR, b, blocks.pack(h[k[many[k]]], blocks.narrow(times[i][many[k]]), h[single], doc[single], tag[single], blocks.narrow(pos[single]))))
        yield from blocks.rows(found)

    for batch in it:
        data, offsets = buffers(batch.column(2))
        ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets):
            part, offs = slice_rows(data, offsets, lo, hi)
            _, _, anchor, h = minimizers(part, offs, length, gram)
            # one anchor may serve two stretches: count it once
            anchor, k = np.unique(anchor, return_index=True)
            if len(anchor):
                row = np.searchsorted(offs, anchor, side="right") - 1
                held.append((h[k], ids[lo:hi][row], tags[lo:hi][row].astype(np.uint32), anchor - offs[row]))
                size += len(anchor)
            if size >= flush:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _repeated(it: Iterator[pa.RecordBatch], n: int, hot: int) -> Iterator[pa.RecordBatch]:
    """HIT blocks of anchors seen once by their task and by another one too; HOT blocks of anchors with more than ``hot`` places."""
    known: dict[int, list[list[np.ndarray]]] = {}
    for batch in it:
        yield batch.filter(pa.array(batch.column(0).to_numpy() == HIT))  # decided before
        for kind, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == ANCHOR:
                known.setdefault(b, []).append(blocks.unpack(blob.as_py()))
    for b in sorted(known):
        parts = known.pop(b)
        many, times, h, doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        all_, times = np.concatenate((h, many)), np.concatenate((np.ones(len(h), np.int64), times.astype(np.int64)))
        again, one, _ = _twice(all_)
        again = again[: len(h)]
        if len(one):
            order = np.argsort(all_, kind="stable")
            places = np.add.reduceat(times[order], blocks.runs_of(all_[order])[0])
            if (places > hot).any():
                yield from blocks.rows([(HOT, b, all_[one[places > hot]].tobytes())])
        if again.any():
            yield from blocks.rows(blocks.locate(doc[again], tag[again], pos[again].astype(np.int64), n, HIT))


def ranges(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """HIT blocks that carry ranges of window starts home."""
    home = (mix(doc.astype(np.uint64) ^ (tag.astype(np.uint64) << np.uint64(17))) % np.uint64(n)).astype(np.int64)
    out = []
    for b, i in blocks.by_bucket(home, n):
        out.append((HIT, b, blocks.pack(doc[i].astype(np.int64), tag[i].astype(np.uint32), blocks.narrow(first[i]), blocks.narrow(last[i]))))
    return out


def _regroup_ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its ranges as pairs."""
    parts = [blocks.unpack(x.as_py()) for batch in it for x in batch.column(batch.schema.get_field_index("blob"))]
    if not parts:
        return
    d, t, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((first, t, d))
    d, t, pairs = d[order], t[order], np.stack([first[order], last[order]], axis=1).astype("<u4")
    starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
    ends = np.concatenate((starts[1:], [len(d)]))
    for lo in range(0, len(starts), 1000):
        s, e = starts[lo : lo + 1000], ends[lo : lo + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(t[s].astype(np.int64)), pa.array([pairs[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary())], names=["key_id", "key_tag", "positions"])


def _split(part: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of hot anchors cut by a second anchor, the smallest gram of each string under another hash: first, last, and a hash of both anchors and their distance.

    Equal strings agree in both and in the distance, so they still meet.
    """
    sizes = last - first + length
    at = np.concatenate(([0], np.cumsum(sizes)))
    own = np.repeat(np.arange(len(first)), sizes)
    text = part[first[own] + np.arange(at[-1]) - at[own]]
    a, b, second, h2 = minimizers(text, at, length, gram, _SECOND)
    k = np.searchsorted(at, a, side="right") - 1
    shift = first[k] - at[k]
    away = (second + shift - anchor[k]).astype(np.uint64)
    return a + shift, b + shift, mix(h[k] ^ mix(h2 + away))


@frugal
def _contexts(it: Iterator[pa.RecordBatch], length: int, gram: int, n: int, flush: int, hot) -> Iterator[pa.RecordBatch]:
    """CONTEXT blocks of the stretches below repeated anchors; HIT blocks of those the task has seen twice. ``hot``: a broadcast of sorted hashes, or None for all."""
    held, texts, size = [], [], 0
    known = None if hot is None else hot.value

    def out():
        # d1: digest of the context; a: anchor hash; begin and end: its place in the joined text
        a, digest, doc, tag, first, last, begin, end = (np.concatenate(x) for x in zip(*held, strict=True))
        joined = np.concatenate(texts)
        many, one, _ = _twice(digest)
        found = ranges(doc[many], tag[many], first[many], last[many], n) if many.any() else []
        for b, i in blocks.by_bucket((a[one] % np.uint64(n)).astype(np.int64), n):
            k = one[i]
            text = b"".join(joined[begin[x] : end[x]].tobytes() for x in k.tolist())
            body = pa.compress(text, codec="zstd", asbytes=True)
            found.append((CONTEXT, b, blocks.pack(a[k], digest[k], many[k].astype(np.uint8), doc[k], tag[k], blocks.narrow(first[k]), blocks.narrow(end[k] - begin[k]), np.frombuffer(body, np.uint8))))
        yield from blocks.rows(found)

    for batch in it:
        data, offsets = buffers(batch.column(3))
        ids, tags = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        marks = batch.column(4)
        for lo, hi in slices(offsets):
            part, offs = slice_rows(data, offsets, lo, hi)
            first, last, anchor, h = minimizers(part, offs, length, gram)
            if not len(first):
                continue
            hit = np.zeros(len(part), bool)
            for i in range(lo, hi):
                if marks[i].is_valid:
                    hit[np.frombuffer(marks[i].as_py(), "<u4").astype(np.int64) + offs[i - lo]] = True
            keep = hit[anchor]
            first, last, anchor, h = first[keep], last[keep], anchor[keep], h[keep]
            if not len(first):
                continue
            wide = np.ones(len(h), bool) if known is None else np.isin(h, known)
            if wide.any():
                split = _split(part, first[wide], last[wide], anchor[wide], h[wide], length, gram)
                first, last, h = (np.concatenate((x[~wide], y)) for x, y in zip((first, last, h), split, strict=True))
            row = np.searchsorted(offs, first, side="right") - 1
            prefix = _TEXT.bytes(part)
            digest = _TEXT.spans(prefix, first, last + length) ^ h
            base = size
            held.append((h, digest, ids[lo:hi][row], tags[lo:hi][row].astype(np.uint32), first - offs[row], last - offs[row], first + base, last + length + base))
            texts.append(part)
            size += len(part)
            if size >= flush:
                yield from out()
                held, texts, size = [], [], 0
    if held:
        yield from out()


class RunIndex:
    """Run-length index of a collection of byte strings.

    ``heads``: for each run of the transform its symbol and length. ``before`` and
    ``after``: text positions of the first and last suffix of each run, with their
    longest common prefix with the neighbour outside the run.
    """

    def __init__(self, joined: np.ndarray, sizes: np.ndarray):
        n = len(joined) + len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1  # places of the separators, symbol 0
        text = np.zeros(n, np.uint16)
        body = np.ones(n, bool)
        body[self.ends] = False
        text[body] = joined.astype(np.uint16) + 1
        self.text = text
        order = self._suffixes(text)
        bwt = text[order - 1]
        bwt[order == 0] = 0xFFFF  # nothing stands before the first position
        head = np.concatenate(([0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1)) if n else np.zeros(0, np.int64)
        tail = np.concatenate((head[1:] - 1, [n - 1])) if n else head
        self.heads = (bwt[head], tail - head + 1)
        prefix = _TEXT.prefix(mix(text.astype(np.uint64) + np.uint64(1)))
        longest = int(sizes.max()) + 1 if n else 0  # no match of use is longer
        self.before = self._sampled(order[head], order[np.maximum(head - 1, 0)], head > 0, prefix, longest)
        self.after = self._sampled(order[tail], order[np.minimum(tail + 1, n - 1)], tail < n - 1, prefix, longest)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix positions in order, by ranks of 7 symbols, then of three times as many each round."""
        n = len(text)
        wide = np.concatenate((text, np.zeros(8, np.uint16))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | wide[k : k + n]
        width = 7
        while True:
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
            if width >= n or new[1:].all():
                return order
            rank = np.zeros(n + 2 * width, np.uint64)
            rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
            if n < SHARD_SYMBOLS:
                key = (rank[:n] << np.uint64(42)) | (rank[width : n + width] << np.uint64(21)) | rank[2 * width : n + 2 * width]
                width *= 3
            else:  # one anchor with very many contexts
                key = (rank[:n] << np.uint64(32)) | rank[width : n + width]
                width *= 2

    @staticmethod
    def _common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
        """Longest common prefixes of suffixes, at least up to ``longest``, by halving steps on hashes."""
        n = len(prefix) - 1
        room = n - np.maximum(a, b)
        got = np.zeros(len(a), np.int64)
        step = 1 << longest.bit_length()
        while step:
            k = np.flatnonzero(got + step <= room)
            x, y = a[k] + got[k], b[k] + got[k]
            same = _TEXT.spans(prefix, x, x + step) == _TEXT.spans(prefix, y, y + step)
            got[k[same]] += step
            step >>= 1
        return got

    def _sampled(self, at: np.ndarray, other: np.ndarray, valid: np.ndarray, prefix: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        common = np.where(valid, self._common(prefix, at, other, longest), 0)
        order = np.argsort(at)
        return at[order], common[order]

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match of its suffix anywhere else, within its string."""
        n = len(self.text)
        here = np.arange(n)
        best = np.zeros(n, np.int64)
        for at, common in (self.before, self.after):
            k = np.searchsorted(at, here, side="right") - 1
            ok = k >= 0
            best[ok] = np.maximum(best[ok], common[k[ok]] - (here[ok] - at[k[ok]]))
        room = self.ends[np.searchsorted(self.ends, here)] - here
        return np.minimum(best, room)


def repeats(joined: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (string, first start, last start) of strings of ``length`` bytes that the collection holds twice."""
    index = RunIndex(joined, sizes)
    long = np.flatnonzero(index.matching_statistics() >= length)
    if not len(long):
        return long, long, long
    which = np.searchsorted(index.ends, long)
    new = np.flatnonzero((np.diff(long) != 1) | (np.diff(which) != 0)) + 1
    a, b = np.concatenate(([0], new)), np.concatenate((new - 1, [len(long) - 1]))
    begin = np.concatenate(([0], index.ends[:-1] + 1))
    return which[a], long[a] - begin[which[a]], long[b] - begin[which[a]]


@frugal
def _indexed(it: Iterator[pa.RecordBatch], length: int, n: int) -> Iterator[pa.RecordBatch]:
    """A shard: distinct contexts by anchor, in indexes of a bounded size; HIT blocks of repeats in undecided contexts."""
    shards: dict[int, list[bytes]] = {}
    for batch in it:
        yield batch.filter(pa.array(batch.column(0).to_numpy() == HIT))  # decided before
        for kind, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == CONTEXT:
                shards.setdefault(b, []).append(blob.as_py())
    for b in sorted(shards):
        cols, text = [], []
        for blob in shards.pop(b):
            *own, size, body = blocks.unpack(blob)
            size = size.astype(np.int64)
            text.append(np.frombuffer(pa.decompress(body.tobytes(), decompressed_size=int(size.sum()), codec="zstd", asbytes=True), np.uint8))
            cols.append([*own, size])
        a, digest, decided, doc, tag, first, size = (np.concatenate(x) for x in zip(*cols, strict=True))
        first = first.astype(np.int64)
        text = np.concatenate(text)
        begin = np.cumsum(size) - size
        many, one, _ = _twice(digest)
        # equal contexts that several tasks sent
        k = np.flatnonzero(many & (decided == 0))
        if len(k):
            yield from blocks.rows(ranges(doc[k], tag[k], first[k], first[k] + size[k] - length, n))
        one = one[np.argsort(a[one], kind="stable")]
        # only anchors with two or more distinct contexts can hold further repeats
        starts, counts = blocks.runs_of(a[one])
        one = one[np.repeat(counts > 1, counts)]
        starts, counts = blocks.runs_of(a[one])
        upto = np.cumsum(size[one] + 1)
        lo = 0
        while lo < len(starts):
            base = upto[starts[lo]] - size[one[starts[lo]]] - 1
            hi = lo + 1
            while hi < len(starts) and upto[starts[hi] + counts[hi] - 1] - base <= SHARD_SYMBOLS - 2:
                hi += 1
            own = one[starts[lo] : starts[hi - 1] + counts[hi - 1]]
            lo = hi
            joined = np.concatenate([text[begin[x] : begin[x] + size[x]] for x in own.tolist()])
            which, s, e = repeats(joined, size[own], length)
            at = own[which]
            free = ~many[at] & (decided[at] == 0)
            at, s, e = at[free], s[free], e[free]
            if len(at):
                yield from blocks.rows(ranges(doc[at], tag[at], first[at] + s, first[at] + e, n))


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


@frugal
def _cut(it: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            texts, found = part.column(3), part.column(4)
            sizes, removed, spans, kept = [], [], [], []
            for i in range(len(part)):
                raw = (texts[i].as_py() or "").encode()
                own: list[tuple[int, int]] = []
                if found[i].is_valid:
                    for s, e in np.frombuffer(found[i].as_py(), "<u4").reshape(-1, 2).tolist():
                        if own and s <= own[-1][1]:
                            own[-1] = own[-1][0], max(own[-1][1], e + length)
                        else:
                            own.append((s, e + length))
                sizes.append(len(raw))
                removed.append(sum(e - s for s, e in own))
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in own], [s for s, _ in own] + [len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, CUT.field("spans").type), pa.array(kept, pa.binary())], schema=CUT)


def _hot(seen: DataFrame):
    """The hot anchors' sorted hashes, broadcast if they are within ``HOT_BYTES``; None, for all anchors, if not."""
    rows = seen.where(F.col("kind") == HOT)
    if (rows.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) > HOT_BYTES:
        return None
    found = [np.frombuffer(x.blob, np.uint64) for x in rows.select("blob").collect()]
    return seen.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.uint64), *found])))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, flush: int = 2_000_000, hot: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges removed, end exclusive), kept (the remaining bytes).

    ``hot``: places from which on an anchor is split.
    """
    n = buckets(docs)
    key_id, key_tag = row_key(doc_id, text)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_id.alias("key_id"), key_tag.alias("key_tag"), F.col(text).alias("text"))
    home = F.col("bucket")
    sent = base.select("key_id", "key_tag", "text").mapInArrow(partial(_anchors, length=length, gram=gram, n=n, flush=flush), blocks.SCHEMA)
    seen = materialize(sent.repartitionById(n, home).mapInArrow(partial(_repeated, n=n, hot=hot), blocks.SCHEMA), "anchors")
    marked = seen.where(F.col("kind") == HIT).repartitionById(n, home).mapInArrow(blocks.regroup, blocks.LOCATED)
    keys = ["key_id", "key_tag"]
    columns = ["doc_id", "key_id", "key_tag", "text", "positions"]
    contexts = base.join(marked, keys).select(columns).mapInArrow(partial(_contexts, length=length, gram=gram, n=n, flush=4 * flush, hot=_hot(seen)), blocks.SCHEMA)
    found = contexts.repartitionById(n, home).mapInArrow(partial(_indexed, length=length, n=n), blocks.SCHEMA)
    where = found.repartitionById(n, home).mapInArrow(_regroup_ranges, blocks.LOCATED)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return base.join(where, keys, "left").select(columns).mapInArrow(partial(_cut, length=length), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
