"""MinHash near-duplicates with tensored banding and exact verification.

Tensoring: instead of one collection of minhashes for each table, two small sides
of ``side`` collections with ``rows`` minhashes each are drawn, and a table's key
joins one collection of either side. side * side tables thus cost 2 * side * rows
minhashes. A pair of similarity s is missed with a probability of at most
2 * (1 - s^rows)^side: 6e-4 at 0.8 and 7e-5 at 0.85 for 8 and 2, far less above.

1. One pass over the texts makes, for each document, a digest of its shingle set,
   the collections and a signature. Documents with equal sets are one node.
2. Table keys that occur once are dropped by a pre-aggregated count. A group of more
   than ``part`` nodes is dealt to parts by one more minhash, so that similar nodes
   stay together, and by a random salt; its most popular node (by the sizes of all
   its groups: the likely common ancestor) goes to every part.
3. In a part, nodes whose signatures are too far apart to be links are ruled out (an
   error of about 1e-6 at the threshold). Of the rest a part of few nodes keeps all
   pairs, a larger one a spanning forest of the nearest. So pairs are linear in the
   rows here, whatever the size of a group.
4. Pairs are verified on full shingle sets, each node's nearest partner first; of the
   others only those whose ends are still in different components.
5. The partners kept so far only save work. Groups that still hold several components
   are joined block by block, each block with every other, so that all nodes of such a
   group meet; a pair is judged in the first table it shares. Large groups of one
   collection's tables hold much the same nodes and are one group here. A part with few near pairs
   across components passes them on to be verified like the others. A part with many
   gets the full sets of the nodes concerned instead, verifies all its pairs itself
   (common elements by bits), and passes on only links that join two components. So rows
   stay linear in the nodes of a part, no pair is left out, and a pair is missed with
   the probability above, plus the error of step 3. The work, not the rows, is
   quadratic in the nodes outside of a group's largest component, and only there.

Defined results: null and empty texts have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle; a null id comes after all
others; repeated rows and equal sets are one node; an empty table gives an empty
result; other columns are kept where documents are filtered and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import materialize, partitions
from .substring_index import row_key
from .textops import LOWER, Poly, buffers, frugal, mix, seeds, slice_rows, slices, word_bounds

LAST = (1 << 63) - 1
_W, _S = Poly(21), Poly(22)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of the rows of a slice, and the rows' offsets in them."""
    s, e, first = word_bounds(data, offsets)
    words = _W.spans(_W.bytes(LOWER[data]), s, e)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    rows = np.repeat(np.arange(len(n)), n)
    begin = first[:-1][rows] + np.arange(len(rows)) - at[rows]
    return _S.spans(_S.prefix(words), begin, begin + np.minimum(width, counts[rows])), at


def _digest(own: np.ndarray) -> int | None:
    """64 bits that stand for a sorted shingle set; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


@frugal
def _sketch(it: Iterator[pa.RecordBatch], width: int, side: int, rows: int, m: int) -> Iterator[pa.RecordBatch]:
    factor, addend = seeds(m, 31), seeds(m, 32)
    for batch in it:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            found, at = shingles(*slice_rows(data, offsets, lo, hi), width)
            n = hi - lo
            full = np.flatnonzero(np.diff(at))
            least = np.zeros((m, n), np.uint64)
            if len(full):
                for k in range(m):  # the first 2 * side * rows serve the table keys, all the signature
                    least[k, full] = np.minimum.reduceat((found * factor[k] + addend[k]) >> np.uint64(24), at[full])
            size, node = [], []
            for i in range(n):
                own = np.unique(found[at[i] : at[i + 1]])
                size.append(len(own))
                node.append(_digest(own))
            keys = [mix(sum((least[c * rows + r] * np.uint64(2 * r + 3) for r in range(rows)), np.uint64(c))).view(np.int64) for c in range(2 * side)]
            stacked = np.stack(keys, axis=1)
            flat = pa.array(stacked.ravel())
            step = pa.array(np.arange(n + 1, dtype=np.int32) * (2 * side))
            sigs = np.ascontiguousarray(mix(least).astype(np.uint8).T).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(step, flat), pa.array([sigs[m * i : m * (i + 1)] for i in range(n)], pa.binary())],
                names=["doc_id", "key_tag", "node", "n_shingles", "keys", "sig"],
            )


@frugal
def _sets(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            found, at = shingles(*slice_rows(data, offsets, lo, hi), width)
            own = [np.unique(found[at[i] : at[i + 1]]) for i in range(hi - lo)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))], names=["node", "shingles"])


FEW = 8


def _forest(agree: np.ndarray, least: int) -> set[tuple[int, int]]:
    """A spanning forest of nearest pairs (Prim's way), of pairs with at least ``least`` agreements; it holds each node's nearest."""
    n = len(agree)
    np.fill_diagonal(agree, -1)
    out = set()
    near, to, open_ = agree[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    open_[0] = False
    for _ in range(n - 1):
        i = int(np.argmax(np.where(open_, near, -2)))
        if near[i] >= least:
            out.add((i, int(to[i])))
        open_[i] = False
        closer = agree[i] > near
        near[closer], to[closer] = agree[i][closer], i
    return out


@frugal
def _candidates(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b, agreements) of near nodes in the parts of a partition sorted by part."""
    held = None

    def pairs(part: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(part)])))
        small = np.repeat(sizes <= FEW, sizes)
        a, b, n = [], [], []
        for lag in range(1, FEW):
            i = np.flatnonzero(small[lag:] & (part[lag:] == part[:-lag]))
            agree = (sig[i] == sig[i + lag]).sum(axis=1)
            keep = agree >= least
            a.append(node[i[keep]])
            b.append(node[i[keep] + lag])
            n.append(agree[keep])
        for s, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            own = sig[s : s + size]
            agree = np.zeros((size, size), np.int16)
            for k in range(sig.shape[1]):
                agree += own[:, k][:, None] == own[:, k][None, :]
            found = _forest(agree, least)
            if found:
                i, j = np.array(sorted(found)).T
                a.append(node[s + i])
                b.append(node[s + j])
                n.append(agree[i, j])
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(n[keep].astype(np.int32))], names=["a", "b", "agree"])

    for batch in it:
        if not len(batch):
            continue
        part, node = (batch.column(k).to_numpy() for k in (0, 1))
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
        if held:
            part, node, sig = (np.concatenate(x) for x in zip(held, (part, node, sig), strict=True))
        cut = int(np.searchsorted(part, part[-1], side="left"))  # the last part may go on
        held = (part[cut:], node[cut:], sig[cut:])
        if cut:
            yield pairs(part[:cut], node[:cut], sig[:cut])
    if held:
        yield pairs(*held)


def _held_parts(it: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns of each part, whole, of a partition sorted by part (the first column)."""
    held = None
    for batch in it:
        if not len(batch):
            continue
        rows = columns(batch)
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        starts = np.concatenate(([0], np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1, [len(rows[0])])).tolist()
        for s, e in pairwise(starts[:-1]):
            yield [x[s:e] for x in rows]
        held = [x[starts[-2] :] for x in rows]  # the last part may go on
    if held:
        yield held


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _sketched(batch: pa.RecordBatch) -> list[np.ndarray]:
    """part, node, label, side, table, n_shingles, then signatures and keys as matrices."""
    n = len(batch)
    return [*(batch.column(k).to_numpy() for k in range(6)), np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(n, -1), _matrix(batch.column(7), n)]


def _meetings(label: np.ndarray, side: np.ndarray, table: int, size: np.ndarray, sig: np.ndarray, keys: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of one part, and their agreements: near, of different labels, across the two sides (or within the only one), and with no table before this one in common."""
    cut = int(np.searchsorted(side, 1))
    within = cut in (0, len(side))
    x, y = (slice(0, len(side)),) * 2 if within else (slice(0, cut), slice(cut, len(side)))
    m = keys.shape[1] // 2
    joint = table >= m * m  # tables of one collection in one
    # collections that both have only in a table before this
    before = [*range(table - m * m)] if joint else [*range(table // m), *range(m, m + table % m)]
    out = [(np.empty(0, np.int64),) * 3]
    for lo in range(x.start, x.stop, 256):
        u = slice(lo, min(lo + 256, x.stop))
        meet = label[u, None] != label[None, y]
        meet &= 100 * np.minimum(size[u, None], size[None, y]) >= percent * np.maximum(size[u, None], size[None, y])
        for k in before:
            meet &= keys[u, None, k] != keys[None, y, k]
        if joint:
            meet &= np.logical_or.reduce([keys[u, None, k] == keys[None, y, k] for k in range(m, 2 * m)])
        i, j = np.nonzero(meet)
        i, j = i + lo, j + y.start
        if within:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            agree = (sig[a] == sig[b]).sum(axis=1)
            keep = agree >= least
            out.append((a[keep], b[keep], agree[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@frugal
def _across_blocks(it: Iterator[pa.RecordBatch], least: int, percent: int, sparse: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b, agreements) of near nodes with different labels in a part; of a part with more than ``sparse`` for each row only the nodes in such pairs: (part, node, -1 - side - 2 * table)."""
    for part, node, label, side, table, size, sig, keys in _held_parts(it, _sketched):
        i, j, agree = _meetings(label, side, int(table[0]), size, sig, keys, least, percent)
        if len(i) <= sparse * len(part):
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        else:
            k = np.unique(np.concatenate((i, j)))
            a, b, agree = part[k], node[k], -1 - side[k] - 2 * table[k]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])


def common(sets: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, columns: int = 1 << 16) -> np.ndarray:
    """Sizes of the intersections of sets i and j: bits of the elements that several sets hold, ``columns`` of them at a time."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, at, times = np.unique(sets, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    row, at = row[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros(len(i), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        s, e = np.searchsorted(at, (lo, lo + columns))
        width = -(-(int(at[e - 1]) - lo + 1) // 64)
        bits = np.zeros((len(offsets) - 1, width), np.uint64)
        np.bitwise_or.at(bits, (row[s:e], (at[s:e] - lo) >> 6), np.uint64(1) << ((at[s:e] - lo) & 63).astype(np.uint64))
        step = max(1, (1 << 20) // width)
        for k in range(0, len(i), step):
            out[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


@frugal
def _dense_links(it: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of parts with many near pairs: links (a, b), exact on full sets, that join their labels as far as all links of the part do."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        sets = np.empty(len(batch), object)
        flat, ends = batch.column(8).flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(batch.column(8)).to_numpy())
        sets[:] = np.split(flat, ends[:-1])
        return [*_sketched(batch), sets]

    for _, node, label, side, table, size, sig, keys, sets in _held_parts(it, columns):
        i, j, _ = _meetings(label, side, int(table[0]), size, sig, keys, least, percent)
        n = common(np.concatenate(list(sets)), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), i, j)
        link = 100 * n >= percent * (size[i] + size[j] - n)
        up: dict[int, int] = {}
        found = []
        for u, v in zip(i[link].tolist(), j[link].tolist(), strict=True):
            ends = []
            for x in (label[u], label[v]):
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                ends.append(x)
            if ends[0] != ends[1]:
                up[max(ends)] = min(ends)
                found.append((int(node[u]), int(node[v])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])


def agreements(m: int, threshold: float, error: float = 1e-6) -> int:
    """The most agreements required of ``m`` minhashes that a pair at the threshold fails with less than ``error``."""
    from math import comb

    below, k = 0.0, 0
    while k < m:
        below += comb(m, k) * threshold**k * (1 - threshold) ** (m - k)
        if below >= error:
            break
        k += 1
    return k


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different nodes."""
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, agree), the nearest one of every node."""
    twice = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "agree").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "agree"))
    return _pairs(twice.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("agree", "other")).other.alias("b")))


HUB = 1000  # pairs of one node that one task verifies


def _with_sets(pairs: DataFrame, end: str, sets: DataFrame, name: str, plain: DataFrame) -> DataFrame:
    """The full set of one end of each pair; a node of more than ``HUB`` pairs (counted in ``plain``, the pairs alone) is copied to as many salts as its pairs need."""
    heavy = plain.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("_n")).where("_n > 1")
    dealt = pairs.join(heavy, end, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), "_n").cast("int"), F.lit(0))).drop("_n")
    copies = sets.join(heavy, sets.node == F.col(end), "left").select("node", F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_at"))
    return dealt.join(copies, (F.col(end) == F.col("node")) & (F.col("_salt") == F.col("_at"))).drop("node", "_salt", "_at")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union|, exactly."""
    plain = pairs.select("a", "b")
    both = _with_sets(_with_sets(plain, "b", sets, "y", plain), "a", sets, "x", plain).withColumn("n", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("n") >= percent * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far; a node without a label is its own."""
    one = labels.select(F.col("node").alias("_a"), F.col("label").alias("_x"))
    two = labels.select(F.col("node").alias("_b"), F.col("label").alias("_y"))
    df = pairs.join(one, pairs.a == F.col("_a"), "left").join(two, pairs.b == F.col("_b"), "left")
    return df.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).select(pairs.columns)


def _full_sets(base: DataFrame, nodes: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in ``ends``, from the texts."""
    owners = nodes.join(ends, "node", "left_semi").select(F.col("first").alias("owner")).distinct()
    texts = base.join(owners, F.coalesce("doc_id", F.lit(LAST)) == F.col("owner"), "left_semi")
    return materialize(texts.select("doc_id", "text").mapInArrow(partial(_sets, width=width), "node bigint, shingles array<bigint>").join(ends, "node", "left_semi").dropDuplicates(["node"]), "minhash-sets")


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The components' labels once ``links`` hold too: what is joined already counts by its labels, not by all its links."""
    return components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _linked(base: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, width: int, labels: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """The components' labels, joined further by verified links; of ``pairs`` none stays unverified whose ends are in different components."""
    sets = _full_sets(base, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), width)
    left = pairs
    for k in range(rounds):
        if labels is not None:
            left = materialize(_across(left, labels), "minhash-left")
        chosen = left.select("a", "b") if k == rounds - 1 else materialize(_nearest(left), "minhash-nearest")
        labels = _joined(materialize(_verified(chosen, sets, percent), "minhash-links"), labels)
    return labels


def _joint(grouped: DataFrame, side: int, block: int) -> DataFrame:
    """Table groups (key, table, node), those of over ``block`` nodes that share a collection of the first side in one group.

    The same nodes fill a large group in each of the ``side`` tables of a collection, so
    one group of all of them, numbered behind the tables, holds a row instead of many. It
    is made only where its pairs are no more than those of the groups it stands for.
    """
    rows = ["key", "table", "node"]
    large = grouped.where(F.col("n") > block)
    apart = large.select("upper", "key", "n").distinct().groupBy("upper").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    one = large.select("upper", "table", "node").groupBy("upper", "node").agg(F.floor(F.min("table") / side).cast("int").alias("i"))
    merged = one.groupBy("upper").agg(F.count(F.lit(1)).cast("double").alias("n")).join(apart, "upper").where("n * n <= apart").select("upper")
    joint = one.join(merged, "upper", "left_semi").select(F.col("upper").alias("key"), (F.col("i") + side * side).alias("table"), "node")
    others = large.join(merged, "upper", "left_anti")
    return grouped.where(F.col("n") <= block).select(rows).unionByName(others.select(rows)).unionByName(joint)


def _blocks(grouped: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(part, side, table, node, label) so that any two nodes of a group with different labels meet in a part.

    A group's largest component and its other nodes are dealt to blocks of about ``block``
    nodes; every block of the others meets every block, blocks of the largest component
    do not meet each other. A group of up to ``block`` nodes is one part, and groups of
    one component are left out.
    """
    one = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    named = grouped.join(one, F.col("node") == F.col("_node"), "left").select("key", "table", "node", F.coalesce("_label", "node").alias("label"))
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    count = lambda n: F.ceil(n / block).cast("int")
    split = most.select("key", (F.col("n") <= block).alias("whole"), F.col("top.label").alias("top"), count(F.col("n") - F.col("top.n")).alias("others"), count(F.col("top.n")).alias("tops"))
    rows = named.join(split, "key").withColumn("major", F.col("label") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.when(F.col("major"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
    own, none = F.col("own"), F.lit(1)
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    firsts = F.sequence(F.lit(0), F.col("others") - 1)
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda j: place(own, -1 - j, F.lit(0)))
    with_others = F.transform(firsts, lambda j: place(F.least(own, j), F.greatest(own, j), own > j))
    alone = F.array(place(F.lit(0), F.lit(0), F.lit(0)))
    places = F.when(F.col("whole"), alone).when(F.col("major"), F.transform(firsts, lambda j: place(j, -1 - own, none))).otherwise(F.concat(with_top, with_others))
    return rows.select("key", "table", "node", "label", F.explode(places).alias("p")).select(F.xxhash64("key", "p.x", "p.y").alias("part"), F.col("p.side").alias("side"), "table", "node", "label")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, side: int = 8, rows: int = 2, signature: int = 128, part: int = 256, block: int = 512, sparse: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (the smallest id linked to it, over any chain), label (its group), key_tag."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text)[1].alias("key_tag"))
    least = agreements(signature, percent / 100)
    sketched = materialize(base.mapInArrow(partial(_sketch, width=width, side=side, rows=rows, m=signature), "doc_id bigint, key_tag bigint, node bigint, n_shingles bigint, keys array<bigint>, sig binary"), "minhash")
    nodes = materialize(sketched.where("node IS NOT NULL").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "minhash-nodes")

    # 2. table groups of two or more, in parts
    one = nodes.select("node", F.posexplode(F.slice("keys", 1, side)).alias("i", "u"), F.slice("keys", side + 1, side).alias("vs"))
    keyed = one.select("node", "i", "u", F.posexplode("vs").alias("j", "v")).select("node", F.xxhash64("i", "u").alias("upper"), F.xxhash64("i", "j", "u", "v").alias("key"), (F.col("i") * side + F.col("j")).cast("int").alias("table"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = materialize(keyed.join(shared, "key"), "minhash-groups")
    popular = grouped.groupBy("node").agg(F.sum("n").alias("popularity"))
    large = grouped.where(F.col("n") > part)
    hubs = large.join(popular, "node").groupBy("key", "n").agg(F.max(F.struct("popularity", "node")).node.alias("node"))
    place = F.pmod(F.col("key"), F.lit(signature)).cast("int") + 1
    salt = F.when(F.col("n") > part, F.struct(F.substring("sig", place, 1).alias("like"), F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / part)).alias("dealt")))
    members = grouped.join(nodes.select("node", "sig"), "node").withColumn("salt", salt)
    parts = members.select("key", "salt", "node", "sig")
    everywhere = members.where("salt IS NOT NULL").select("key", "salt", "n").distinct().join(hubs, ["key", "n"]).join(nodes.select("node", "sig"), "node").select("key", "salt", "node", "sig")
    parts = parts.unionByName(everywhere).select(F.xxhash64("key", "salt").alias("part"), "node", "sig")
    dealt = parts.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "node")
    near = dealt.mapInArrow(partial(_candidates, least=least), "a bigint, b bigint, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    one, two = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    sized = near.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = materialize(sized.select("a", "b", "agree"), "minhash-pairs")

    # 3. verification on full sets
    labels = _linked(base, nodes, pairs, percent, width)

    # 4. groups of several components, block by block
    sketch = nodes.select("node", "n_shingles", "sig", "keys")
    blocks = _blocks(_joint(grouped, side, block), labels, block).join(sketch, "node")
    columns = ["part", "node", "label", "side", "table", "n_shingles", "sig", "keys"]
    n = partitions(docs.sparkSession)
    dealt = blocks.select(columns).repartition(n, "part").sortWithinPartitions("part", "side", "node")
    met = materialize(dealt.mapInArrow(partial(_across_blocks, least=least, percent=percent, sparse=sparse), "a bigint, b bigint, agree int"), "minhash-met")
    rest = met.where("agree >= 0").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    dense = met.where("agree < 0").select(F.col("a").alias("part"), F.col("b").alias("node"), F.pmod(-1 - F.col("agree"), F.lit(2)).alias("side"), F.floor((-1 - F.col("agree")) / 2).cast("int").alias("table"))
    if not dense.isEmpty():
        sets = _full_sets(base, nodes, dense.select("node").distinct(), width)
        known = labels.select("node", "label")
        held = dense.join(sketch, "node").join(sets, "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        held = held.select(*columns, "shingles").repartition(n, "part").sortWithinPartitions("part", "side", "node")
        found = materialize(held.mapInArrow(partial(_dense_links, least=least, percent=percent), "a bigint, b bigint"), "minhash-links")
        labels = _joined(found, labels)
        rest = _across(rest, labels)
    rest = materialize(rest, "minhash-rest")
    if not rest.isEmpty():
        labels = _linked(base, nodes, rest, percent, width, labels, rounds=1)

    whole = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    smallest = whole.groupBy("label").agg(F.min("first").alias("component_id"))
    named = whole.join(smallest, "label").select("node", "label", F.nullif("component_id", F.lit(LAST)).alias("component_id"))
    out = sketched.select("doc_id", "key_tag", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label", "key_tag")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, and all without words."""
    found = materialize(near_duplicates(docs, doc_id=doc_id, text=text, **options), "near-duplicates")
    key = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("i"), F.col("key_tag").alias("t"))
    first = found.where("label IS NOT NULL").groupBy("label").agg(F.min(key).alias("k")).select("k.i", "k.t")
    stay = first.unionByName(found.where("label IS NULL").select(key.alias("k")).select("k.i", "k.t").distinct())
    key_id, key_tag = row_key(doc_id, text)
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(F.struct("*").alias("row"), key_id.alias("i"), key_tag.alias("t"), worded.alias("worded"))
    rows = keyed.join(stay, ["i", "t"], "left_semi")
    # rows that agree in id and text are copies too, unless they have no words
    once = rows.where("worded").dropDuplicates(["i", "t"])
    return once.unionByName(rows.where("NOT worded")).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
