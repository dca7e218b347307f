import hashlib
import random

import numpy as np
import pytest

from mosaiq.llm import run_index as r


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, x in enumerate(raw):
        for k in range(len(x) - length + 1):
            seen.setdefault(x[k : k + length], []).append((i, k))
    gone = [bytearray(len(x)) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + length] = b"\1" * length
    out = []
    for x, g in zip(raw, gone, strict=True):
        kept = bytes(b for b, m in zip(x, g, strict=True) if not m)
        out.append((len(x), sum(g), bytes(g).replace(b"\1", b"1").replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted((str(x.doc_id), x.n_bytes, x.n_removed, len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    unit = bytes(rnd.choice(b"ab") for _ in range(12))
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 25))) + unit * rnd.randint(0, 3) for _ in range(rnd.randint(1, 12))]
    index = r.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]))
    stats = index.matching_statistics()
    at = 0
    for i, x in enumerate(strings):
        for k in range(len(x)):
            best = 0
            for j, y in enumerate(strings):
                for m in range(len(y)):
                    if (i, k) != (j, m):
                        n = 0
                        while k + n < len(x) and m + n < len(y) and x[k + n] == y[m + n]:
                            n += 1
                        best = max(best, n)
            assert stats[at + k] == best, (strings, i, k)
        at += len(x) + 1
    assert index.heads[1].sum() == at


def test_wide_ranks_agree(monkeypatch):
    rnd = random.Random(9)
    strings = [bytes(rnd.choice(b"abc") for _ in range(60)) for _ in range(20)]
    joined, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([60] * 20)
    one = r.RunIndex(joined, sizes).matching_statistics()
    monkeypatch.setattr(r, "SHARD_SYMBOLS", 10)
    assert (r.RunIndex(joined, sizes).matching_statistics() == one).all()


def test_minimizers_cover_each_window_once():
    rnd = np.random.default_rng(2)
    data = np.concatenate((rnd.integers(97, 100, 700), np.full(400, 97), rnd.integers(97, 123, 300))).astype(np.uint8)
    offsets = np.array([0, 30, 30, 700, 1100, 1400])
    first, last, anchor, _ = r.minimizers(data, offsets, 200, 64)
    seen = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert sorted(seen) == [p for lo, hi in zip(offsets, offsets[1:], strict=False) for p in range(lo, hi - 199)]
    assert all(a >= p and a + 64 <= p + 200 for f, e, a in zip(first, last, anchor, strict=True) for p in (f, e))


def test_against_brute_force(edge_docs, edge_rows, no_docs):
    want = sorted((str(x[0]), *b) for x, b in zip(edge_rows, brute([x[1] for x in edge_rows], 200), strict=True))
    assert got(r.remove_repeats(edge_docs)) == want
    assert sum(x[2] for x in want) > 1000 and len({x[3] for x in want}) > 2
    assert r.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("flush", [50, 2_000_000])
def test_short_strings_and_small_flushes(edge_docs, edge_rows, flush):
    """Nearly everything repeats, and tasks hold little at a time."""
    want = sorted((str(x[0]), *b) for x, b in zip(edge_rows, brute([x[1] for x in edge_rows], 24), strict=True))
    assert got(r.remove_repeats(edge_docs, length=24, gram=8, flush=flush)) == want


def anchor_line(rnd, n):
    """A line whose first gram has so small a hash that it is the anchor of nearly all strings that hold it."""
    lines = ["".join(rnd.choice("abcdefgh") for _ in range(n)) for _ in range(3000)]
    at = np.arange(3000) * n
    return lines[int(r._GRAM.spans(r._GRAM.bytes(np.frombuffer("".join(lines).encode(), np.uint8)), at, at + 64).argmin())]


@pytest.mark.parametrize("hot,hot_bytes", [(3, 1 << 20), (3, 0), (10**9, 1 << 20)])
def test_one_anchor_with_very_many_contexts(spark, monkeypatch, hot, hot_bytes):
    """A line that all texts share, in contexts of their own, and some true repeats around it."""
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    for line in (anchor_line(rnd, 64), anchor_line(rnd, 70), "x" * 90):
        around = [letters(150) + line + letters(150) for _ in range(3)]
        rows = [(k, letters(rnd.randint(0, 200)) + line + letters(rnd.randint(0, 200))) for k in range(300)]
        rows += [(1000 + k, letters(rnd.randint(0, 40)) + rnd.choice(around)[rnd.randint(0, 60) :]) for k in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = sorted((str(x[0]), *b) for x, b in zip(rows, brute([x[1] for x in rows], 200), strict=True))
        monkeypatch.setattr(r, "HOT_BYTES", hot_bytes)
        assert got(r.remove_repeats(df, hot=hot)) == want
        assert 20 < sum(x[2] > 0 for x in want) < 60


def test_a_hot_anchor_is_dealt_to_many_shards():
    rnd = random.Random(7)
    line = anchor_line(rnd, 64)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(200)) + line + "".join(rnd.choice("abcdefgh") for _ in range(200)) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    first, last, anchor, h = r.minimizers(data, np.arange(501) * 464, 200, 64)
    values, counts = np.unique(h, return_counts=True)
    hot = h == values[counts.argmax()]
    assert hot.sum() >= 400
    a, b, key = r._split(data, first[hot], last[hot], anchor[hot], h[hot], 200, 64)
    covered = lambda first, last: sorted(p for s, e in zip(first, last, strict=True) for p in range(s, e + 1))
    assert covered(a, b) == covered(first[hot], last[hot])
    assert np.unique(key, return_counts=True)[1].max() < 250 and len(np.unique(key)) > 500


def test_spans(spark):
    p = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(100))
    rows = [(1, f"xx{p}yy"), (2, f"{p[:250]}z"), (3, "é" * 300)]
    out = {x.doc_id: x for x in r.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[1].spans] == [(2, 252)] and [tuple(s) for s in out[2].spans] == [(0, 250)]
    assert [tuple(s) for s in out[3].spans] == [(0, 600)] and bytes(out[2].kept) == b"z"
