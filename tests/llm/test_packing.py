import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mosaiq.llm import packing as p

PATH = p.tokenizer_path()


def best(items, capacity):
    """The least number of sequences, by branch and bound."""
    items = sorted(items, reverse=True)
    least = [len(items)]

    def go(i, room):
        if len(room) >= least[0]:
            return
        if i == len(items):
            least[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= items[i]}.values():
            go(i + 1, room[:k] + [room[k] - items[i]] + room[k + 1 :])
        go(i + 1, room + [capacity - items[i]])

    go(0, [])
    return least[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(3)
    for _ in range(150):
        cap = rnd.choice([10, 17, 30])
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        counts = {k: items.count(k) for k in items}
        fixed, left = p.reduce_dominated(counts, cap)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + best(rest, cap) == best(items, cap), items
        table, sequences = p.lay_out(counts, cap)
        assert best(items, cap) <= sequences <= best(items, cap) + 1


def test_large_counts_are_fast_and_tight():
    rnd = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(np.minimum(2048, rnd.gamma(1.5, 500, 200_000).astype(int) + 1), return_counts=True), strict=True)}
    counts = {k: n * 1000 for k, n in counts.items()}
    _, sequences = p.lay_out(counts)
    bound = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sequences <= bound * 1.01 + 1


@pytest.mark.parametrize("counts", [{600: 10**9}, {600: 300_001}, {1: 10**9}, {2048: 10**9}, {700: 10**9, 600: 10**9 + 1, 90: 7}, dict.fromkeys(range(1, 2049), 10**9), {k: 10**9 + 7 * k % 13 for k in range(300, 1100)}])
def test_plan_does_not_grow_with_the_pieces(counts):
    begin = time.process_time()
    table, sequences = p.lay_out(counts)
    assert time.process_time() - begin < 3 and len(table) <= 64 * (len(counts) + 1)
    assert sequences >= -(-sum(k * n for k, n in counts.items()) // 2048)
    if len(counts) == 1:
        ((k, n),) = counts.items()
        assert sequences == -(-n // (2048 // k)) and len(table) <= 3


def test_ids_equal_the_tokenizers_own(edge_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in edge_rows] + ["<|endoftext|>it's<|startoftext|> x", "é ́a ΑΣ Σ b\x1cc", "İI ﬁ 12 3a"]
    ids, at = p.Encoder(PATH).encode([x.encode() for x in texts])
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], x[:50]


@pytest.mark.parametrize("capacity", [2048, 50])
def test_table(edge_docs, edge_rows, no_docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = p.pack_documents(edge_docs, PATH, capacity).collect()
    expected = []
    for r in edge_rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            expected.append((str(r[0]), k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= -(-sum(r.length for r in out) // capacity) * 1.1 + 1
    assert p.pack_documents(no_docs, PATH, capacity).collect() == []
