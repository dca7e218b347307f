import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import minhash as m, store
from mosaiq.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=85, groups=False):
    sets = [(LAST if r[0] is None else r[0], shingle_set(r[1])) for r in rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(i)] = find(j)
    if groups:  # the smallest (id, position) of each group of texts with words
        return sorted({min((d, j) for j, (d, y) in enumerate(sets) if y and find(j) == find(i)) for i, (_, x) in enumerate(sets) if x})
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    none = lambda d: "None" if d == LAST else str(d)
    return sorted((none(d), len(x), none(least[find(i)])) for i, (d, x) in enumerate(sets))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_against_brute_force(edge_docs, edge_rows, no_docs):
    assert got(m.near_duplicates(edge_docs, percent=85)) == brute(edge_rows)
    assert len({r[2] for r in brute(edge_rows)}) < len({r[0] for r in brute(edge_rows)}) - 10
    assert m.near_duplicates(no_docs).collect() == []


def test_large_family(spark):
    """Copies of one text, most within the threshold of it but not of each other, in parts of few nodes."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(m.near_duplicates(df, percent=85, part=32)) == brute(rows)


def test_large_family_below_the_threshold(spark):
    """A template shared by all, at a similarity below the threshold, and pairs of true copies within the family."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):
        w = list(base)
        spots = rnd.sample(range(2, 398, 5), 10)
        for at in spots[:5]:
            w[at] = f"x{k}"
        rows.append((2 * k, " ".join(w)))
        for at in spots[5:]:
            w[at] = f"y{k}"
        rows.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({r[2] for r in want}) > 100
    assert got(m.near_duplicates(df, percent=85, part=8, block=16)) == want


def test_partners_only_save_work(spark, monkeypatch):
    """A link that no node keeps as a partner is found all the same."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(f"x{k}" if i == 2 * k else w for i, w in enumerate(base))) for k in rnd.sample(range(60), 30)]
    want = brute(rows)
    assert len({r[2] for r in want}) < 30
    monkeypatch.setattr(m, "_candidates", lambda it, least: iter(()))
    assert got(m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)) == want


def test_dense_parts(spark):
    """Parts with many near pairs verify these themselves, whatever the size of a part and of a block."""
    rnd = random.Random(17)
    base = [f"w{k}" for k in range(300)]
    for percent, spots, block in ((80, 4, 512), (85, 3, 16)):
        rows = []
        for k in range(120):
            w = list(base)
            for at in rnd.sample(range(2, 298, 5), spots):
                w[at] = f"x{k if rnd.random() < 0.5 else k // 4}"
            rows.append((k, " ".join(w)))
        want = brute(rows, percent)
        assert 1 < len({r[2] for r in want}) < 115
        assert got(m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, block=block, sparse=0)) == want


def test_common_elements():
    rnd = random.Random(2)
    sets = [sorted({rnd.randrange(-300, 300) for _ in range(rnd.choice((0, 1, 40, 400)))}) for _ in range(30)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    i, j = np.triu_indices(30, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]
    flat = np.array([x for s in sets for x in s], np.int64)
    for columns in (64, 100, 1 << 16):
        assert m.common(flat, at, i, j, columns).tolist() == want


def test_set_of_few_words_and_case(spark):
    rows = [(1, "A b"), (2, "a  B"), (3, "a b c"), (4, "É x"), (5, "é x"), (6, "a b c d e"), (7, "a b c d e a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(m.near_duplicates(df, percent=85)) == brute(rows)


def test_candidates_across_batches():
    rnd = np.random.default_rng(1)
    n = 40
    sig = rnd.integers(0, 255, 64).astype(np.uint8)
    part = np.array([1] * 3 + [2] * 2 + [3] * 30 + [4] * 5)
    rows = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(n)), pa.array([sig.tobytes()] * n, pa.binary())], names=["part", "node", "sig"])
    for step in (1, 7, 40):
        out = pa.Table.from_batches(list(m._candidates(iter([rows.slice(i, step) for i in range(0, n, step)]), 39))).to_pylist()
        found = {(r["a"], r["b"]) for r in out}
        assert {(a, b) for a, b in found if a < 5} == {(0, 1), (0, 2), (1, 2), (3, 4)}
        assert all(part[a] == part[b] and a < b and 1 for a, b in found)
        seen = {5}
        for _ in range(30):
            seen |= {x for p in found if seen & set(p) for x in p}
        assert seen == set(range(5, 35))


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(70, 70), (None, 3)]
    rnd = random.Random(1)
    edges = [(b, a) if a and rnd.random() < 0.5 else (a, b) for a, b in edges]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {k: 1 for k in range(1, 60)} | {70: 70}


@pytest.mark.parametrize("few", [0, 1, 20, 1000])
def test_components_by_rounds_and_by_one_task(spark, few):
    rnd = random.Random(few)
    edges = [(rnd.randrange(-200, 200), rnd.randrange(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (900, None)]
    want: dict[int, int] = {x: x for e in edges if None not in e for x in e}
    for _ in want:
        for a, b in edges:
            if b is not None:
                want[a] = want[b] = min(want[a], want[b])
    out = components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()
    assert len(out) == len(want) and {r.node: r.label for r in out} == want
    assert components(spark.createDataFrame([], "a long, b long"), few=few).collect() == []


def test_few_edges_take_few_tables(spark, monkeypatch):
    """The driver holds each table's stages and plans: few edges are joined without rounds."""
    written = []
    monkeypatch.setattr("mosaiq.llm.components.materialize", lambda df, name, own=store.materialize: (written.append(name), own(df, name))[1])
    assert components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).where("label = 0").count() == 301
    assert len(written) == 2


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(230)]
    edges += [(1000 + i, 1000 + j) for i in range(30) for j in range(i)] + [(1029, 2000)] + [(i, i + 1) for i in range(2000, 2300)]
    want: dict[int, int] = {x: x for e in edges for x in e}
    for _ in want:
        before = dict(want)
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(want) and {r.node: r.label for r in out} == want


def test_large_groups_of_a_collection_are_one(spark):
    """Groups of much the same nodes are joined, groups of different nodes are not; no two nodes are parted."""
    side, block = 2, 4
    groups = {  # (upper, key): table, nodes
        (1, 10): (0, range(6)), (1, 11): (1, range(1, 7)),
        (2, 20): (2, range(10, 16)), (2, 21): (3, range(16, 22)), (2, 22): (3, range(22, 28)),
        (3, 30): (1, range(30, 33)),
    }
    rows = [(u, k, t, n, len(ns)) for (u, k), (t, ns) in groups.items() for n in ns]
    out = m._joint(spark.createDataFrame(rows, "upper long, key long, table int, node long, n long"), side, block).collect()
    got = {}
    for r in out:
        got.setdefault((r.key, r.table), []).append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == {(1, side * side): [*range(7)]} | {(k, t): [*ns] for (u, k), (t, ns) in groups.items() if u > 1}
