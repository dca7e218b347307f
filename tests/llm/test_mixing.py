import re
from collections import defaultdict

import pytest

from mosaiq.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    lo, hi = 0.0, 3.0 * (sum(sizes.values()) + 1)
    for _ in range(200):  # the level at which all is given out
        mid = (lo + hi) / 2
        if sum(min(3 * sizes[s], w[s] * mid) for s in order) < sum(sizes.values()):
            lo = mid
        else:
            hi = mid
    return {s: min(3 * sizes[s], w[s] * hi) for s in order}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5, None: 40}, {None: 7}, {"x": 0, "y": 9}, {"x": 0}, {}])
def test_targets(sizes):
    got = m.targets(sizes)
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_plan(edge_docs, edge_rows, no_docs):
    out = m.plan(edge_docs).collect()
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in edge_rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = m.plan(edge_docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert m.plan(no_docs).collect() == []


def test_positions_follow_demand(spark):
    rows = [(i, "w", "a") for i in range(2000)] + [(10_000 + i, "w", "b") for i in range(2000)]
    out = m.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    for s, w in (("a", (0.5, 1.0, 1.5)), ("b", (1.0, 1.0, 1.0))):
        early = sum(r.position < 0.5 for r in out if r.source == s) / 2000
        assert abs(early - m.demand(w)[1]) < 0.01
    got = [r.position for r in m.ordered(spark.createDataFrame(out)).collect()]
    assert got == sorted(got)


def test_mixed_takes_effect(spark, edge_docs, no_docs):
    rows = [(i, f"w{i} x y z", "a" if i % 10 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = defaultdict(int)
    out = m.mixed(df)
    assert out.columns == df.columns
    for r in out.collect():
        times[r.doc_id] += 1
    planned = {r.doc_id: r for r in m.plan(df).collect()}
    assert all(times[i] == int(p.taken / p.size + 0.5) for i, p in planned.items())
    assert m.mixed(edge_docs).columns == edge_docs.columns and m.mixed(edge_docs).count() > 0
    assert m.mixed(no_docs).collect() == []


def test_each_pass_has_its_positions(spark):
    """A source taken three times follows its demand over all of training, its copies apart."""
    rows = [(i, f"w{i}", "a") for i in range(400)] + [(1000 + i, "w " * 20, "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = [r for r in m.plan(df, weights=(3, 1)).collect() if r.source == "a"]
    assert all(r.passes == 3 and r.taken == 3 * r.size for r in planned)
    found = [p for r in planned for p in r.positions]
    assert len(found) == 1200 and all(r.position == r.positions[0] for r in planned)
    assert abs(sum(p < 0.5 for p in found) / 1200 - m.demand((0.5, 1.0, 1.5))[1]) < 0.01
    out = [r.doc_id for r in m.mixed(df, weights=(3, 1)).collect() if r.doc_id < 1000]
    assert len(out) == 1200 and all(len(set(out[k : k + 400])) == 400 for k in (0, 400, 800))


def test_repeated_rows_are_taken_as_planned(spark):
    """Rows that agree in id, text and source give as many copies as the mix takes of all of them, also fewer than rows."""
    rows = [(1, "a b c", "a", k) for k in range(100)] + [(2 + k, "w x y z " * 10, "b", 0) for k in range(3)] + [(50, "q r s", "c", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    for weights in ((1, 9, 1), (3, 1, 1), (1, 1, 30)):
        planned = m.plan(df, weights=weights).collect()
        out = m.mixed(df, weights=weights).collect()
        for i, size in ((1, 3), (50, 3)):
            taken = sum(r.taken for r in planned if r.doc_id == i)
            found = [r for r in out if r.doc_id == i]
            assert len(found) == int(taken / size + 0.5) and len({r.other for r in found}) <= 1
        by_source = {s: sum(r.taken for r in planned if r.source == s) for s in "abc"}
        for s, n in by_source.items():
            got = sum(len(WORD.findall(r.text)) for r in out if r.source == s)
            assert abs(got - n) <= 20 * len({r[0] for r in rows if r[2] == s})
