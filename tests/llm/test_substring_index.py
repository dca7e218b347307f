import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import blocks
from mosaiq.llm.substring_index import WindowIndex, cut_points, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def brute(rows, width=13):
    docs = [(LAST if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, i), i)
    out = []
    for (i, w), r in zip(docs, rows, strict=True):
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), r[1], r[2], r[3]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect())


def test_against_brute_force(edge_docs, edge_rows):
    expected = brute(edge_rows)
    assert got(substring_dedup(edge_docs)) == expected
    assert sum(r[2] for r in expected) > 1000


def test_batches_runs_and_width_do_not_change_results(edge_docs, edge_rows):
    assert got(substring_dedup(edge_docs, width=5, batches=6, fanout=1)) == brute(edge_rows, 5)


def test_late_ids_are_refused(edge_docs):
    index = WindowIndex(3)
    index.append(edge_docs.where("doc_id BETWEEN 10 AND 30"))
    for late in ("doc_id = 4", "doc_id = 30", "doc_id = 20 OR doc_id = 70"):
        with pytest.raises(ValueError, match="comes after 30"):
            index.append(edge_docs.where(late))
    index.append(edge_docs.where("doc_id < 0"))
    index.append(edge_docs.where("doc_id IS NULL"))
    with pytest.raises(ValueError, match="comes after"):
        index.append(edge_docs.where("doc_id = 70"))


def test_tiers_and_a_manifest(spark, edge_docs, tmp_path):
    """Runs are merged by tier; an index opened again goes on and finds what the first session put in."""
    index = WindowIndex(3, fanout=2, folder=str(tmp_path / "runs"))
    tiers = []
    for lo, hi in ((0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, 60), (60, 70), (70, 80)):
        index.append(edge_docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)))
        tiers.append([t for t, _ in index.runs])
    assert tiers == [[0], [0, 0], [1], [1, 0], [1, 0, 0], [1, 1], [1, 1, 0], [1, 1, 0, 0]]
    index.save(spark, str(tmp_path / "manifest"))
    again = WindowIndex.open(spark, str(tmp_path / "manifest"))
    assert again.runs == index.runs and again.last == 79
    late = edge_docs.where("doc_id IN (4, 75)").withColumn("doc_id", F.col("doc_id") + 1000)
    found = {}
    for row in again.append(late).collect():
        d, _, c, _ = blocks.unpack(row.blob)
        for k, n in zip(d.tolist(), c.tolist(), strict=True):
            found[k] = found.get(k, 0) + n
    assert [t for t, _ in again.runs] == [2]
    words = {r.doc_id: len(WORD.findall(r.text)) for r in late.collect()}
    assert found == {k: n - 12 for k, n in words.items() if n > 12}


def test_removed_spans(spark):
    w = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(w[:15])), (2, "a b " + " ".join(w[:14]) + " c")], "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup(df).collect()}
    assert out[1].removed_spans == [] and [tuple(x) for x in out[2].removed_spans] == [(2, 16)]
    assert out[2].kept_text == "a b c"


def test_empty(no_docs):
    assert substring_dedup(no_docs).collect() == []
    assert cut_points(no_docs, "doc_id", 4) == []


def test_squeeze_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (blocks.expand(blocks.squeeze(x)) == x).all() and not len(blocks.expand(blocks.squeeze(x[:0])))
