import random
import re

import corpus_pipeline as p
from mosaiq.llm import credentials, minhash, quality_model
from mosaiq.llm.store import materialize

from .test_minhash import brute

KEY = "token=abcdefghijklmnop"


def corpus(spark, folder):
    rnd = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrstl"]
    docs, labels = [], []
    for i in range(300):
        n = rnd.randint(30, 120)
        w = [rnd.choice(vocab) for _ in range(n)]
        good = i % 5 != 0
        if not good:
            w = [x + "###" for x in w]
        if i % 7 == 0:
            w.insert(9, KEY)
        docs.append((i, " ".join(w), "en", f"s{i % 3}" if i % 50 else None, 1))
        labels.append((i, int(good), 0))
    for i in range(300, 320):  # exact and near copies
        w = docs[i - 299][1].split()
        if i % 2:
            w[-1] = "changed"
        docs.append((i, " ".join(w), "en", "s1", 1))
    docs += [(320, None, "en", "s0", 0), (321, "", None, "s0", 0), docs[1], (None, docs[3][1], "en", "s0", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    kept = materialize(p.quality(spark, docs, str(tmp_path)), "t")
    assert kept.columns == columns
    scores = {r.doc_id: r.predicted for r in quality_model.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if scores[r[0]])
    ids = {r.doc_id for r in kept.collect()}
    assert not any(i % 5 == 0 for i in ids if i is not None and i < 300) and sum(i % 5 > 0 for i in ids if i is not None and i < 300) > 235

    one = materialize(p.near_duplicates(spark, kept, str(tmp_path)), "t")
    assert one.columns == columns
    left = sorted(str(r.doc_id) for r in one.collect())
    assert left == sorted({x[2] for x in brute([tuple(r) for r in kept.collect()])})

    clean = materialize(p.secrets(spark, one, str(tmp_path)), "t")
    assert clean.columns == columns and clean.count() == one.count()
    assert not any(KEY in r.text for r in clean.collect()) and any("[SECRET]" in r.text for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = materialize(p.mix(spark, clean, str(tmp_path)), "t")
    assert mixed.columns == columns and 0 < mixed.count() <= 3 * clean.count()
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, clean.collect()))

    packed = p.pack(spark, mixed, str(tmp_path)).collect()
    assert len(packed) >= mixed.count()
    held = {}
    for r in packed:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 2048
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_run_and_copies(spark, tmp_path):
    corpus(spark, tmp_path)
    assert p.run(spark, str(tmp_path)).count() > 100
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "minhash_near_dedup", "secret_scans", "source_mix", "best_fit_packing"]


def test_deduplicated_edges(spark, edge_docs, edge_rows, no_docs):
    out = minhash.deduplicated(edge_docs)
    assert out.columns == edge_docs.columns
    got = [tuple(r)[:2] for r in out.collect()]
    wordless = [r[:2] for r in edge_rows if not re.search(r"[^\x20\x09-\x0D]", r[1] or "")]
    first = ["None" if d == 1 << 63 else str(d) for d, _ in brute(edge_rows, 80, groups=True)]
    assert sorted(str(i) for i, t in got) == sorted(first + [str(r[0]) for r in wordless])
    assert minhash.deduplicated(no_docs).collect() == []
    assert credentials.redacted(no_docs, n_chars="n_chars").collect() == []
    assert quality_model.accepted(no_docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_near_copies_from_four_fifths(spark):
    """A pair between 0.80 and 0.85 is one document for the stage, one below stays two."""
    base = [f"w{k}" for k in range(104)]
    near, far = ([f"x{k}" if k in spots else x for k, x in enumerate(base)] for spots in ((20, 60), (10, 30, 50, 70)))
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(far))]
    assert [len(brute(rows, q, groups=True)) for q in (80, 85)] == [2, 3]
    out = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]
