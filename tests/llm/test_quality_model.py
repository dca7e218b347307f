import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import quality_model as m
from mosaiq.llm.textops import buffers

from ..conftest import SF


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        good = rnd.random() < 0.7
        n = rnd.randint(5, 150)
        w = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9))) for _ in range(n)]
        if not good:
            kind = rnd.randrange(3)
            w = [x + "!!" for x in w] if kind == 0 else [x.upper() for x in w] if kind == 1 else [rnd.choice(w[:3]) for _ in w]
        docs.append((i, " ".join(w), "en", "s", n))
        if rnd.random() < 0.8:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    out = m.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    held = out[out.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93
    assert abs(held.score.mean() - held.quality.mean()) < 0.06  # calibrated


def test_held_out_labels_and_partitions_do_not_matter(spark, corpus):
    docs, labels = corpus
    one = {r.doc_id: r.score for r in m.classify(docs, labels).collect()}
    turned = labels.withColumn("quality", m.F.when(m.fold(m.F.col("doc_id")) == 2, 1 - m.F.col("quality")).otherwise(m.F.col("quality")))
    two = {r.doc_id: r.score for r in m.classify(docs.repartition(7), turned.repartition(5)).collect()}
    assert one == two


def test_isotonic_against_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        n = rnd.integers(1, 6, 7).astype(float)
        p = np.array([rnd.integers(0, int(k) + 1) for k in n], float)
        got = m.isotonic(n, p)
        # min-max formula
        want = [max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        assert np.allclose(got, want)


def test_features_approximate_a_gaussian_kernel():
    f = m.Fourier(np.zeros(5), np.ones(5), 20_000, 2.0)
    x = np.random.default_rng(2).normal(0, 0.5, (6, 5))
    phi = f(x)[:, :20_000] / m.ONE
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(2 * phi @ phi.T / 20_000 - want).max() < 0.05


def test_statistics_do_not_depend_on_neighbours(edge_rows):
    texts = [r[1] for r in edge_rows]
    together = m.statistics(*buffers(pa.array(texts)))
    alone = np.concatenate([m.statistics(*buffers(pa.array([t], pa.string()))) for t in texts])
    assert (together == alone).all() and together.shape[1] == len(m.STATISTICS)
    assert not together[[t is None for t in texts]].any()


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (12, 0, 0), (5, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = m.classify(edge_docs, labels).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
    none = m.classify(edge_docs, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert m.classify(no_docs, labels).collect() == []


def test_on_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = m.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.9
