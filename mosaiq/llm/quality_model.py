"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. One pass makes about two dozen statistics of each text, as integers.
2. Statistics are standardised by the learning rows' sums and mapped to ``features``
   cosines with fixed random frequencies, which approximates a Gaussian kernel.
3. Each partition adds up its part of the normal equations, and these parts are added
   by a pre-aggregated sum over (row, column). Features are rounded to 2^-12, so
   the sums are exact integers and do not depend on how rows are partitioned. Only
   the summed features x features matrix comes to the driver, which solves it.
4. On learning rows kept apart from the fit, scores are counted in ``bins`` bins, and
   pool-adjacent-violators makes them a non-decreasing probability.

All labelled learning rows take part, none are sampled. What comes to the driver has a
fixed size.

Learning rows are those whose crc32 of the id as text is not 2 modulo 4; of them,
remainder 3 calibrates. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have the statistics 0 and get a score like any
other; several labels of one id count each, null labels and ids not at all; a null id
is not held out; without labels of both classes every score is the share of label 1,
or 0.5 without labels; an empty table gives an empty result; other columns are kept
where documents are filtered and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import materialize
from .textops import Poly, buffers, frugal, slice_rows, slices, window_starts, word_bounds

SCALE = 10_000
ONE = 4096
_W, _S, _L = Poly(61), Poly(62), Poly(63)

CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "symbol": [ord(c) for c in "#*$%&<>"],
    "bar": [ord("|")],
    "shout": [ord("!")],
    "stop": [ord(c) for c in ".?"],
    "comma": [ord(c) for c in ",;:"],
    "quote": [ord(c) for c in "\"'()[]{}"],
    "other": [ord(c) for c in "+-/=@\\^_`~"],
    "wide": [*range(128, 256)],
}
STATISTICS = ["words", "bytes", "word_mean", "word_spread", *CLASSES, "newline", "variety", "neighbours", "repeats", "top", "dup_lines", "line_words", "short", "long"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Integer statistics (rows x STATISTICS) of the texts of a slice."""
    n = len(offsets) - 1
    s, e, first = word_bounds(data, offsets)
    words = np.diff(first).astype(np.float64)
    some = np.maximum(words, 1)
    size = np.diff(offsets).astype(np.float64)
    solid = np.maximum(1.0, np.add.reduceat(np.append((e - s).astype(np.float64), 0), np.minimum(first[:-1], len(s))) * (words > 0))
    lengths = np.append((e - s).astype(np.float64), 0)
    squares = np.add.reduceat(lengths * lengths, np.minimum(first[:-1], len(s))) * (words > 0)
    mean = np.where(words > 0, solid / some, 0)
    out = {"words": np.log1p(words), "bytes": np.log1p(size), "word_mean": mean / 10, "word_spread": np.sqrt(np.maximum(0, squares / some - mean * mean)) / 10}
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    for name, members in CLASSES.items():
        out[name] = np.minimum(1.0, 4 * counts[:, members].sum(axis=1) / solid)
    out["newline"] = np.minimum(1.0, 10 * counts[:, 10] / some)
    hashes = _W.spans(_W.bytes(data), s, e) if len(s) else np.zeros(0, np.uint64)
    at, rows = window_starts(first, 5)
    windows = _S.spans(_S.prefix(hashes), at, at + 5) if len(at) else np.zeros(0, np.uint64)
    edges = np.searchsorted(rows, np.arange(n + 1))
    variety, near, repeats, top, lines, per_line = (np.zeros(n) for _ in range(6))
    ends = np.flatnonzero(data == 10)
    prefix = _L.bytes(data)
    for i in range(n):
        w = hashes[first[i] : first[i + 1]]
        if not len(w):
            continue
        _, c = np.unique(w, return_counts=True)
        variety[i] = len(c) / np.sqrt(len(w)) / 10 if len(w) > 100 else len(c) / len(w)
        top[i] = c.max() / len(w)
        near[i] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
        own = windows[edges[i] : edges[i + 1]]
        if len(own):
            repeats[i] = 1 - len(np.unique(own)) / len(own)
        cuts = ends[np.searchsorted(ends, offsets[i]) : np.searchsorted(ends, offsets[i + 1])]
        a, b = np.concatenate(([offsets[i]], cuts + 1)), np.concatenate((cuts, [offsets[i + 1]]))
        full = b > a
        line = _L.spans(prefix, a[full], b[full])
        if len(line):
            lines[i] = 1 - len(np.unique(line)) / len(line)
            per_line[i] = np.log1p(len(w) / len(line)) / 5
    out |= {"variety": variety, "neighbours": near, "repeats": repeats, "top": top, "dup_lines": lines, "line_words": per_line}
    out["short"] = np.add.reduceat(np.append((lengths[:-1] <= 3).astype(np.float64), 0), np.minimum(first[:-1], len(s))) * (words > 0) / some
    out["long"] = np.minimum(1.0, 10 * np.add.reduceat(np.append((lengths[:-1] > 15).astype(np.float64), 0), np.minimum(first[:-1], len(s))) * (words > 0) / some)
    return np.rint(np.stack([out[k] for k in STATISTICS], axis=1) * SCALE).astype(np.int32)


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


@frugal
def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = buffers(batch.column(1))
        for lo, hi in slices(offsets):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _list(statistics(*slice_rows(data, offsets, lo, hi)))], names=["doc_id", "stats"])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_measure, "doc_id bigint, stats array<int>")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


class Fourier:
    """Standardised statistics to rounded random cosines, and a linear score over them."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int = 17):
        rnd = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.frequency = rnd.normal(0, 1 / width, (len(mean), features))
        self.phase = rnd.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + len(mean) + 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Rows of integers: the cosines, the clipped statistics themselves, and a one."""
        x = np.clip((stats - self.mean) / self.spread, -4, 4)
        parts = [np.cos(x @ self.frequency + self.phase), x / 4, np.ones((len(x), 1))]
        return np.rint(np.concatenate(parts, axis=1) * ONE)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self(stats) @ self.weights / ONE


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _equations(it: Iterator[pa.RecordBatch], fourier: Fourier) -> Iterator[pa.RecordBatch]:
    """One partition's sums of products, the label as the last column."""
    total = None
    for batch in it:
        if len(batch):
            phi = np.concatenate((fourier(_stats(batch.column(0))), ONE * batch.column(1).to_numpy().astype(np.float64)[:, None]), axis=1)
            part = np.rint(phi.T @ phi).astype(np.int64)  # below 2^53: exact
            total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32) * len(total) + j.astype(np.int32)), pa.array(total[i, j])], names=["cell", "value"])


def _score(it: Iterator[pa.RecordBatch], fourier: Fourier, knots: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if len(batch):
            raw = fourier.raw(_stats(batch.column(1)))
            score = np.interp(raw, knots, values) if len(knots) else np.full(len(raw), values[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), pa.array(score)], names=["doc_id", "raw", "score"])


def _raw(it: Iterator[pa.RecordBatch], fourier: Fourier) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if len(batch):
            yield pa.RecordBatch.from_arrays([pa.array(fourier.raw(_stats(batch.column(0)))), batch.column(1)], names=["raw", "label"])


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing shares nearest to positives / counts."""
    blocks: list[list[float]] = []
    for n, p in zip(counts.tolist(), positives.tolist(), strict=True):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks]) if blocks else np.zeros(0)


class Model:
    """A fitted classifier."""

    def __init__(self, fourier: Fourier, knots: np.ndarray, values: np.ndarray):
        self.fourier, self.knots, self.values = fourier, knots, values

    def score(self, measured: DataFrame) -> DataFrame:
        """doc_id, raw, score."""
        return measured.mapInArrow(partial(_score, fourier=self.fourier, knots=self.knots, values=self.values), "doc_id bigint, raw double, score double")


def fit(measured: DataFrame, labels: DataFrame, features: int = 192, width: float = 4.0, ridge: float = 1e-3, bins: int = 512, label: str = "quality") -> Model:
    """Learn from the labelled rows that are not held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = materialize(measured.join(own, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2").select("stats", "label", "fold"), "learning-rows")
    d = len(STATISTICS)
    place = [F.get("stats", F.lit(k)).cast("long") for k in range(d)]
    sums = rows.agg(F.count(F.lit(1)), F.sum("label"), *[F.sum(p) for p in place], *[F.sum(p * p) for p in place]).first()
    n, positive = sums[0], sums[1] or 0.0
    flat = np.array([positive / n if n else 0.5])
    if not 0 < positive < n:
        return Model(Fourier(np.zeros(d), np.ones(d), features, width), np.zeros(0), flat)
    mean = np.array([float(x) for x in sums[2 : 2 + d]]) / n
    spread = np.sqrt(np.maximum(np.array([float(x) for x in sums[2 + d :]]) / n - mean * mean, 1.0))
    fourier = Fourier(mean, np.maximum(spread, SCALE / 1000), features, width)

    cells = rows.where("fold <> 3").select("stats", "label").mapInArrow(partial(_equations, fourier=fourier), "cell int, value bigint")
    found = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()  # features squared
    m = len(fourier.weights) + 1
    if not len(found):
        return Model(fourier, np.zeros(0), flat)
    matrix = np.zeros(m * m)
    matrix[found["cell"].to_numpy()] = found["value"].to_numpy() / ONE**2
    matrix = matrix.reshape(m, m)
    matrix = np.triu(matrix) + np.triu(matrix, 1).T
    rows_n = matrix[m - 2, m - 2]
    weights = np.linalg.solve(matrix[:-1, :-1] + ridge * rows_n * np.eye(m - 1), matrix[:-1, -1])
    fourier.weights = np.rint(weights * 2**20) / 2**20  # a score is then an exact sum, in any order

    step = 2.0 / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("raw") + 0.5) / step)))
    apart = rows.where("fold = 3").select("stats", "label").mapInArrow(partial(_raw, fourier=fourier), "raw double, label double")
    counted = sorted((int(r[0]), r[1], r[2]) for r in apart.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)), F.sum("label")).collect())
    if not counted:
        return Model(fourier, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots = (np.array([c[0] for c in counted]) + 0.5) * step - 0.5
    values = isotonic(np.array([c[1] for c in counted], float), np.array([c[2] for c in counted], float))
    # a slight slope keeps the order of scores within flat parts
    values = 0.999 * values + 0.001 * np.clip((knots + 0.5) / 2, 0, 1)
    knots, values = np.concatenate(([-3.0], knots, [4.0])), np.concatenate(([values[0] * 0.999], values, [values[-1] + 0.001 * (1 - values[-1])]))
    return Model(fourier, knots, values)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, raw."""
    measured = materialize(measure(docs, doc_id, text), "statistics")
    scored = fit(measured, labels).score(measured)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw")


@frugal
def _accept(it: Iterator[pa.RecordBatch], at: int, fourier: Fourier, knots: np.ndarray, values: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = buffers(batch.column(at))
        for lo, hi in slices(offsets):
            raw = fourier.raw(statistics(*slice_rows(data, offsets, lo, hi)).astype(np.float64))
            score = np.interp(raw, knots, values) if len(knots) else np.full(len(raw), values[0])
            yield batch.slice(lo, hi - lo).filter(pa.array(score >= threshold))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more; a second scan scores them in place, without a shuffle of texts."""
    model = fit(materialize(measure(docs, doc_id, text), "statistics"), labels)
    return docs.mapInArrow(partial(_accept, at=docs.columns.index(text), fourier=model.fourier, knots=model.knots, values=model.values, threshold=threshold), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
