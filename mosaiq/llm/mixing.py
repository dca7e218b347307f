"""Mixing sources to target weights along a time-varying curriculum.

Targets: all sources' words are shared by weight; a source's target stops at
``most`` times its size and the excess is shared again. A source is taken in whole
passes, and one last partial pass in a hash order of its documents that ends at the
target's word.

Curriculum: each source has a weight at each knot of training time, linear between
knots. Its integral is the source's cumulative token demand; the share of its words
taken before a document, inverted through that integral, is the document's position
in training. Each pass over a source has its own share of the demand, so a document
has one position for each copy. Documents are range-sorted by their first position.

Running sums over a hot source are dealt to pieces (see ``prefix``); only the
totals of sources, one row each, come to the driver.

Defined results: null and empty texts have size 0, take nothing and get position 0
of their source's demand; a null source is a source of its own, ordered last;
repeated rows are planned each, interchangeably; an empty table gives an empty result; other
columns are kept where documents are mixed and ignored otherwise.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, functions as F

from .prefix import running
from .store import materialize, partitions
from .textops import WORD

WEIGHTS = (1, 2, 3)
KNOTS = (0.0, 0.5, 1.0)
MOST = 3.0


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Water-filling: shares by weight, each at most ``most`` times its source's size."""
    ordered = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    left, open_, out = float(sum(sizes.values())), list(ordered), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def schedules(ordered: list[str | None], knots: tuple[float, ...] = KNOTS) -> dict[str | None, tuple[float, ...]]:
    """The default curriculum: by turns rising, level and falling weights."""
    shapes = [tuple(0.5 + k for k in knots), tuple(1.0 for _ in knots), tuple(1.5 - k for k in knots)]
    return {s: shapes[i % 3] for i, s in enumerate(ordered)}


def demand(weights: tuple[float, ...], knots: tuple[float, ...] = KNOTS) -> list[float]:
    """The normalised integral of a piecewise linear weight at each knot."""
    out = [0.0]
    for (a, b), (u, v) in zip(pairwise(weights), pairwise(knots), strict=True):
        out.append(out[-1] + (a + b) / 2 * (v - u))
    return [x / out[-1] for x in out]


def inverse(share: Column, weights: Column, cumulative: Column, knots: tuple[float, ...] = KNOTS) -> Column:
    """The time at which the demand reaches ``share``: a root of a quadratic within its segment."""
    out = F.lit(1.0)
    for k in range(len(knots) - 2, -1, -1):
        width = knots[k + 1] - knots[k]
        c0, c1, a, b = cumulative[k], cumulative[k + 1], weights[k], weights[k + 1]
        part = F.when(c1 > c0, (share - c0) / (c1 - c0)).otherwise(0.0) * (a + b) / 2  # of the segment's area, width 1
        slope = b - a
        root = F.when(part <= 0, 0.0).otherwise(2 * part / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * part))))
        here = F.lit(knots[k]) + width * F.least(F.lit(1.0), F.greatest(F.lit(0.0), root))
        out = F.when(share <= c1, here).otherwise(out)
    return out


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each document: doc_id, text_hash, source, size, source_size, target, taken, position."""
    spark = docs.sparkSession
    sized = materialize(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    found = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    ordered = sorted((s for s in found if s is not None)) + [s for s in found if s is None]
    target, shape = targets(found, weights, most), schedules(ordered)
    rows = [(s, found[s], float(target[s]), [float(w) for w in shape[s]], demand(shape[s])) for s in ordered]
    per = spark.createDataFrame(rows, "_source string, source_size bigint, target double, _weights array<double>, _demand array<double>")
    df = running(sized, "source", ["doc_id", "text_hash", "size"], F.col("size"), "_before")
    df = df.join(per, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size")
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_before")))
    df = df.select("doc_id", "text_hash", "source", "size", "source_size", "target", (passes * F.col("size") + extra).alias("taken"), passes.alias("passes"), goal.alias("_goal"), (extra > 0).cast("int").alias("_last"), "_before", "_weights", "_demand")

    def at(k: Column) -> Column:
        share = F.when(F.col("_goal") > 0, F.least(F.lit(1.0), (k * F.col("source_size") + F.col("_before")) / F.col("_goal"))).otherwise(0.0)
        return inverse(share, F.col("_weights"), F.col("_demand"))

    # one position for each pass that takes words of the document, one at least
    positions = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("passes") + F.col("_last")) - 1), at)
    return df.withColumn("positions", positions).select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken", F.col("positions")[0].alias("position"), "passes", "positions")


def ordered(planned: DataFrame) -> DataFrame:
    """Range-sorted by training position."""
    return planned.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them: each as often as it is taken, rounded, in order of position.

    Rows that agree in id, text and source are one document: it comes as often as the
    mix takes of all of them together, rounded once, each time as the same one of them.
    """
    planned = plan(docs, doc_id=doc_id, text=text, source=source, **options)
    keys = ["doc_id", "text_hash", "source"]
    # all copies of a document take words in the order of their positions; rounded up, the last one is partial
    each = planned.where("size > 0").groupBy(*keys).agg(F.floor(F.sum("taken") / F.first("size") + 0.5).cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    each = each.where("copies > 0").withColumn("positions", F.slice("positions", 1, F.col("copies")))
    held = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("h"), F.col(source).cast("string").alias("s"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")) & F.col("s").eqNullSafe(F.col("source"))
    once = held.join(each.where("rows = 1"), same, "inner").select("row", "d", "positions")
    # of repeated rows one is chosen, in an aggregate that combines what a task sees first
    again = held.join(each.where("rows > 1").select(*keys), same, "left_semi").groupBy("d", "h", "s").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    again = again.join(each.where("rows > 1"), same, "inner").select("row", "d", "positions")
    out = once.unionByName(again).select("row", "d", F.posexplode("positions").alias("copy", "position"))
    # positions lie evenly in [0, 1], up to the weights' range: equal steps need no sampling of texts
    n = partitions(docs.sparkSession)
    step = F.least(F.lit(n - 1), F.floor(F.col("position") * n)).cast("int")
    return out.repartitionById(n, step).sortWithinPartitions("position", "d", "copy").select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ordered(planned).select("doc_id", "size", "source_size", "target", "taken", "source", "position", "passes", "positions")

