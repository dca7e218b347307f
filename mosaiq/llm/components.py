"""Connected components of an edge table, without gathering more nodes or edges anywhere than a fixed number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import materialize
from .textops import frugal

FEW = 1 << 16  # edges that one task joins at once: 1 MB, whatever the input


def _follow(step: DataFrame) -> DataFrame:
    """(node, label) two pointers on: each label is replaced by its own label."""
    return step.join(step.select(F.col("node").alias("at"), F.col("label").alias("beyond")), F.col("label") == F.col("at")).select("node", F.col("beyond").alias("label"))


@frugal
def _united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges of the only partition; label is the smallest node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in it:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, label) for every node of an undirected edge table; label is the component's smallest node.

    Each round points every node to the first of itself and its neighbours in the order
    of a hash (aggregated before the shuffle, so hubs are no hot groups), follows the
    pointers four steps, and contracts the edges: their ends become the nodes pointed
    to, and edges that have become equal, or loops, are dropped. So the edges of a round
    are those between what is not yet joined, and few rounds see many edges, however
    many edges a component has. Chains of pointers are short, as the hash's order is
    random to the edges; a longer one is only cut later. A path's image is a path, so
    contraction keeps what is connected, and the last node in the order always goes, so
    it ends. Lineage is cut by a round's written tables. Null ends are ignored.

    Rounds go on while there are more than ``few`` edges. Those that are left then, a
    bounded number, are joined by one task: each round costs the driver some twenty
    stages' tasks and plans, which it holds on to, for ever fewer edges.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while left.count() > few:
        twice = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        order = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("label"))
        first = materialize(twice.groupBy("node").agg(F.min(F.least(order("node"), order("other"))).label.alias("label")), "cc-first")
        step = materialize(_follow(_follow(first)), "cc-step")
        one, two = (step.select(F.col("node").alias(f"at_{x}"), F.col("label").alias(f"to_{x}")) for x in "ab")
        moved = left.join(one, F.col("a") == F.col("at_a")).join(two, F.col("b") == F.col("at_b")).where("to_a <> to_b")
        left = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = step
        else:
            labels = labels.join(one, F.col("label") == F.col("at_a"), "left").select("node", F.coalesce("to_a", "label").alias("label"))
    last = left.coalesce(1).mapInArrow(_united, "node bigint, label bigint")
    if labels is None:
        return materialize(last, "cc-labels")
    last = last.select(F.col("node").alias("at"), F.col("label").alias("to"))
    labels = materialize(labels.join(last, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
    smallest = labels.groupBy(F.col("label").alias("at")).agg(F.min("node").alias("smallest"))
    return materialize(labels.join(smallest, F.col("label") == F.col("at")).select("node", F.col("smallest").alias("label")), "cc-labels")
