"""Running sums in groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def running(df: DataFrame, group: str, order: list[str], value: Column, out: str, least: int = 512) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before in a hash order of ``order``.

    A group of n rows is dealt by its hash order to n / max(``least``, sqrt(n))
    pieces, so pieces, and the list of pieces of one group, both stay near sqrt(n)
    however hot the group is. Piece sums are pre-aggregated before they are shuffled.
    Null is a group like any other. Rows that agree in all of ``order`` are
    interchangeable.
    """
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_g", F.ceil(F.col("_n") / F.greatest(F.lit(float(least)), F.sqrt("_n"))).alias("_pieces"))
    df = df.withColumn("_u", unit(*[F.col(c) for c in order])).withColumn("_v", value)
    df = df.join(n, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    df = df.withColumn("_piece", F.floor(F.col("_u") * F.col("_pieces")).cast("long"))
    sums = df.groupBy(F.col(group).alias("_g"), F.col("_piece").alias("_p")).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    df = df.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p")), "left")
    within = Window.partitionBy(group, "_piece").orderBy("_u", *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_g", "_p", "_u", "_v", "_pieces", "_piece", "_base")
