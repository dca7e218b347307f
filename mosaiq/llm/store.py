"""Where intermediate tables go, and how many partitions an exchange gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import materialize, release, shared_dir, write_shared, write_table

__all__ = ["buckets", "materialize", "partitions", "release", "shared_dir", "write_shared", "write_table"]

BUCKET_BYTES = 256 << 20  # of the input's files, for operators that hold a bucket in a task


def partitions(spark: SparkSession) -> int:
    """Partitions of an exchange: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame) -> int:
    """As many as the session sets, and more if the input is so large that a bucket would pass ``BUCKET_BYTES`` of it.

    The input's size is what the optimizer knows of it; a size it does not know is left out.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-size // BUCKET_BYTES) if 0 < size < 1 << 50 else 1)
