"""Whole files as rows: texts, binaries, and which of the wanted ones are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of text files, one row each; bytes that are not UTF-8 are replaced."""
    return binaries(spark, path).select("path", F.decode("content", "UTF-8").alias("text"))


def binaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content), paths without their scheme. Spark reads no row of an empty file."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("path"), "content")


def missing(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted paths that were not found or are empty."""
    there = found.where(F.octet_length("content") > 0).select("path")
    return wanted.select("path").distinct().join(there, "path", "left_anti")


def captured(files: DataFrame, max_bytes: int, chunk: int = 4096) -> DataFrame:
    """(path, content) received streams to (path, jpeg, error): read by chunks up to the first end marker or ``max_bytes``.

    Bytes after the marker are an error if they came in its chunk; later ones are not read.
    """
    size, end = F.octet_length("content"), stream_end(F.substring("content", 1, max_bytes))
    upto = F.least(F.ceil(end / chunk) * chunk, size, F.lit(max_bytes))
    error = F.when(end == 0, F.lit(f"no end marker within {max_bytes} bytes")).when(end != upto, "bytes after the end marker")
    return files.select("path", F.when(error.isNull(), F.expr("content")).alias("jpeg"), end.alias("end"), error.alias("error")).select("path", F.when(F.col("error").isNull(), F.expr("substring(jpeg, 1, cast(end as int))")).alias("jpeg"), "error")


def stream_end(content: Column) -> Column:
    """Bytes up to and with the first FF D9 at a byte boundary, or 0: what a capture takes that only looks for the end marker."""
    return F.floor(F.length(F.regexp_extract(F.hex(content), "^((?:..)*?FFD9)", 1)) / 2)
