"""Images: generators in closed form, PPM files, packed pixel words.

A broken file gives a row with its error, and no pixels.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(x, y) of a raster, distributed."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def generated(spark: SparkSession, kind: str, width: int, height: int) -> DataFrame:
    """One of the synthetic rasters: host, flat, smooth-gradient, checkerboard, gradient, seeded-random."""
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    if kind == "host":
        check = F.when((_div(x, 8).bitwiseXOR(_div(y, 8))).bitwiseAND(1) != 0, 48).otherwise(0)
        r, g = _div(x * 255, max(width - 1, 1)), _div(y * 255, max(height - 1, 1))
        b = F.least(F.lit(255), _div((x + y) * 127, max(width + height - 2, 1)) + check)
    elif kind == "flat":
        r, g, b = F.lit(96), F.lit(144), F.lit(192)
    elif kind == "smooth-gradient":
        r, g, b = _div(x * 255, max(width - 1, 1)), _div(y * 255, max(height - 1, 1)), _div((x + y) * 255, max(width + height - 2, 1))
    elif kind == "checkerboard":
        one = (_div(x, 4) + _div(y, 4)) % 2 == 0
        r, g, b = F.when(one, 240).otherwise(16), F.when(one, 32).otherwise(224), F.when(one, 208).otherwise(48)
    elif kind == "gradient":
        v = (x * 13 + y * 17).bitwiseAND(255)
        r, g, b = v, 255 - v, _div(v, 2) + 64
    elif kind == "seeded-random":
        low = 0xFFFFFFFF
        s = (y * width + x).bitwiseXOR(F.lit(0x5EED1234))
        df = grid(spark, width, height).withColumn("s", s)
        for step in (lambda v: F.shiftleft(v, 13), lambda v: F.shiftrightunsigned(v, 17), lambda v: F.shiftleft(v, 5)):
            df = df.withColumn("s", F.col("s").bitwiseXOR(step(F.col("s"))).bitwiseAND(low))
        s = F.col("s")
        return df.select("x", "y", s.bitwiseAND(255).cast("int").alias("r"), F.shiftright(s, 8).bitwiseAND(255).cast("int").alias("g"), F.shiftright(s, 16).bitwiseAND(255).cast("int").alias("b"))
    else:
        raise ValueError(f"no generator {kind!r}")
    return grid(spark, width, height).select("x", "y", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


PPM = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])


def parse_ppm(data: bytes, max_width: int, max_height: int) -> tuple[int, int, bytes]:
    """Width, height and pixels of a binary PPM; raises ValueError with the rule that is violated."""
    tokens, at = [], 0
    while len(tokens) < 4:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end
            continue
        start = at
        while at < len(data) and not data[at : at + 1].isspace() and data[at : at + 1] != b"#":
            at += 1
        if start == at:
            raise ValueError("truncated header")
        tokens.append(data[start:at])
    if tokens[0] != b"P6":
        raise ValueError("magic is not P6")
    if not all(t.isdigit() for t in tokens[1:]):
        raise ValueError("header is not numeric")
    width, height, top = map(int, tokens[1:])
    if width < 1 or height < 1:
        raise ValueError("dimensions are not positive")
    if top != 255:
        raise ValueError("maximum value is not 255")
    if width > max_width or height > max_height:
        raise ValueError("image is too large")
    body = data[at + 1 :]
    if len(body) != 3 * width * height:
        raise ValueError("payload is truncated" if len(body) < 3 * width * height else "bytes after the payload")
    return width, height, body


def ppm(files: DataFrame, max_width: int = 1920, max_height: int = 1080) -> DataFrame:
    """(path, content) to (path, width, height, rgb, error)."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, *parse_ppm(content or b"", max_width, max_height), None))
                except ValueError as e:
                    rows.append((path, None, None, None, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(PPM.names, r, strict=True)) for r in rows], schema=PPM)

    return files.select("path", "content").mapInArrow(read, "path string, width int, height int, rgb binary, error string")


def pixels(images: DataFrame) -> DataFrame:
    """(path, width, height, rgb) to one row for each pixel."""
    at = F.col("i") * 6 + 1
    byte = lambda k: F.conv(F.substring(F.col("h"), at + 2 * k, F.lit(2)), 16, 10).cast("int")
    each = images.where("rgb IS NOT NULL").select("path", "width", F.hex("rgb").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return each.select("path", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))


def ppm_bytes(width: int, height: int, rgb: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (width, height) + rgb


def packed_words(rows: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Pixels (frame, x, y, r, g, b) to the transport's bytes: R, G, B, 0 for each pixel in raster order."""
    word = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")], F.lit("00"))
    line = rows.groupBy(frame, "y").agg(F.array_sort(F.collect_list(F.struct("x", word.alias("w")))).alias("ws"))
    line = line.select(frame, "y", F.array_join(F.transform("ws", lambda s: s.w), "").alias("l"))
    whole = line.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("y", "l"))).alias("ls"))
    return whole.select(frame, F.unhex(F.array_join(F.transform("ls", lambda s: s.l), "")).alias("words"))


def _write_local(folder: str):
    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for name, content in rows:
            part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.part")
            try:
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, os.path.join(folder, name))  # in one step: the old file or the new one
            finally:
                if os.path.exists(part):
                    os.remove(part)

    return run


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file for each (name, content) row, replaced in one step; of a name only its last part counts.

    A folder of a mounted file system is written by the executors, which must all see
    it. Other stores are written through the session's file system, one file at a time.
    """
    safe = F.regexp_extract(F.col(name), r"([^/]*)/*$", 1)
    picked = rows.select(safe.alias("name"), F.coalesce(F.col(content), F.lit(b"")).alias("content")).where(~F.col("name").isin("", ".", ".."))
    if "://" not in folder or folder.startswith("file:"):
        picked.foreachPartition(_write_local(re.sub("^file:/*", "/", folder)))
        return
    spark = rows.sparkSession
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    context = hadoop.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    over = gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    for r in picked.toLocalIterator():
        part = hadoop.Path(f"{folder}/.{r[0]}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(r[1]))
        finally:
            out.close()
        context.rename(part, hadoop.Path(f"{folder}/{r[0]}"), over)
