"""Pixels to 8x8 blocks: keys, edge replication, chroma averaging, gathering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import color, standard


def supported(frames: DataFrame, max_width: int = standard.MAX_WIDTH, max_height: int = standard.MAX_HEIGHT) -> DataFrame:
    """Add ``ok``: whether the encoder supports a frame's size."""
    return frames.withColumn("ok", F.coalesce((F.col("width") > 0) & (F.col("width") <= max_width) & (F.col("height") > 0) & (F.col("height") <= max_height), F.lit(False)))


def in_range(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels with ``valid``: inside their frame. Others are consumed and dropped, and mark the frame."""
    return pixels.join(frames.select("frame_id", "width", "height"), "frame_id").withColumn("valid", (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))


def protocol_errors(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Sticky error of each frame: any pixel out of range."""
    return in_range(pixels, frames).groupBy("frame_id").agg(F.bool_or(~F.col("valid")).alias("protocol_error"), F.count_if(F.col("valid")).alias("accepted"), F.count_if(~F.col("valid")).alias("dropped"))


def shifted(pixels: DataFrame) -> DataFrame:
    """Level-shifted Y, Cb and Cr of each pixel, in place of r, g and b."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return pixels.withColumns({"ys": color.luma(r, g, b) - 128, "cb": color.blue(r, g, b) - 128, "cr": color.red(r, g, b) - 128}).drop("r", "g", "b")


def _owned(at: str, size: str, step: Column) -> Column:
    """Padded coordinates that take their value from ``at``: itself, and at the edge all up to the next multiple of ``step``."""
    end = F.ceil(F.col(size) / step) * step - 1
    return F.sequence(F.col(at).cast("int"), F.when(F.col(at) == F.col(size) - 1, end).otherwise(F.col(at)).cast("int"))


def padded(samples: DataFrame) -> DataFrame:
    """Replicate the last column and row up to whole MCUs (8 or 16 pixels by ``subsample``); only edge pixels are multiplied."""
    side = F.when(F.col("subsample"), 16).otherwise(8)
    wide = samples.withColumn("x", F.explode(_owned("x", "width", side)))
    return wide.withColumn("y", F.explode(_owned("y", "height", side)))


def placed(samples: DataFrame) -> DataFrame:
    """(frame_id, mcu, blk, component, pos, v) of padded samples (frame_id, width, height, subsample, x, y, ys, cb, cr).

    Blocks of an MCU: with full chroma Y, Cb, Cr; else Y left, Y right, Y below left,
    Y below right, Cb, Cr, where chroma is the floored mean of 2x2 shifted samples.
    """
    sub = F.col("subsample")
    side = F.when(sub, 16).otherwise(8)
    mcu = (F.floor(F.col("y") / side) * F.ceil(F.col("width") / side) + F.floor(F.col("x") / side)).cast("bigint")
    inner_x, inner_y = F.col("x") % side, F.col("y") % side
    pos = ((F.col("y") % 8) * 8 + F.col("x") % 8).cast("int")
    keyed = samples.withColumns({"mcu": mcu, "ix": inner_x, "iy": inner_y})
    y = keyed.select("frame_id", "mcu", F.when(sub, 2 * F.floor(F.col("iy") / 8) + F.floor(F.col("ix") / 8)).otherwise(0).cast("int").alias("blk"), F.lit(0).alias("component"), pos.alias("pos"), F.col("ys").alias("v"))
    full = keyed.where(~sub).select("frame_id", "mcu", pos.alias("pos"), F.expr("stack(2, 1, cb, 2, cr) as (component, v)"))
    full = full.select("frame_id", "mcu", F.col("component").alias("blk"), "component", "pos", "v")
    half = keyed.where(sub).withColumn("pos", (F.floor(F.col("iy") / 2) * 8 + F.floor(F.col("ix") / 2)).cast("int"))
    half = half.groupBy("frame_id", "mcu", "pos").agg(F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))
    half = half.select("frame_id", "mcu", "pos", F.expr("stack(2, 1, cast(shiftright(cb, 2) as int), 2, cast(shiftright(cr, 2) as int)) as (component, v)"))
    half = half.select("frame_id", "mcu", (F.col("component") + 3).alias("blk"), "component", "pos", "v")
    return y.unionByName(full).unionByName(half)


def gathered(places: DataFrame) -> DataFrame:
    """One row for each block: ``samples``, its 64 values in raster order."""
    blocks = places.groupBy("frame_id", "mcu", "blk", "component").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return blocks.select("frame_id", "mcu", "blk", "component", F.transform("s", lambda p: p.v.cast("int")).alias("samples"))


def _inside(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Valid pixels of supported frames, with their frame's width, height and mode."""
    good = supported(frames).where("ok").select("frame_id", "width", "height", "subsample")
    rows = pixels.join(good, "frame_id")
    return rows.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))


def blocks_relational(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """The blocks by relational steps alone, a row for each sample; says the same as ``blocks``."""
    return gathered(placed(padded(shifted(_inside(pixels, frames)))))


BLOCK = "frame_id bigint, mcu bigint, blk int, component int, samples array<int>"


def _averaged(plane: np.ndarray) -> np.ndarray:
    """2x2 means, floored."""
    return (plane[0::2, 0::2] + plane[0::2, 1::2] + plane[1::2, 0::2] + plane[1::2, 1::2]) >> 2


def _cut(plane: np.ndarray) -> np.ndarray:
    """A plane as 8x8 blocks (rows, columns, 64)."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(h // 8, w // 8, 64)


def frame_samples(x: np.ndarray, y: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray, width: int, height: int, subsample: bool) -> tuple[np.ndarray, list[int]]:
    """Blocks (mcu, blk, 64) of one frame from its pixels in any order, and the components of an MCU's blocks."""
    planes = []
    for v in ((77 * r + 150 * g + 29 * b) >> 8, ((-43 * r - 85 * g + 128 * b) >> 8) + 128, ((128 * r - 107 * g - 21 * b) >> 8) + 128):
        plane = np.zeros((height, width), np.int32)
        plane[y, x] = np.clip(v, 0, 255) - 128
        side = 16 if subsample else 8
        planes.append(np.pad(plane, ((0, -height % side), (0, -width % side)), mode="edge"))
    first = _cut(planes[0])
    if not subsample:
        rows, cols = first.shape[:2]
        return np.concatenate([_cut(p).reshape(rows * cols, 1, 64) for p in planes], axis=1), [0, 1, 2]
    rows, cols = first.shape[0] // 2, first.shape[1] // 2
    luma = first.reshape(rows, 2, cols, 2, 64).swapaxes(1, 2).reshape(rows * cols, 4, 64)
    return np.concatenate([luma, *(_cut(_averaged(p)).reshape(rows * cols, 1, 64) for p in planes[1:])], axis=1), [0, 0, 0, 0, 1, 2]


def pixel_arrays(frame: pa.Table) -> list[np.ndarray]:
    return [frame[c].to_numpy().astype(np.int32) for c in ("x", "y", "r", "g", "b")]


def _frame_blocks(frame: pa.Table) -> pa.Table:
    samples, component = frame_samples(*pixel_arrays(frame), *(frame[c][0].as_py() for c in ("width", "height", "subsample")))
    n, k = samples.shape[:2]
    ends = pa.array(np.arange(n * k + 1, dtype=np.int32) * 64)
    return pa.table(
        {
            "frame_id": pa.array(np.full(n * k, frame["frame_id"][0].as_py())),
            "mcu": pa.array(np.repeat(np.arange(n), k)),
            "blk": pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
            "component": pa.array(np.tile(np.array(component, np.int32), n)),
            "samples": pa.ListArray.from_arrays(ends, pa.array(samples.ravel())),
        }
    )


def framed(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Valid pixels of supported frames as plain numbers, with their frame's size and mode."""
    return _inside(pixels, frames).select(F.col("frame_id").cast("bigint").alias("frame_id"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "g", "b", "width", "height")], "subsample")


def blocks(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Blocks of all supported frames; frames (frame_id, width, height, subsample), pixels (frame_id, x, y, r, g, b).

    A pixel crosses the network once, as six numbers; a frame, whose size is bounded, is
    cut in one Arrow call. ``blocks_relational`` would send a row for each sample.
    """
    return framed(pixels, frames).groupBy("frame_id").applyInArrow(_frame_blocks, BLOCK)
