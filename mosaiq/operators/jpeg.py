"""The whole encoder: pixels and frame settings to JPEG streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import entropy, tiles, transform


def coefficients(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Quantized zig-zag blocks with their frame's restart interval."""
    settings = frames.select("frame_id", "quality", "restart_interval")
    return transform.coded(tiles.blocks(pixels, frames).join(settings, "frame_id"))


def encode_staged(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """The same streams as ``encode``, by the operators one after another."""
    return entropy.assembled(entropy.segments(coefficients(pixels, frames)), frames)


def _frame_stream(frame: pa.Table) -> pa.Table:
    width, height, subsample, quality, interval, jfif = (frame[c][0].as_py() for c in ("width", "height", "subsample", "quality", "restart_interval", "emit_jfif"))
    samples, component = tiles.frame_samples(*tiles.pixel_arrays(frame), width, height, subsample)
    n, k = samples.shape[:2]
    mcu, which = np.repeat(np.arange(n), k), np.tile(np.array(component), n)
    coeffs = transform.coded_samples(samples.reshape(-1, 64), which, np.full(n * k, quality))
    scans = entropy.encode_segments(mcu // interval if interval > 0 else np.zeros_like(mcu), which, coeffs)
    jpeg = entropy.stream(scans, width, height, quality, interval, subsample, jfif)
    return pa.table({"frame_id": pa.array([frame["frame_id"][0].as_py()], pa.int64()), "jpeg": pa.array([jpeg], pa.binary())})


def encode(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, jpeg) of all supported frames that have pixels.

    frames: frame_id bigint, width, height, quality, restart_interval int, subsample,
    emit_jfif boolean. Pixels outside their frame are dropped (see
    ``tiles.protocol_errors``). A frame must have all its pixels.

    Pixels cross the network once, by frame; a frame, whose size is bounded, goes from
    pixels to bytes in one Arrow call.
    """
    settings = frames.select("frame_id", F.col("quality").cast("int").alias("quality"), F.col("restart_interval").cast("int").alias("restart_interval"), "emit_jfif")
    rows = tiles.framed(pixels, frames).join(settings, "frame_id")
    return rows.groupBy("frame_id").applyInArrow(_frame_stream, "frame_id bigint, jpeg binary")


def sizes(streams: DataFrame) -> DataFrame:
    return streams.select("frame_id", F.octet_length("jpeg").cast("bigint").alias("n_bytes"), F.sha2("jpeg", 256).alias("sha256"))
