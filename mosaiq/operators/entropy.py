"""Entropy coding: symbols, tokens, bit runs, packed segments, assembled streams.

Two forms: a relational one (windows over coefficients, ordered string aggregation),
and ``segments``, one Arrow call for each frame, whose size is bounded by the largest
supported frame; all its restart segments are packed in one vectorised pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import color, standard


def huffman_table(spark: SparkSession) -> DataFrame:
    """(luma, dc, symbol, code, length): 348 rows."""
    rows = [(luma, dc, s, c, n) for luma in (True, False) for dc in (True, False) for s, (c, n) in standard.codes(luma, dc).items()]
    return spark.createDataFrame(rows, "luma boolean, dc boolean, symbol int, code int, length int")


def with_segments(blocks: DataFrame) -> DataFrame:
    """Add ``segment``: the restart segment of an MCU."""
    return blocks.withColumn("segment", F.when(F.col("restart_interval") > 0, F.floor(F.col("mcu") / F.col("restart_interval"))).otherwise(0).cast("int"))


def dc_differences(blocks: DataFrame) -> DataFrame:
    """Add ``diff``: the DC value less the previous one of the same component and segment."""
    order = Window.partitionBy("frame_id", "segment", "component").orderBy("mcu", "blk")
    return blocks.withColumn("diff", F.col("dc") - F.coalesce(F.lag("dc").over(order), F.lit(0)))


def ac_events(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Run-length events (keys, tok, symbol, value) of zig-zag values (keys, k, c), k from 1 to 63.

    Sixteen zeros before a later value are one 0xF0; an end of block follows unless the
    last place holds a value. ``tok`` orders them within their block.
    """
    order = Window.partitionBy(*keys).orderBy("k")
    solid = coefficients.where((F.col("k") > 0) & (F.col("c") != 0))
    gaps = solid.withColumn("gap", F.col("k") - F.coalesce(F.lag("k").over(order), F.lit(0)) - 1)
    zrl = gaps.where("gap > 15").select(*keys, F.explode(F.expr("sequence(1, cast(gap div 16 as int))")).alias("i"), "k", "gap")
    zrl = zrl.select(*keys, ((F.col("k") - F.col("gap") + F.col("i") * 16) * 2 - 1).cast("int").alias("tok"), F.lit(0xF0).alias("symbol"), F.lit(0).cast("bigint").alias("value"))
    runs = gaps.select(*keys, (F.col("k") * 2).cast("int").alias("tok"), ((F.col("gap") % 16) * 16 + color.category(F.col("c"))).cast("int").alias("symbol"), F.col("c").cast("bigint").alias("value"))
    last = coefficients.groupBy(*keys).agg(F.max(F.when((F.col("k") > 0) & (F.col("c") != 0), F.col("k")).otherwise(0)).alias("last"))
    eob = last.where("last < 63").select(*keys, F.lit(999).alias("tok"), F.lit(0).alias("symbol"), F.lit(0).cast("bigint").alias("value"))
    return runs.unionByName(zrl).unionByName(eob)


def tokens(blocks: DataFrame) -> DataFrame:
    """Huffman tokens of blocks (frame_id, mcu, blk, component, restart_interval, coeffs).

    Columns frame_id, segment, mcu, blk, tok, bits (text of 0 and 1: the code, then the
    amplitude). A value without a code gives null bits.
    """
    keys = ["frame_id", "segment", "mcu", "blk", "component"]
    cut = with_segments(blocks)
    dc = dc_differences(cut.select(*keys, F.get("coeffs", F.lit(0)).cast("bigint").alias("dc")))
    dc = dc.select(*keys, F.lit(0).alias("tok"), F.lit(True).alias("dc"), color.category(F.col("diff")).alias("symbol"), F.col("diff").alias("value"))
    each = cut.select(*keys, F.posexplode("coeffs").alias("k", "c"))
    ac = ac_events(each, keys).withColumn("dc", F.lit(False))
    all_ = dc.unionByName(ac.select(*dc.columns)).withColumn("luma", F.col("component") == 0)
    table = F.broadcast(huffman_table(blocks.sparkSession))  # 348 rows
    coded = all_.join(table, ["luma", "dc", "symbol"], "left")
    size = F.when(F.col("dc"), F.col("symbol")).otherwise(F.col("symbol") % 16).cast("int")
    size = F.when(F.col("symbol") == 0xF0, 0).otherwise(size)
    code = F.lpad(F.bin(F.col("code").cast("bigint")), F.col("length"), F.lit("0"))
    extra = F.when(size > 0, F.lpad(F.bin(color.amplitude(F.col("value"))), size, F.lit("0"))).otherwise("")
    return coded.select("frame_id", "segment", "mcu", "blk", "tok", F.concat(code, extra).alias("bits"))


def bit_offsets(rows: DataFrame) -> DataFrame:
    """Add ``offset``: bits of the segment before a token."""
    order = Window.partitionBy("frame_id", "segment").orderBy("mcu", "blk", "tok").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("bits")).over(order), F.lit(0)))


def packed_relational(rows: DataFrame) -> DataFrame:
    """Segments as upper-case hex: padded with ones to whole bytes, each FF followed by 00."""
    joined = rows.groupBy("frame_id", "segment").agg(F.array_sort(F.collect_list(F.struct("mcu", "blk", "tok", "bits"))).alias("t"))
    bits = joined.select("frame_id", "segment", F.array_join(F.transform("t", lambda t: t.bits), "").alias("bits"))
    whole = bits.withColumn("bits", F.expr("rpad(bits, cast(ceil(length(bits) / 8) * 8 as int), '1')"))
    one = whole.select("frame_id", "segment", F.posexplode(F.expr("transform(sequence(0, cast(length(bits) / 8 as int) - 1), i -> substring(bits, i * 8 + 1, 8))")).alias("i", "byte"))
    byte = F.lpad(F.conv("byte", 2, 16), 2, "0")
    stuffed = one.select("frame_id", "segment", "i", F.when(byte == "FF", "FF00").otherwise(byte).alias("h"))
    out = stuffed.groupBy("frame_id", "segment").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("hs"))
    return out.select("frame_id", "segment", F.array_join(F.transform("hs", lambda s: s.h), "").alias("scan_hex"))


_LENGTHS: dict[tuple[bool, bool], tuple[np.ndarray, np.ndarray]] = {}


def _codes(luma: bool, dc: bool) -> tuple[np.ndarray, np.ndarray]:
    if (luma, dc) not in _LENGTHS:
        code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, (c, n) in standard.codes(luma, dc).items():
            code[s], length[s] = c, n
        _LENGTHS[luma, dc] = code, length
    return _LENGTHS[luma, dc]


def _bits_of(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def encode_segments(segment: np.ndarray, component: np.ndarray, coeffs: np.ndarray, step: int = 1 << 17) -> list[bytes]:
    """Scan bytes of each segment: (n,) ascending segments, (n,) components, (n, 64) zig-zag values, blocks in scan order."""
    n = len(segment)
    if not n:
        return []
    fresh = np.concatenate(([True], segment[1:] != segment[:-1]))
    ordinal = np.cumsum(fresh) - 1
    diff = np.zeros(n, np.int64)
    for c in range(3):
        own = np.flatnonzero(component == c)
        dc = coeffs[own, 0].astype(np.int64)
        diff[own] = dc
        diff[own[1:]] -= np.where(ordinal[own[1:]] == ordinal[own[:-1]], dc[:-1], 0)
    luma = component == 0
    block, k = np.nonzero(coeffs[:, 1:])
    k += 1
    value = coeffs[block, k].astype(np.int64)
    first = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    gap = k - np.where(first, 0, np.concatenate(([0], k[:-1]))[: len(k)]) - 1
    size = _bits_of(value)
    zeros = gap // 16
    zb, zk = np.repeat(block, zeros), np.repeat(k, zeros)
    zi = np.arange(len(zb)) - np.repeat(np.cumsum(zeros) - zeros, zeros)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    eb = np.flatnonzero(last < 63)
    ds = _bits_of(diff)
    at = np.concatenate((np.arange(n), block, zb, eb))
    place = np.concatenate((np.zeros(n, np.int64), k * 64 + 63, zk * 64 + zi, np.full(len(eb), 1 << 20)))
    symbol = np.concatenate((ds, (gap % 16) * 16 + size, np.full(len(zb), 0xF0), np.zeros(len(eb), np.int64)))
    size = np.concatenate((ds, size, np.zeros(len(zb) + len(eb), np.int64)))
    value = np.concatenate((diff, value, np.zeros(len(zb) + len(eb), np.int64)))
    dc = np.concatenate((np.ones(n, bool), np.zeros(len(at) - n, bool)))
    order = np.lexsort((place, at))
    at, symbol, size, value, dc = (x[order] for x in (at, symbol, size, value, dc))
    if (size[dc] > 11).any() or (size[~dc] > 10).any():
        raise ValueError("a coefficient is outside the baseline range")
    code, length = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for is_luma in (True, False):
        for is_dc in (True, False):
            own = (luma[at] == is_luma) & (dc == is_dc)
            c, m = _codes(is_luma, is_dc)
            code[own], length[own] = c[symbol[own]], m[symbol[own]]
    run = (code << size) | np.where(value >= 0, value, value + (1 << size) - 1)
    width = length + size
    # every segment starts at a whole byte; what it leaves of its last byte stays ones
    part = ordinal[at]
    used = np.bincount(part, weights=width, minlength=int(ordinal[-1]) + 1).astype(np.int64)
    size_bytes = -(-used // 8)
    begin = np.cumsum(size_bytes) - size_bytes
    start = np.cumsum(width) - width
    start += (begin * 8 - (np.cumsum(used) - used))[part]
    bits = np.ones(int(size_bytes.sum()) * 8, np.uint8)
    for lo in range(0, len(run), step):  # spread a bounded number of tokens at a time
        w = width[lo : lo + step]
        row = np.repeat(np.arange(lo, lo + len(w)), w)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        bits[start[row] + inner] = (run[row] >> (width[row] - 1 - inner)) & 1
    raw = np.packbits(bits).tobytes()
    return [raw[i : i + m].replace(b"\xff", b"\xff\x00") for i, m in zip(begin.tolist(), size_bytes.tolist(), strict=True)]


def in_scan_order(mcu: np.ndarray, blk: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a frame's blocks, and their restart segments in that order."""
    order = np.lexsort((blk, mcu))
    return order, mcu[order] // interval if interval > 0 else np.zeros(len(mcu), np.int64)


def _frame_segments(frame: pa.Table) -> pa.Table:
    mcu, blk, component = (frame[c].to_numpy().astype(np.int64) for c in ("mcu", "blk", "component"))
    coeffs = frame["coeffs"].combine_chunks().flatten().to_numpy().reshape(-1, 64)
    order, segment = in_scan_order(mcu, blk, frame["restart_interval"][0].as_py())
    scans = encode_segments(segment, component[order], coeffs[order])
    return pa.table({"frame_id": pa.array([frame["frame_id"][0].as_py()] * len(scans), pa.int64()), "segment": pa.array(np.unique(segment).astype(np.int32)), "scan": pa.array(scans, pa.binary())})


def segments(blocks: DataFrame) -> DataFrame:
    """(frame_id, segment, scan): each restart segment's bytes."""
    rows = blocks.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("mcu").cast("bigint").alias("mcu"), F.col("blk").cast("int").alias("blk"), "component", F.col("restart_interval").cast("int").alias("restart_interval"), "coeffs")
    return rows.groupBy("frame_id").applyInArrow(_frame_segments, "frame_id bigint, segment int, scan binary")


def stream(scans: list[bytes], width: int, height: int, quality: int, interval: int, subsample: bool, jfif: bool) -> bytes:
    """Header, segments with restart markers 0 to 7 in turn between them, end marker."""
    body = b"".join((b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + s for k, s in enumerate(scans))
    return standard.header(width, height, quality, interval, subsample, jfif) + body + b"\xff\xd9"


def assembled(scans: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, jpeg) from segments (see ``stream``)."""

    @F.pandas_udf("binary")
    def join(width: pd.Series, height: pd.Series, quality: pd.Series, interval: pd.Series, subsample: pd.Series, jfif: pd.Series, parts: pd.Series) -> pd.Series:
        rows = zip(width, height, quality, interval, subsample, jfif, parts, strict=True)
        return pd.Series([stream([bytes(x["scan"]) for x in p], int(w), int(h), int(q), int(i), bool(s), bool(j)) for w, h, q, i, s, j, p in rows])

    whole = scans.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("segment", "scan"))).alias("parts"))
    joined = whole.join(frames, "frame_id")
    return joined.select("frame_id", join("width", "height", "quality", "restart_interval", "subsample", "emit_jfif", "parts").alias("jpeg"))
