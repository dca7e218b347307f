"""Integer colour conversion. All shifts floor, as in two's complement hardware."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import standard


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def luma(r: Column, g: Column, b: Column) -> Column:
    return clamp(F.shiftright(77 * r + 150 * g + 29 * b, 8))


def blue(r: Column, g: Column, b: Column) -> Column:
    return clamp(F.shiftright(-43 * r - 85 * g + 128 * b, 8) + 128)


def red(r: Column, g: Column, b: Column) -> Column:
    return clamp(F.shiftright(128 * r - 107 * g - 21 * b, 8) + 128)


def quality_scale(quality: Column) -> Column:
    """The scale of a quality, which is clamped to 1..100."""
    q = clamp(quality, 1, 100)
    return F.when(q < 50, F.expr("5000") / q).otherwise(200 - 2 * q).cast("int")


def quant_entry(base: Column, quality: Column) -> Column:
    return clamp(F.floor((base * quality_scale(quality) + 50) / 100).cast("int"), 1, 255)


def category(v: Column) -> Column:
    """Bits of the magnitude; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("bigint")))).cast("int")


def amplitude(v: Column) -> Column:
    """The amplitude bits of a value: itself, or for negatives its one's complement."""
    return F.when(v >= 0, v).otherwise(F.expr("1").cast("bigint") * F.pow(F.lit(2), category(v)).cast("bigint") - 1 + v).cast("bigint")


def divide_away(c: Column, q: Column) -> Column:
    """c / q rounded, halves away from zero; all integer."""
    half = F.floor(q / 2)
    magnitude = F.floor((F.abs(c) + half) / q).cast("bigint")
    return F.when(c < 0, -magnitude).otherwise(magnitude)


def zigzag(block: Column) -> Column:
    """The 64 entries of an array in zig-zag order."""
    return F.array(*[F.get(block, F.lit(k)) for k in standard.ZIGZAG])
