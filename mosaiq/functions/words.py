"""Register words, bit fields and formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rgb_of(word: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a 24-bit pixel word, lowest byte first."""
    return word.bitwiseAND(255), F.shiftrightunsigned(word, 8).bitwiseAND(255), F.shiftrightunsigned(word, 16).bitwiseAND(255)


def trim(data: Column, keep: Column) -> tuple[Column, Column]:
    """A 32-bit transport word to 24 bits with its three keep bits."""
    return data.bitwiseAND(0xFFFFFF), keep.bitwiseAND(7)


def merged(old: Column, new: Column, strobe: Column) -> Column:
    """Bytes of ``new`` where the strobe bit is set, of ``old`` elsewhere."""
    mask = sum((F.when(strobe.bitwiseAND(1 << k) != 0, F.lit(255 << 8 * k)).otherwise(F.lit(0)).cast("bigint") for k in range(1, 4)), F.when(strobe.bitwiseAND(1) != 0, F.lit(255)).otherwise(F.lit(0)).cast("bigint"))
    return old.bitwiseAND(F.lit(0xFFFFFFFF) - mask).bitwiseOR(new.bitwiseAND(mask))


def status_text(word: Column) -> Column:
    """busy and protocol_error flags, or idle."""
    said = F.concat_ws(",", F.when(word.bitwiseAND(1) != 0, "busy"), F.when(word.bitwiseAND(2) != 0, "protocol_error"))
    return F.when(said == "", "idle").otherwise(said)


def control_word(start: Column, clear: Column, subsample: Column, jfif: Column) -> Column:
    bit = lambda c, k: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return bit(start, 0).bitwiseOR(bit(clear, 1)).bitwiseOR(bit(subsample, 2)).bitwiseOR(bit(jfif, 3))


def control_flags(word: Column) -> dict[str, Column]:
    """A control word's flags by name."""
    return {n: word.bitwiseAND(1 << k) != 0 for k, n in enumerate(("start", "clear", "subsample", "jfif"))}


def hex32(v: Column) -> Column:
    return F.format_string("0x%08x", v.cast("bigint"))


def slug(name: Column) -> Column:
    """CamelCase to kebab-case; ``graph`` if nothing is left."""
    s = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1-$2")
    s = F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"))
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("graph"))


def label(text: Column) -> Column:
    """A report label as a name: lower case, one underscore for a run of white space and for each ``-`` and ``/``, ``of_`` in front made ``number_of_``."""
    s = F.translate(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_"), "-/", "__")
    return F.when(s.startswith("of_"), F.concat(F.lit("number_"), s)).otherwise(s)


def truncated(text: Column, limit: int = 4096) -> tuple[Column, Column]:
    return F.left(text, F.lit(limit)), F.length(text) > limit


def near(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def clock_record(period_ns: Column) -> Column:
    """Period and frequency of a clock, their checks, and whether they belong together; nothing not finite is kept."""
    ns = period_ns.cast("double")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    mhz = F.when(finite(ns) & (ns != 0), F.lit(1000.0) / F.nullif(ns, F.lit(0.0)))
    checks = {"clock_period_finite": finite(ns), "clock_period_positive": F.coalesce((ns > 0) & ~F.isnan(ns), F.lit(False)), "clock_frequency_finite": finite(mhz), "clock_frequency_positive": F.coalesce(mhz > 0, F.lit(False))}
    sound = F.lit(True)
    for c in checks.values():
        sound = sound & c
    match = sound & F.coalesce(near(ns * mhz, F.lit(1000.0)), F.lit(False))
    return F.struct(F.when(finite(ns), ns).alias("clock_period_ns"), mhz.alias("clock_frequency_mhz"), *[c.alias(n) for n, c in checks.items()], match.alias("period_frequency_match"), match.alias("valid"))


MARKERS = {0xD8: "SOI", 0xD9: "EOI", 0xDB: "DQT", 0xDD: "DRI", 0xC0: "SOF0", 0xC4: "DHT", 0xDA: "SOS"}


def marker_name(code: Column) -> Column:
    out = F.when(code.between(0xD0, 0xD7), F.concat(F.lit("RST"), (code - 0xD0).cast("string")))
    out = out.when(code.between(0xE0, 0xEF), F.concat(F.lit("APP"), (code - 0xE0).cast("string")))
    for k, v in MARKERS.items():
        out = out.when(code == k, v)
    return out.otherwise(F.format_string("0xFF%02X", code.cast("int")))


def mcus(width: Column, height: Column, subsample: Column) -> Column:
    side = F.when(subsample, 16).otherwise(8)
    return (F.ceil(width / side) * F.ceil(height / side)).cast("bigint")


def restarts(mcu_count: Column, interval: Column) -> Column:
    """The numbers of the restart markers of a frame, in order."""
    n = F.when(interval > 0, F.floor((mcu_count - 1) / interval)).otherwise(0).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 8)).otherwise(F.array().cast("array<int>"))


def expanded(argv: Column, value: Column) -> Column:
    """A decoder's arguments with ``{jpeg}`` replaced by the file, or the file appended where no argument asks for it."""
    asked = F.exists(argv, lambda a: a.contains("{jpeg}"))
    return F.when(asked, F.transform(argv, lambda a: F.replace(a, F.lit("{jpeg}"), value))).otherwise(F.concat(argv, F.array(value)))


def same_settings(a: list[Column], b: list[Column]) -> Column:
    """Null-safe equality of all settings."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def in_domain(name: str, v: Column) -> Column:
    """Whether a setting lies in its domain; null does not."""
    domains = {"quality": v.between(1, 100), "restart_interval": v.between(0, 65535), "positive": v > 0, "nonnegative": v >= 0, "finite": ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))}
    return F.coalesce(domains[name], F.lit(False))
