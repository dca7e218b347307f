"""Cycle captures: three CSV files with explicit schemas, and their integrity rules as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The boundaries in their order, phase codes and stages.
BOUNDARIES = (
    "rgb_input", "transform_input", "dct_input", "dct_output", "quantize_input", "quantize_output", "zigzag_input",
    "zigzag_output", "transform_output", "mcu_output", "entropy_block_input", "entropy_run_output", "packer_output", "jpeg_output",
)
RASTER_PHASES = ("idle", "load", "transform", "emit")
ENCODER_PHASES = ("idle", "header", "wait_mcu", "start_block", "block", "restart_flush", "restart_high", "restart_low", "flush", "eoi_high", "eoi_low")
STAGES = {"dct": ("dct_input", "dct_output"), "quantize": ("quantize_input", "quantize_output"), "zigzag": ("zigzag_input", "zigzag_output"), "block_transform": ("transform_input", "transform_output")}

TEXTS = ("scenario", "name", "profile", "sampling", "content", "ready_pattern")
NUMBERS = {"frames": 1, "width": None, "height": None, "quality": 0, "clock_hz": 100_000_000, "first_input_cycle": None, "last_output_cycle": None, "frame_cycles": None, "pixels": None, "bytes": None, "mcus": None, "blocks": None}


def number(column: str, default: int | None = None):
    """A whole number; blank or missing is the default, anything else unreadable is null."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    return F.when(text.isNull(), F.lit(default).cast("bigint")).otherwise(F.expr(f"try_cast(trim({column}) as bigint)"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """``scenarios.csv``: any of the columns may be missing; ``name`` stands in for ``scenario``."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    for c in (*TEXTS, *NUMBERS):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    name = F.coalesce(F.nullif(F.col("scenario"), F.lit("")), F.col("name")).alias("scenario")
    return raw.select(name, "profile", "sampling", "content", "ready_pattern", *[number(c, d).alias(c) for c, d in NUMBERS.items()])


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scenario string, cycle bigint, boundary string, valid int, ready int").option("mode", "FAILFAST").csv(path, header=True)


def phases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scenario string, cycle bigint, raster_phase int, encoder_phase int").option("mode", "FAILFAST").csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Write a capture table; flags as 0 and 1, ``scenario`` first."""
    first = [F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in rows.dtypes]
    out = rows.select(first)
    out.select("scenario", *[c for c in out.columns if c != "scenario"]).write.mode("overwrite").csv(path, header=True)


def _violations(rows: DataFrame, rule: str, detail) -> DataFrame:
    return rows.select(F.col("scenario"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def scenario_violations(found: DataFrame) -> DataFrame:
    """Names that repeat, and counts that contradict each other."""
    twice = found.groupBy("scenario").count().where("count > 1")
    return (
        _violations(twice, "unique_scenario", F.col("count"))
        .unionByName(_violations(found.where("frame_cycles <> last_output_cycle - first_input_cycle + 1"), "frame_cycles", F.col("frame_cycles")))
        .unionByName(_violations(found.where("pixels <> width * height * frames"), "pixels", F.col("pixels")))
        .unionByName(_violations(found.where("mcus % frames <> 0"), "mcus_per_frame", F.col("mcus")))
    )


def sample_violations(found: DataFrame, known: DataFrame, boundaries: tuple[str, ...] = BOUNDARIES) -> DataFrame:
    """Unknown scenarios or boundaries, flags outside 0 and 1, repeated keys, boundaries without samples."""
    spark = found.sparkSession
    names = spark.createDataFrame([(b,) for b in boundaries], "boundary string")
    twice = found.groupBy("scenario", "cycle", "boundary").count().where("count > 1")
    absent = known.select("scenario").distinct().crossJoin(F.broadcast(names)).join(found.select("scenario", "boundary").distinct(), ["scenario", "boundary"], "left_anti")  # 14 names
    return (
        _violations(found.join(known.select("scenario"), "scenario", "left_anti"), "known_scenario", F.col("cycle"))
        .unionByName(_violations(found.join(F.broadcast(names), "boundary", "left_anti"), "known_boundary", F.col("boundary")))
        .unionByName(_violations(found.where("valid NOT IN (0, 1) OR ready NOT IN (0, 1)"), "flags", F.col("cycle")))
        .unionByName(_violations(twice, "unique_sample", F.concat_ws("/", "cycle", "boundary")))
        .unionByName(_violations(absent, "complete_boundaries", F.col("boundary")))
    )


def phase_violations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown codes, repeated cycles, and cycles of a scenario's span without a phase row."""
    span = known.where("last_output_cycle >= first_input_cycle").select("scenario", F.explode(F.sequence("first_input_cycle", "last_output_cycle")).alias("cycle"))
    twice = found.groupBy("scenario", "cycle").count().where("count > 1")
    inside = found.select("scenario", "cycle").distinct()
    return (
        _violations(found.where(f"raster_phase NOT BETWEEN 0 AND {len(RASTER_PHASES) - 1} OR encoder_phase NOT BETWEEN 0 AND {len(ENCODER_PHASES) - 1}"), "known_phase", F.col("cycle"))
        .unionByName(_violations(twice, "unique_phase", F.col("cycle")))
        .unionByName(_violations(span.join(inside, ["scenario", "cycle"], "left_anti"), "missing_phase", F.col("cycle")))
        .unionByName(_violations(inside.join(span, ["scenario", "cycle"], "left_anti"), "extra_phase", F.col("cycle")))
    )
