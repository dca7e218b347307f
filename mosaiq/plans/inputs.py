"""Inputs derived from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as 16-pixel wide frames, one for each supplier."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame_id"), (F.row_number().over(order) - 1).alias("i"), "l_partkey", "l_orderkey", "l_quantity")
    return rows.select("frame_id", (F.col("i") % 16).cast("int").alias("x"), F.floor(F.col("i") / 16).cast("int").alias("y"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_quantity").cast("bigint") * 5 % 256).cast("int").alias("b"))


PIXELS = """px AS (SELECT l_suppkey AS frame_id, i % 16 AS x, i // 16 AS y, l_partkey % 256 AS r, l_orderkey % 256 AS g, CAST(l_quantity AS BIGINT) * 5 % 256 AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem))"""

YCC = PIXELS + """, ycc AS (SELECT frame_id, x, y,
  greatest(0, least(255, (77*r + 150*g + 29*b) >> 8)) AS luma, greatest(0, least(255, ((-43*r - 85*g + 128*b) >> 8) + 128)) AS cb, greatest(0, least(255, ((128*r - 107*g - 21*b) >> 8) + 128)) AS cr FROM px)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of those frames: whole rows only, widths 16 and 13, both chroma modes, some with restarts."""
    size = pixels(spark, sf).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    odd = F.col("frame_id") % 2 == 1
    return size.select("frame_id", F.when(odd, 13).otherwise(16).alias("width"), F.floor(F.col("n") / 16).cast("int").alias("height"), (F.col("frame_id") % 100 + 1).cast("int").alias("quality"), (F.col("frame_id") % 4).cast("int").alias("restart_interval"), (F.col("frame_id") % 3 == 0).alias("subsample"), (F.col("frame_id") % 5 != 0).alias("emit_jfif")).where("height > 0")


FRAMES = """fr AS (SELECT frame_id, CASE WHEN frame_id % 2 = 1 THEN 13 ELSE 16 END AS width, n // 16 AS height, frame_id % 3 = 0 AS subsample FROM (SELECT frame_id, count(*) AS n FROM px GROUP BY 1) WHERE n >= 16)"""


def block_samples(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 8x8 blocks: (frame_id, mcu, blk, component, samples)."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(e.cast("double") * 256))).cast("int"))
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("frame_id"), (F.col("vec_id") % 32).alias("mcu"), F.lit(0).alias("blk"), (F.col("vec_id") % 3).cast("int").alias("component"), v.alias("samples"), (F.col("vec_id") % 100 + 1).cast("int").alias("quality"), F.lit(8).alias("restart_interval"))


def block_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = block_samples(spark, sf).select((F.col("frame_id") * 32 + F.col("mcu")).alias("vec_id"), "component", "quality", F.posexplode("samples").alias("pos", "v"))
    return rows.withColumn("v", F.col("v").cast("bigint"))


BLOCKS = """b AS (SELECT vec_id, CAST(vec_id % 3 AS INT) AS component, CAST(vec_id % 100 + 1 AS INT) AS quality, k - 1 AS pos,
  greatest(-128, least(127, CAST(floor(CAST(embedding[k] AS DOUBLE) * 256) AS BIGINT))) AS v FROM embeddings, range(1, 65) t(k))"""


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """events as samples: a scenario for each user, a cycle for each event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("scenario"), F.row_number().over(order).cast("bigint").alias("cycle"), F.col("event_type").alias("boundary"), (F.col("event_id") % 3 != 0).cast("int").alias("valid"), (F.col("event_id") % 4 != 1).cast("int").alias("ready"), (F.col("event_id") % 4).cast("int").alias("raster_phase"), (F.col("event_id") % 11).cast("int").alias("encoder_phase"))


TRACES = """tr AS (SELECT CAST(user_id AS VARCHAR) AS scenario, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, event_type AS boundary,
  CAST(event_id % 3 <> 0 AS INT) AS valid, CAST(event_id % 4 <> 1 AS INT) AS ready, CAST(event_id % 4 AS INT) AS raster_phase, CAST(event_id % 11 AS INT) AS encoder_phase FROM events),
  st AS (SELECT *, CASE WHEN valid = 1 AND ready = 1 THEN 'transfer' WHEN valid = 1 THEN 'blocked' WHEN ready = 1 THEN 'starved' ELSE 'idle' END AS state FROM tr)"""


def renamed_traces(spark: SparkSession, sf: str) -> DataFrame:
    """The same samples under the boundary names of a capture."""
    from ..sources.captures import BOUNDARIES

    names = F.array(*[F.lit(b) for b in BOUNDARIES])
    return table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("scenario"), F.col("event_id").alias("cycle"), F.get(names, (F.col("event_id") % 14).cast("int")).alias("boundary"), F.lit(1).alias("valid"), (F.col("event_id") % 4 != 1).cast("int").alias("ready"))


CAPTURE = """cap AS (SELECT CAST(user_id % 20 AS VARCHAR) AS scenario, event_id AS cycle,
  (['rgb_input','transform_input','dct_input','dct_output','quantize_input','quantize_output','zigzag_input','zigzag_output','transform_output','mcu_output','entropy_block_input','entropy_run_output','packer_output','jpeg_output'])[event_id % 14 + 1] AS boundary,
  1 AS valid, CAST(event_id % 4 <> 1 AS INT) AS ready FROM events),
  fires AS (SELECT scenario, boundary, cycle, row_number() OVER (PARTITION BY scenario, boundary ORDER BY cycle) - 1 AS i FROM cap WHERE valid = 1 AND ready = 1)"""


def capture_phases(spark: SparkSession, sf: str) -> DataFrame:
    """A phase sample for each event of a capture's scenarios."""
    return table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("scenario"), F.col("event_id").alias("cycle"), (F.col("event_id") % 4).cast("int").alias("raster_phase"), (F.col("event_id") % 11).cast("int").alias("encoder_phase"))


PHASES = "cph AS (SELECT CAST(user_id % 20 AS VARCHAR) AS scenario, event_id AS cycle, event_id % 4 AS raster_phase, event_id % 11 AS encoder_phase FROM events)"


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    rows = renamed_traces(spark, sf).groupBy("scenario").agg(F.min("cycle").alias("first_input_cycle"), F.max("cycle").alias("last_output_cycle"))
    k = F.col("scenario").cast("int")
    return rows.select("scenario", F.when(k % 2 == 0, "4:4:4").otherwise("4:2:0").alias("sampling"), (k % 3 + 1).cast("bigint").alias("frames"), F.lit(64).cast("bigint").alias("width"), F.lit(16).cast("bigint").alias("height"), ((k % 3 + 1) * 16).cast("bigint").alias("mcus"), ((k % 3 + 1) * 1024).cast("bigint").alias("pixels"), ((k % 7 + 1) * 100).cast("bigint").alias("bytes"), F.lit(100_000_000).cast("bigint").alias("clock_hz"), "first_input_cycle", "last_output_cycle", (F.col("last_output_cycle") - F.col("first_input_cycle") + 1).alias("frame_cycles"))


SCENARIOS = """sc AS (SELECT scenario, CASE WHEN k % 2 = 0 THEN '4:4:4' ELSE '4:2:0' END AS sampling, k % 3 + 1 AS frames, 64 AS width, 16 AS height, (k % 3 + 1) * 16 AS mcus, (k % 3 + 1) * 1024 AS pixels, (k % 7 + 1) * 100 AS bytes, 100000000 AS clock_hz, f AS first_input_cycle, l AS last_output_cycle, l - f + 1 AS frame_cycles
  FROM (SELECT scenario, CAST(scenario AS INT) AS k, min(cycle) AS f, max(cycle) AS l FROM cap GROUP BY scenario))"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    """region, nation, customer and supplier as a graph (src, instance, dst), with one loop."""
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    r = table(spark, sf, "region")
    rows = r.select(F.lit("world").alias("src"), F.col("r_name").alias("instance"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("dst"))
    rows = rows.unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.col("n_name").alias("instance"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst")))
    rows = rows.unionByName(c.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.col("c_name").alias("instance"), F.concat(F.lit("mem_"), F.col("c_mktsegment")).alias("dst")))
    rows = rows.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.col("s_name").alias("instance"), F.lit("world").alias("dst")))
    return rows.select("src", F.replace("instance", F.lit("#"), F.lit("_")).alias("instance"), "dst")


LINKS = """lk AS (SELECT src, replace(instance, '#', '_') AS instance, dst FROM (
  SELECT 'world' AS src, r_name AS instance, 'r' || r_regionkey AS dst FROM region UNION ALL SELECT 'r' || n_regionkey, n_name, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_name, 'mem_' || c_mktsegment FROM customer UNION ALL SELECT 'n' || s_nationkey, s_name, 'world' FROM supplier))"""
