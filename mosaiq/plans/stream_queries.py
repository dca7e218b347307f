"""Queries of framed streams: the batch operators and the same state machine on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming import framing
from . import inputs as i

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def conversation_words(spark, sf):
    """conversations as streams: a word for each turn, the end flag on the last turn, a wrong keep mask now and then.

    A frame is 2 x 2 pixels, so shorter conversations end early and longer ones late.
    """
    rows = i.table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    words = rows.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.lit("word").alias("kind"), (F.col("n") * 7).alias("data"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), 3).otherwise(7).alias("keep"), (F.col("turn") == F.col("end")).alias("last"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    config = last.select(F.col("conv_id").alias("stream_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("config").alias("kind"), F.lit(0).cast("bigint").alias("data"), F.lit(0).alias("keep"), F.lit(False).alias("last"), F.lit(2).alias("width"), F.when(F.col("conv_id") % 7 == 0, 0).otherwise(2).alias("height"))
    return words.unionByName(config)


FRAMES = """WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total, (length(text) * 7) & 16777215 AS d FROM conversations),
  c AS (SELECT conv_id, total, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE least(coalesce(min(n) FILTER (conv_id % 5 = 0 AND turn = 1), 999), CASE WHEN total > 4 THEN 5 ELSE 999 END) END AS stop, bool_or(conv_id % 5 = 0 AND turn = 1 AND n <= 4) AS bad FROM w GROUP BY 1, 2),
  a AS (SELECT c.*, least(stop - 1, total) AS accepted FROM c),
  k AS (SELECT a.conv_id, CAST(sum(CASE accepted - n WHEN 0 THEN 1 WHEN 1 THEN 31 WHEN 2 THEN 961 ELSE 29791 END::HUGEINT * d) % 1000000007 AS BIGINT) AS checksum FROM a JOIN w ON w.conv_id = a.conv_id AND n <= accepted GROUP BY 1)
  SELECT a.conv_id AS stream_id, 0::BIGINT AS frame, 2 AS width, CASE WHEN a.conv_id % 7 = 0 THEN 0 ELSE 2 END AS height, CAST(accepted AS BIGINT) AS accepted, CAST(total - accepted AS BIGINT) AS dropped, coalesce(checksum, 0) AS checksum,
    a.conv_id % 7 <> 0 AND NOT bad AND total = 4 AS complete, CASE WHEN a.conv_id % 7 = 0 THEN 'unsupported' WHEN bad THEN 'keep' WHEN total > 4 THEN 'late_end' WHEN total < 4 THEN 'early_end' ELSE 'ok' END AS reason, NOT (a.conv_id % 7 <> 0 AND NOT bad AND total = 4) AS error FROM a LEFT JOIN k USING (conv_id)"""


@query(FRAMES)
def framed_words(spark, sf):
    return framing.frames(conversation_words(spark, sf))


@query(FRAMES)
def framed_words_stream(spark, sf):
    """The same through Structured Streaming: events arrive as files, in micro-batches, with state between them."""
    at = f"{shared_dir(spark)}/framing-{uuid.uuid4().hex}"
    events = conversation_words(spark, sf)
    for k, part in enumerate((events.where("seq < 1"), events.where("seq >= 1 AND seq < 3"), events.where("seq >= 3"))):
        part.coalesce(1).write.parquet(f"{at}/in/{k}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    run = framing.frames_stream(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(framing.FRAME).parquet(f"{at}/out")


@query("SELECT l.l_orderkey AS k, l.l_linenumber AS line, CAST(l.l_suppkey AS BIGINT) AS seq, CAST(max(o.o_orderkey) AS BIGINT) AS setting FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey % 100 AS cust FROM lineitem) l LEFT JOIN orders o ON o.o_custkey % 100 = cust AND o.o_orderkey <= l.l_orderkey GROUP BY l.l_orderkey, l.l_linenumber, l.l_suppkey, cust")
def config_as_of(spark, sf):
    """Each event with the last setting of its customer at or before it."""
    events = i.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 100).alias("cust")).distinct()
    events = events.select("cust", F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("bigint").alias("seq"))
    changes = i.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("cust"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("setting"))
    out = framing.config_at(events, changes, "cust", "at", ["setting"])
    return out.select(F.col("at").alias("k"), "line", "seq", "setting")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 11 = 0 AS clear, event_id % 7 = 0 AS violation FROM events), p AS (SELECT *, CAST(sum(CAST(clear AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS epoch FROM e)
  SELECT user_id, event_id, epoch, bool_or(violation AND NOT clear) OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS error FROM p""")
def sticky_errors(spark, sf):
    e = i.table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 11 == 0).alias("clear"), (F.col("event_id") % 7 == 0).alias("violation"))
    return framing.sticky(e, "user_id", "event_id").select("user_id", "event_id", "epoch", "error")


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS in_flight FROM events")
def frames_in_flight(spark, sf):
    e = i.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"))
    return framing.in_flight(e, "user_id", "event_id", "delta").select("user_id", "event_id", "in_flight")


@query("""WITH w AS (SELECT user_id % 10 AS device, event_id AS seq, CAST(event_id % 4 * 4 AS INT) AS addr, event_id * 2654435761 % 4294967296 AS data, event_id % 16 AS strobe FROM events),
  b AS (SELECT device, addr, k, max_by((data >> (8 * k)) & 255, seq) AS v FROM w, (VALUES (0), (1), (2), (3)) t(k) WHERE addr < 12 AND (strobe >> k) & 1 = 1 GROUP BY ALL)
  SELECT d.device, a.addr, CAST(coalesce(sum(v << (8 * k)), 0) AS BIGINT) AS value FROM (SELECT DISTINCT device FROM w) d CROSS JOIN (VALUES (0), (4), (8)) a(addr) LEFT JOIN b ON b.device = d.device AND b.addr = a.addr GROUP BY 1, 2""")
def register_values(spark, sf):
    e = i.table(spark, sf, "events").select((F.col("user_id") % 10).alias("device"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 * 4).cast("int").alias("addr"), (F.col("event_id") * 2654435761 % 4294967296).alias("data"), (F.col("event_id") % 16).cast("int").alias("strobe"))
    return framing.registers(e, [0, 4, 8])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_id % 13 = 0 THEN 'clear' WHEN event_id % 3 = 2 THEN 'end' ELSE 'start' END AS kind, event_id // 4 % 2 AS config FROM events),
  s AS (SELECT user_id, event_id, i, kind <> 'clear' AS started, true AS admitted, CASE WHEN kind = 'start' THEN 1 ELSE 0 END AS n, CASE WHEN kind = 'start' THEN config END AS held FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i, true, kind <> 'start' OR n = 0 OR (config = held AND n < 3), CASE WHEN kind = 'clear' THEN 0 WHEN kind = 'end' THEN greatest(0, n - 1) WHEN n = 0 OR (config = held AND n < 3) THEN n + 1 ELSE n END, CASE WHEN kind = 'start' AND (n = 0 OR (config = held AND n < 3)) THEN config ELSE held END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
  SELECT CAST(user_id AS BIGINT) AS stream_id, event_id AS seq, admitted, CAST(n AS INT) AS in_flight FROM s""")
def overlap_admission(spark, sf):
    k = F.col("event_id")
    kind = F.when(k % 13 == 0, "clear").when(k % 3 == 2, "end").otherwise("start")
    events = i.table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("stream_id"), k.alias("seq"), kind.alias("kind"), F.floor(k / 4).bitwiseAND(1).cast("int").alias("config"))
    return framing.admitted(events)


@query(f"""WITH {i.PIXELS}, {i.FRAMES}, s AS (SELECT px.frame_id, y // sd AS stripe, width * least(sd, height - y // sd * sd) AS due, y FROM px JOIN (SELECT *, CASE WHEN subsample THEN 16 ELSE 8 END AS sd FROM fr) f ON f.frame_id = px.frame_id AND x < width AND y < height WHERE (px.frame_id + x + y) % 97 <> 0)
  SELECT frame_id, CAST(stripe AS BIGINT) AS stripe, CAST(count(*) AS BIGINT) AS pixels, count(*) = due AS complete, CAST(max(y) AS BIGINT) AS last_y FROM s GROUP BY 1, 2, due""")
def stripe_completion(spark, sf):
    """Stripes of the frames, some of which lack a pixel."""
    return framing.stripes(i.pixels(spark, sf).where((F.col("frame_id") + F.col("x") + F.col("y")) % 97 != 0), i.frames(spark, sf))


@query("SELECT event_id, CAST(n % w AS INT) AS x, CAST(n // w AS INT) AS y FROM (SELECT event_id, user_id % 7 + 1 AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)")
def stream_coordinates(spark, sf):
    e = i.table(spark, sf, "events").select("user_id", "event_id", (F.col("user_id") % 7 + 1).alias("width"))
    return framing.coordinates(e, "user_id", "event_id", "width").select("event_id", "x", "y")
