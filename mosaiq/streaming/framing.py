"""Framed streams: words with an end flag to frames, with drop-and-drain error handling.

A word has (stream_id, seq, data, keep, last). A frame has the size in force when its
first word arrives. Words with a wrong keep mask are dropped and mark the stream, and
the rest of that frame is drained up to its end flag; so is a frame whose size is not
supported or whose end flag is late. An early end flag ends the frame short and marks
the stream. A clear event resets the stream's state and mark.

``fold`` is the state machine of one stream over ordered events; the batch and the
streaming operator both apply it, so they cannot differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "stream_id bigint, seq bigint, kind string, data bigint, keep int, last boolean, width int, height int"
FRAME = "stream_id bigint, frame bigint, width int, height int, accepted bigint, dropped bigint, checksum bigint, complete boolean, reason string, error boolean"
STATE = "frame bigint, at bigint, width int, height int, next_width int, next_height int, accepted bigint, dropped bigint, checksum bigint, draining boolean, reason string, error boolean"
START = (0, 0, 0, 0, 0, 0, 0, 0, 0, False, "", False)


def fold(state: tuple, events: Iterable[tuple], max_width: int = 1920, max_height: int = 1080) -> tuple[tuple, list[tuple]]:
    """Events (kind, data, keep, last, width, height) in order, from a state to the next one and the frames that ended."""
    frame, at, width, height, nw, nh, accepted, dropped, checksum, draining, reason, error = state
    out = []
    for kind, data, keep, last, w, h in events:
        if kind == "config":
            nw, nh = int(w), int(h)
            continue
        if kind == "clear":
            at, accepted, dropped, checksum, draining, reason, error = 0, 0, 0, 0, False, "", False
            continue
        if at == 0 and not draining:
            width, height = nw, nh
            if not (0 < width <= max_width and 0 < height <= max_height):
                draining, reason, error = True, "unsupported", True
        if draining:
            dropped += 1
        elif int(keep) & 7 != 7:
            dropped += 1
            draining, reason, error = True, "keep", True
        else:
            accepted += 1
            checksum = (checksum * 31 + (int(data) & 0xFFFFFF)) % 1_000_000_007
            at += 1
            if not last and at == width * height:
                draining, reason, error = True, "late_end", True
            elif last and at < width * height:
                reason, error = "early_end", True
        if last:
            whole = not reason and at == width * height
            out.append((frame, width, height, accepted, dropped, checksum, whole, reason or "ok", error))
            frame, at, accepted, dropped, checksum, draining, reason = frame + 1, 0, 0, 0, 0, False, ""
    return (frame, at, width, height, nw, nh, accepted, dropped, checksum, draining, reason, error), out


def _events(rows: pd.DataFrame) -> Iterator[tuple]:
    cols = (rows[c].tolist() for c in ("kind", "data", "keep", "last", "width", "height"))
    return zip(*cols, strict=True)


NAMES = [c.split()[0] for c in FRAME.split(", ")]
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def scanned(rows: DataFrame, key: str, order: str, columns: list[str], step: Callable, start: tuple, schema: str) -> DataFrame:
    """A sequential fold of each key's rows in order: ``step(state, rows)`` gives the next state and output tuples.

    Keys are dealt to partitions and sorted there, so state is carried from row to row
    and from batch to batch; a task holds one batch, whatever the length of a stream.
    The output has the key as its first column.
    """
    fields = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in it:
            keys = batch.column(0).to_numpy()
            rows = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            out = []
            for a, b in pairwise(cuts):
                if keys[a] != now:
                    now, state = keys[a], start
                state, found = step(state, rows[a:b])
                out += [(int(now), *f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], schema=fields)

    return rows.repartition(key).sortWithinPartitions(key, order).select(key, *columns).mapInArrow(run, schema)


def frames(events: DataFrame) -> DataFrame:
    """Batch: the frames of all streams. Streams are independent; one stream is sequential by nature."""
    return scanned(events, "stream_id", "seq", ["kind", "data", "keep", "last", "width", "height"], fold, START, FRAME)


def frames_stream(events: DataFrame) -> DataFrame:
    """Streaming: the same frames, state kept for each stream across micro-batches.

    Events of a stream must arrive in order of ``seq`` from batch to batch.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        now, out = fold(tuple(now), _events(rows))
        state.update(now)
        yield pd.DataFrame([(key[0], *f) for f in out], columns=NAMES)

    return events.groupBy("stream_id").applyInPandasWithState(run, FRAME, STATE, "append", GroupStateTimeout.NoTimeout)


def config_at(events: DataFrame, changes: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """As-of: each event with the last change at or before it, by one window over the merged log."""
    log = changes.select(key, at, F.struct(*columns).alias("_c"), F.lit(0).alias("_o"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in events.schema) + ">").alias("_e"))
    own = events.select(key, at, F.lit(None).cast(log.schema["_c"].dataType).alias("_c"), F.lit(1).alias("_o"), F.struct(*events.columns).alias("_e"))
    order = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    joined = log.unionByName(own).withColumn("_last", F.last("_c", ignorenulls=True).over(order)).where("_o = 1")
    return joined.select("_e.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def sticky(events: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``epoch`` (clears so far) and ``error``: any violation since the last clear. Columns ``clear`` and ``violation``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    epochs = events.withColumn("epoch", F.sum(F.col("clear").cast("int")).over(w))
    inner = Window.partitionBy(key, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return epochs.withColumn("error", F.max(F.col("violation") & ~F.col("clear")).over(inner))


def in_flight(events: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """Add ``in_flight``: the running sum of +1 and -1 events."""
    return events.withColumn("in_flight", F.sum(delta).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


ADMITTED = "stream_id bigint, seq bigint, admitted boolean, in_flight int"


def admission(state: tuple, events: Iterable[tuple], limit: int = 3) -> tuple[tuple, list[tuple]]:
    """Events (seq, kind, config) from a state (frames in flight, their config): a start is let in beside others only under their own config and below ``limit``, else it is held back; an end frees a place; a clear frees all."""
    n, held = state
    out = []
    for seq, kind, config in events:
        ok = kind != "start" or n == 0 or (config == held and n < limit)
        if kind == "start" and ok:
            n, held = n + 1, config
        elif kind == "end":
            n = max(0, n - 1)
        elif kind == "clear":
            n = 0
        out.append((seq, ok, n))
    return (n, held), out


def admitted(events: DataFrame) -> DataFrame:
    """(stream_id, seq, kind, config) to whether each start may go on, and the frames in flight after each event."""
    return scanned(events, "stream_id", "seq", ["seq", "kind", "config"], admission, (0, None), ADMITTED)


def stripes(pixels: DataFrame, settings: DataFrame) -> DataFrame:
    """(frame_id, stripe, pixels, complete, last_y): a stripe of 8 rows, or 16 with subsampling, is emitted once all of its pixels are there."""
    rows = F.when(F.col("subsample"), 16).otherwise(8)
    inside = pixels.join(settings.select("frame_id", "width", "height", rows.alias("_rows")), "frame_id").where("x < width AND y < height")
    counted = inside.groupBy("frame_id", F.floor(F.col("y") / F.col("_rows")).alias("stripe"), "width", "height", "_rows").agg(F.count(F.lit(1)).alias("pixels"), F.max("y").cast("bigint").alias("last_y"))
    due = F.col("width") * F.least(F.col("_rows"), F.col("height") - F.col("stripe") * F.col("_rows"))
    return counted.select("frame_id", "stripe", "pixels", (F.col("pixels") == due).alias("complete"), "last_y")


def coordinates(words: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """Add x and y to words in raster order: a line wraps at the frame's width."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return words.withColumn("_at", at).withColumns({"x": (F.col("_at") % F.col(width)).cast("int"), "y": F.floor(F.col("_at") / F.col(width)).cast("int")}).drop("_at")


def registers(writes: DataFrame, mapped: list[int]) -> DataFrame:
    """(device, seq, addr, data, strobe) writes to each register's current value; unmapped writes are ignored.

    Each byte is that of its last write whose strobe bit is set, which aggregates before the exchange.
    """
    lane = lambda k: F.col("strobe").bitwiseAND(1 << k) != 0
    last = lambda k: F.max_by(F.when(lane(k), F.shiftrightunsigned("data", 8 * k).bitwiseAND(255)), F.when(lane(k), F.col("seq")))
    value = sum((F.coalesce(last(k), F.lit(0)).cast("bigint") * (1 << 8 * k) for k in range(1, 4)), F.coalesce(last(0), F.lit(0)).cast("bigint"))
    now = writes.where(F.col("addr").isin(*mapped)).groupBy("device", "addr").agg(value.alias("value"))
    dense = writes.select("device").distinct().select("device", F.explode(F.array(*[F.lit(a) for a in mapped])).alias("addr"))
    return dense.join(now, ["device", "addr"], "left").select("device", "addr", F.coalesce("value", F.lit(0)).alias("value"))
