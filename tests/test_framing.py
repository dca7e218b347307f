import random

from pyspark.sql import functions as F

from mosaiq.streaming import framing

WORD, CLEAR = "word", "clear"


def run(*events):
    _, out = framing.fold(framing.START, events)
    return [(f[0], f[3], f[4], f[6], f[7], f[8]) for f in out]  # frame, accepted, dropped, complete, reason, error


def config(w, h):
    return ("config", 0, 0, False, w, h)


def word(last=False, keep=7):
    return (WORD, 5, keep, last, 0, 0)


def test_whole_frames():
    assert run(config(2, 1), word(), word(True), word(), word(True)) == [(0, 2, 0, True, "ok", False), (1, 2, 0, True, "ok", False)]


def test_early_and_late_end():
    assert run(config(2, 1), word(True), word(), word(True)) == [(0, 1, 0, False, "early_end", True), (1, 2, 0, True, "ok", True)]
    assert run(config(2, 1), word(), word(), word(), word(True), word(), word(True)) == [(0, 2, 2, False, "late_end", True), (1, 2, 0, True, "ok", True)]


def test_bad_keep_drains_to_the_end():
    assert run(config(3, 1), word(), word(keep=3), word(), word(True)) == [(0, 1, 3, False, "keep", True)]


def test_unsupported_size_is_drained_and_config_is_taken_at_the_first_word():
    assert run(config(0, 1), word(), word(True), config(1, 1), word(True)) == [(0, 0, 2, False, "unsupported", True), (1, 1, 0, True, "ok", True)]
    assert run(config(2, 1), word(), config(9, 9), word(True)) == [(0, 2, 0, True, "ok", False)]


def test_clear_resets():
    assert run(config(2, 1), word(keep=0), ("clear", 0, 0, False, 0, 0), word(), word(True)) == [(0, 2, 0, True, "ok", False)]


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for s in range(12):
        seq = 0
        rows.append((s, seq, *config(rnd.randint(0, 3), rnd.randint(1, 2))))
        for _ in range(60):
            seq += 1
            kind = rnd.random()
            rows.append((s, seq, *(config(rnd.randint(0, 3), rnd.randint(1, 2)) if kind < 0.05 else ("clear", 0, 0, False, 0, 0) if kind < 0.08 else (WORD, rnd.randrange(1 << 24), 7 if rnd.random() < 0.95 else 3, rnd.random() < 0.35, 0, 0))))
    events = spark.createDataFrame(rows, framing.EVENT)
    for k in range(4):
        events.where((F.col("seq") >= k * 16) & (F.col("seq") < (k + 1) * 16)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = framing.frames_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(framing.FRAME).parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, framing.frames(events.repartition(5)).collect()))
    assert got == want and len(want) > 100


def test_overlap_is_admitted_under_one_config_and_a_limit():
    def go(*events):
        return [(ok, n) for _, ok, n in framing.admission((0, None), [(k, *e) for k, e in enumerate(events)])[1]]

    start, end, clear = ("start", 1), ("end", None), ("clear", None)
    assert go(start, start, start, start, end, start) == [(True, 1), (True, 2), (True, 3), (False, 3), (True, 2), (True, 3)]
    assert go(start, ("start", 2), end, ("start", 2), end, end) == [(True, 1), (False, 1), (True, 0), (True, 1), (True, 0), (True, 0)]
    assert go(start, start, clear, ("start", 2)) == [(True, 1), (True, 2), (True, 0), (True, 1)]


def test_streams_longer_than_a_batch(spark):
    """State goes on from batch to batch and starts afresh with the next stream."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(s, 0, *config(2, 2)) for s in range(5)] + [(s, k, WORD, k, 7, k % 4 == 0, 0, 0) for s in range(5) for k in range(1, 41)]
        out = framing.frames(spark.createDataFrame(rows, framing.EVENT)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 50 and all(r.complete and r.accepted == 4 for r in out) and {r.frame for r in out} == set(range(10))


def test_registers_ignore_unmapped_and_merge_bytes(spark):
    rows = [(1, 0, 0, 0x11223344, 15), (1, 1, 0, 0xAABBCCDD, 5), (1, 2, 99, 1, 15), (1, 3, 4, 7, 0), (2, 0, 4, 9, 1)]
    out = {(r.device, r.addr): r.value for r in framing.registers(spark.createDataFrame(rows, "device bigint, seq bigint, addr int, data bigint, strobe int"), [0, 4]).collect()}
    assert out == {(1, 0): 0x11BB33DD, (1, 4): 0, (2, 0): 0, (2, 4): 9}
