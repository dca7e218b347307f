from pyspark.sql import functions as F

from mosaiq.operators import trace
from mosaiq.sources import captures

#: Six cycles: the cycles in which each boundary has a transfer; ready is always set.
FIRES = {
    "rgb_input": (0, 1), "transform_input": (1, 3), "dct_input": (1, 3), "dct_output": (2, 4), "quantize_input": (2, 4), "quantize_output": (3, 5), "zigzag_input": (3, 5),
    "zigzag_output": (3, 5), "transform_output": (3, 5), "mcu_output": (2,), "entropy_block_input": (3,), "entropy_run_output": (3, 4), "packer_output": (4, 5), "jpeg_output": (4, 5),
}


def samples(spark):
    rows = [("s", c, b, int(c in f), 1) for b, f in FIRES.items() for c in range(6)]
    return spark.createDataFrame(rows, "scenario string, cycle bigint, boundary string, valid int, ready int")


def scenario(spark, **other):
    base = dict(scenario="s", profile="quick", frames=1, width=8, height=8, sampling="4:4:4", content="flat", quality=50, ready_pattern="always", clock_hz=100_000_000, first_input_cycle=0, last_output_cycle=5, frame_cycles=6, pixels=64, bytes=2, mcus=1, blocks=3)
    base |= other
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in base.items()))


def test_states_and_runs(spark):
    rows = [(0, 1, 1), (1, 1, 1), (2, 1, 0), (3, 0, 1), (5, 0, 1)]
    df = spark.createDataFrame([("s", c, "b", v, r) for c, v, r in rows], "scenario string, cycle bigint, boundary string, valid int, ready int")
    out = trace.runs(trace.with_state(df), ["scenario"], "state").orderBy("start").collect()
    assert [(r.start, r.duration, r.state) for r in out] == [(0, 2, "transfer"), (2, 1, "blocked"), (3, 1, "starved"), (5, 1, "starved")]


def test_golden_capture(spark):
    s, sc = samples(spark), scenario(spark)
    fires = trace.transfers(s)
    stage = {r.stage: r for r in trace.stage_latencies(fires).collect()}
    assert stage["block_transform"].p50 == 2 and stage["block_transform"]["count"] == 2
    gaps = trace.distribution(trace.intervals(fires), ["boundary"], "interval")
    assert gaps.where("boundary = 'transform_input'").first().maximum == 2
    assert trace.startups(fires).first().raster_startup == 2
    rates = trace.derived(sc).first()
    assert abs(rates.frames_per_second - 1e8 / 6) < 1e-6 and abs(rates.frame_time_us - 0.06) < 1e-12
    status = {r.target: r.status for r in trace.target_checks(fires, sc).collect()}
    assert status == {"input_cycles_per_pixel": "within", "block_transform_max_ii": "within", "steady_state_mcu_mean_ii": "unknown"}
    assert trace.unmatched_stages(fires).count() == 0
    counts = {r.boundary: r for r in trace.boundary_counts(s, sc).collect()}
    assert len(counts) == 14 and counts["mcu_output"].transfer_cycles == 1 and counts["mcu_output"].starved_cycles == 5


def test_frame_transition(spark):
    rows = [("s", c, "mcu_output", 1, 1) for c in (2, 5)]
    df = spark.createDataFrame(rows, "scenario string, cycle bigint, boundary string, valid int, ready int")
    out = trace.mcu_intervals(trace.intervals(trace.transfers(df)), scenario(spark, frames=2, width=1, mcus=2)).collect()
    assert [(r.kind, r.interval, r.steady) for r in out] == [("frame_transition", 3, False)]


def test_phases(spark):
    rows = list(zip(["s"] * 6, range(6), (0, 0, 1, 2, 3, 0), (0, 1, 1, 3, 4, 10), strict=True))
    df = spark.createDataFrame(rows, "scenario string, cycle bigint, raster_phase int, encoder_phase int")
    out = {(r.machine, r.phase): r.cycles for r in trace.residency(df).collect()}
    assert out["raster", "idle"] == 3 and out["encoder", "header"] == 2 and out["encoder", "flush"] == 0 and len(out) == 15
    assert captures.phase_violations(df, scenario(spark)).count() == 0


def test_csv_round_trip_and_defaults(spark, tmp_path):
    captures.write_csv(samples(spark).withColumn("ready", F.lit(True)), f"{tmp_path}/samples")
    back = captures.samples(spark, f"{tmp_path}/samples")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, samples(spark).collect()))
    (tmp_path / "s.csv").write_text("name,frames,width,height,frame_cycles,first_input_cycle,last_output_cycle,pixels,mcus\nold,,8,8,6,0,5,64,x\n")
    row = captures.scenarios(spark, f"{tmp_path}/s.csv").first()
    assert (row.scenario, row.frames, row.clock_hz, row.mcus) == ("old", 1, 100_000_000, None)


def test_integrity(spark):
    s, sc = samples(spark), scenario(spark)
    assert captures.scenario_violations(sc).count() == 0 and captures.sample_violations(s, sc).count() == 0
    assert [r.rule for r in captures.scenario_violations(scenario(spark, pixels=63)).collect()] == ["pixels"]
    odd = s.where("boundary <> 'mcu_output'").unionByName(s.limit(1)).unionByName(spark.createDataFrame([("t", 0, "nowhere", 2, 0)], s.schema))
    rules = {r.rule for r in captures.sample_violations(odd, sc).collect()}
    assert rules == {"unique_sample", "known_scenario", "known_boundary", "flags", "complete_boundaries"}


def test_distributions_of_nothing(spark):
    none = trace.transfers(samples(spark).where("cycle < 0"))
    assert trace.stage_latencies(none).count() == 0 and trace.startups(none).count() == 0
    out = trace.target_checks(none, scenario(spark)).collect()
    assert {r.status for r in out} == {"unknown"} and all(r.actual is None for r in out)


def test_exports(spark):
    s, sc = samples(spark), scenario(spark)
    counts = trace.boundary_counts(s, sc)
    assert trace.metrics_long(counts).count() == 14 * 5
    assert '"schema_version":3' in trace.metrics_json(counts, sc).first().json
    text = trace.pipeline_text(counts).first().mermaid
    assert text.startswith("flowchart LR\n") and "b12 --> b13" in text
    events = trace.timeline(s, trace.transfers(s), s.selectExpr("scenario", "cycle", "0 AS raster_phase", "1 AS encoder_phase").distinct())
    zigzag = events.where("name LIKE 'zigzag #%'").collect()
    assert [round(r.dur, 6) for r in zigzag] == [0.01, 0.01]  # at least one cycle
