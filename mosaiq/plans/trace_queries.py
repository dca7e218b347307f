"""Queries of cycle traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace
from ..sources import captures
from . import inputs as i

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = "(VALUES " + ", ".join(f"('{b}', {k})" for k, b in enumerate(captures.BOUNDARIES)) + ") bn(boundary, rank)"
DIST = "CAST(count({v}) AS BIGINT) AS count, CAST(min({v}) AS BIGINT) AS minimum, CAST(quantile_disc({v}, 0.5) AS BIGINT) AS p50, CAST(quantile_disc({v}, 0.95) AS BIGINT) AS p95, CAST(max({v}) AS BIGINT) AS maximum, round(avg({v}), 6) AS mean"


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(f"WITH {i.TRACES} SELECT scenario, boundary, state, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL")
def trace_states(spark, sf):
    return trace.with_state(i.traces(spark, sf)).groupBy("scenario", "boundary", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {i.TRACES}, isl AS (SELECT scenario, state, cycle, cycle - row_number() OVER (PARTITION BY scenario, state ORDER BY cycle) AS g FROM st) SELECT scenario, state, CAST(min(cycle) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS duration FROM isl GROUP BY scenario, state, g""")
def trace_state_runs(spark, sf):
    return trace.runs(trace.with_state(i.traces(spark, sf)), ["scenario"], "state")


@query(f"""WITH {i.TRACES}, isl AS (SELECT scenario, encoder_phase, cycle, cycle - row_number() OVER (PARTITION BY scenario, encoder_phase ORDER BY cycle) AS g FROM st) SELECT scenario, encoder_phase, CAST(max(n) AS BIGINT) AS longest FROM (SELECT scenario, encoder_phase, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1, 2""")
def trace_phase_runs(spark, sf):
    return trace.runs(i.traces(spark, sf), ["scenario"], "encoder_phase").groupBy("scenario", "encoder_phase").agg(F.max("duration").alias("longest"))


COUNTS = f"""WITH {i.CAPTURE}, {i.SCENARIOS}, cs AS (SELECT *, CASE WHEN valid = 1 AND ready = 1 THEN 'transfer' WHEN valid = 1 THEN 'blocked' WHEN ready = 1 THEN 'starved' ELSE 'idle' END AS state FROM cap),
  isl AS (SELECT scenario, boundary, count(*) AS n FROM (SELECT scenario, boundary, cycle - row_number() OVER (PARTITION BY scenario, boundary ORDER BY cycle) AS g FROM cs WHERE state = 'blocked') GROUP BY scenario, boundary, g),
  ct AS (SELECT sc.scenario, bn.boundary, rank, frame_cycles, CAST(count(*) FILTER (state = 'transfer') AS BIGINT) AS transfer_cycles, CAST(count(*) FILTER (state = 'blocked') AS BIGINT) AS blocked_cycles, CAST(count(*) FILTER (state = 'starved') AS BIGINT) AS starved_cycles, CAST(count(*) FILTER (state = 'idle') AS BIGINT) AS idle_cycles,
    CAST(coalesce((SELECT max(n) FROM isl WHERE isl.scenario = sc.scenario AND isl.boundary = bn.boundary), 0) AS BIGINT) AS longest_blocked_run
    FROM sc CROSS JOIN {NAMES} LEFT JOIN cs ON cs.scenario = sc.scenario AND cs.boundary = bn.boundary GROUP BY sc.scenario, bn.boundary, rank, frame_cycles)"""


def _counts(spark, sf):
    return trace.boundary_counts(i.renamed_traces(spark, sf), i.scenarios(spark, sf))


@query(COUNTS + " SELECT scenario, boundary, CAST(rank AS INT) AS rank, frame_cycles, transfer_cycles, blocked_cycles, starved_cycles, idle_cycles, longest_blocked_run, round(transfer_cycles / frame_cycles, 6) AS transfers_per_cycle, round(transfer_cycles / frame_cycles, 6) AS transfer_utilization FROM ct")
def boundary_counts(spark, sf):
    return rounded(_counts(spark, sf), "transfers_per_cycle", "transfer_utilization")


@query(COUNTS + " SELECT scenario, 'boundary' AS category, boundary AS name, metric, value, 'cycles' AS unit FROM (UNPIVOT (SELECT scenario, boundary, CAST(transfer_cycles AS VARCHAR) AS transfer_cycles, CAST(blocked_cycles AS VARCHAR) AS blocked_cycles, CAST(starved_cycles AS VARCHAR) AS starved_cycles, CAST(idle_cycles AS VARCHAR) AS idle_cycles, CAST(longest_blocked_run AS VARCHAR) AS longest_blocked_run FROM ct) ON transfer_cycles, blocked_cycles, starved_cycles, idle_cycles, longest_blocked_run INTO NAME metric VALUE value)")
def metrics_long(spark, sf):
    return trace.metrics_long(_counts(spark, sf))


@query(COUNTS + """ SELECT scenario, '{"boundaries":[' || string_agg('{"blocked_cycles":' || blocked_cycles || ',"idle_cycles":' || idle_cycles || ',"longest_blocked_run":' || longest_blocked_run || ',"name":"' || boundary || '","starved_cycles":' || starved_cycles || ',"transfers":' || transfer_cycles || '}', ',' ORDER BY rank) || '],"frame_cycles":' || frame_cycles || ',"name":"' || scenario || '","schema_version":3}' AS json FROM ct GROUP BY scenario, frame_cycles""")
def metrics_json(spark, sf):
    return trace.metrics_json(_counts(spark, sf), i.scenarios(spark, sf))


@query(COUNTS + """ SELECT scenario, 'flowchart LR' || chr(10) || string_agg('  b' || rank || '["' || boundary || '<br/>' || transfer_cycles || ' transfers"]', chr(10) ORDER BY rank) || chr(10) || string_agg('  b' || (rank - 1) || ' --> b' || rank, chr(10) ORDER BY rank) FILTER (rank > 0) AS mermaid FROM ct GROUP BY scenario""")
def pipeline_text(spark, sf):
    return trace.pipeline_text(_counts(spark, sf))


STAGE = "(VALUES ('dct', 'dct_input', 'dct_output'), ('quantize', 'quantize_input', 'quantize_output'), ('zigzag', 'zigzag_input', 'zigzag_output'), ('block_transform', 'transform_input', 'transform_output')) sg(stage, a, b)"


@query(f"WITH {i.CAPTURE}, pr AS (SELECT x.scenario, stage, y.cycle - x.cycle AS latency FROM {STAGE} JOIN fires x ON x.boundary = a JOIN fires y ON y.boundary = b AND y.scenario = x.scenario AND y.i = x.i) SELECT scenario, stage, {DIST.format(v='latency')} FROM pr GROUP BY 1, 2")
def stage_latencies(spark, sf):
    return rounded(trace.stage_latencies(trace.transfers(i.renamed_traces(spark, sf))), "mean")


@query(f"WITH {i.CAPTURE}, n AS (SELECT scenario, boundary, count(*) AS n FROM fires GROUP BY ALL), s AS (SELECT DISTINCT scenario FROM fires) SELECT s.scenario, stage, CAST(coalesce(x.n, 0) AS BIGINT) AS inputs, CAST(coalesce(y.n, 0) AS BIGINT) AS outputs FROM s CROSS JOIN {STAGE} LEFT JOIN n x ON x.scenario = s.scenario AND x.boundary = a LEFT JOIN n y ON y.scenario = s.scenario AND y.boundary = b WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
def unmatched_stages(spark, sf):
    return trace.unmatched_stages(trace.transfers(i.renamed_traces(spark, sf)))


GAPS = f"WITH {i.CAPTURE}, {i.SCENARIOS}, gp AS (SELECT * FROM (SELECT *, cycle - lag(cycle) OVER (PARTITION BY scenario, boundary ORDER BY i) AS interval FROM fires) WHERE interval IS NOT NULL)"


@query(GAPS + f" SELECT scenario, boundary, {DIST.format(v='interval')} FROM gp GROUP BY 1, 2")
def initiation_intervals(spark, sf):
    gaps = trace.intervals(trace.transfers(i.renamed_traces(spark, sf)))
    return rounded(trace.distribution(gaps, ["scenario", "boundary"], "interval"), "mean")


@query(GAPS + f", k AS (SELECT gp.*, CASE WHEN i % (CASE WHEN sampling = '4:4:4' THEN 3 ELSE 6 END) = 0 THEN 'between_mcu' ELSE 'within_mcu' END AS kind FROM gp JOIN sc USING (scenario) WHERE boundary = 'transform_input') SELECT scenario, kind, {DIST.format(v='interval')} FROM k GROUP BY 1, 2")
def block_intervals(spark, sf):
    gaps = trace.intervals(trace.transfers(i.renamed_traces(spark, sf)))
    return rounded(trace.distribution(trace.block_intervals(gaps, i.scenarios(spark, sf)), ["scenario", "kind"], "interval"), "mean")


MCU = ", mk AS (SELECT gp.*, i % (mcus // frames) AS k, CASE WHEN sampling = '4:4:4' THEN 8 ELSE 4 END AS r FROM gp JOIN sc USING (scenario) WHERE boundary = 'mcu_output'), mi AS (SELECT *, CASE WHEN k = 0 THEN 'frame_transition' WHEN k % r = 0 THEN 'stripe_transition' ELSE 'within_row' END AS kind, k % r <> 0 AND k >= r AS steady FROM mk)"


@query(GAPS + MCU + f" SELECT scenario, kind, steady, {DIST.format(v='interval')} FROM mi GROUP BY 1, 2, 3")
def mcu_intervals(spark, sf):
    gaps = trace.intervals(trace.transfers(i.renamed_traces(spark, sf)))
    return rounded(trace.distribution(trace.mcu_intervals(gaps, i.scenarios(spark, sf)), ["scenario", "kind", "steady"], "interval"), "mean")


PHASE = "(VALUES " + ", ".join(f"('{m}', {k}, '{n}')" for m, ns in (("raster", captures.RASTER_PHASES), ("encoder", captures.ENCODER_PHASES)) for k, n in enumerate(ns)) + ") ph(machine, code, phase)"


@query(f"WITH {i.TRACES} SELECT s.scenario, machine, phase, CAST(count(tr.cycle) AS BIGINT) AS cycles FROM (SELECT DISTINCT scenario FROM tr) s CROSS JOIN {PHASE} LEFT JOIN tr ON tr.scenario = s.scenario AND code = CASE WHEN machine = 'raster' THEN raster_phase ELSE encoder_phase END GROUP BY 1, 2, 3")
def phase_residency(spark, sf):
    return trace.residency(i.traces(spark, sf))


FIRST = "min(cycle) FILTER (boundary = '{b}')"
START = f"""su AS (SELECT scenario, {FIRST.format(b='mcu_output')} - {FIRST.format(b='rgb_input')} AS raster_startup, {FIRST.format(b='entropy_block_input')} - {FIRST.format(b='rgb_input')} AS entropy_startup, {FIRST.format(b='jpeg_output')} - {FIRST.format(b='rgb_input')} AS encoder_startup, max(cycle) FILTER (boundary = 'rgb_input') - {FIRST.format(b='rgb_input')} + 1 AS input_span FROM fires GROUP BY 1)"""


@query(f"WITH {i.CAPTURE}, {START} SELECT * FROM su")
def startups(spark, sf):
    return trace.startups(trace.transfers(i.renamed_traces(spark, sf)))


@query(f"WITH {i.CAPTURE}, {i.SCENARIOS} SELECT scenario, round(frame_cycles / frames, 6) AS average_frame_cycles, round(frame_cycles * 1000000 / (clock_hz * frames), 6) AS frame_time_us, round(frames * clock_hz / frame_cycles, 6) AS frames_per_second, round(pixels / frame_cycles, 6) AS pixels_per_cycle, round(bytes / frame_cycles, 6) AS bytes_per_cycle, round(frame_cycles / pixels, 6) AS cycles_per_pixel FROM sc")
def derived_rates(spark, sf):
    out = trace.derived(i.scenarios(spark, sf))
    return rounded(out, *out.columns[1:])


@query(GAPS + MCU + f""", {START}, ac AS (SELECT scenario, 'input_cycles_per_pixel' AS target, input_span / pixels AS actual FROM su JOIN sc USING (scenario) UNION ALL SELECT scenario, 'steady_state_mcu_mean_ii', avg(interval) FROM mi WHERE steady GROUP BY 1
  UNION ALL SELECT scenario, 'block_transform_max_ii', max(interval) FROM gp JOIN sc USING (scenario) WHERE boundary = 'transform_input' AND i % (CASE WHEN sampling = '4:4:4' THEN 3 ELSE 6 END) <> 0 GROUP BY 1),
  bu AS (SELECT * FROM (VALUES ('input_cycles_per_pixel', '4:4:4', 1.61::DOUBLE), ('input_cycles_per_pixel', '4:2:0', 1.61), ('block_transform_max_ii', '4:4:4', 34.3), ('block_transform_max_ii', '4:2:0', 68.1), ('steady_state_mcu_mean_ii', '4:4:4', 102.9), ('steady_state_mcu_mean_ii', '4:2:0', 408.5)) v(target, sampling, budget))
  SELECT sc.scenario, bu.target, round(actual, 6) AS actual, budget, round(actual / budget, 6) AS ratio, CASE WHEN actual IS NULL THEN 'unknown' WHEN actual / budget > 1 THEN 'over' WHEN actual / budget > 0.9 THEN 'near' ELSE 'within' END AS status FROM sc JOIN bu USING (sampling) LEFT JOIN ac ON ac.scenario = sc.scenario AND ac.target = bu.target""")
def target_checks(spark, sf):
    return rounded(trace.target_checks(trace.transfers(i.renamed_traces(spark, sf)), i.scenarios(spark, sf)), "actual", "ratio")


TRACKS = {b: k for k, b in enumerate(captures.BOUNDARIES, 1)}
PHASE_RUNS = """SELECT scenario, {m}_phase AS code, min(cycle) AS s, count(*) AS n FROM (SELECT *, cycle - row_number() OVER (PARTITION BY scenario, {m}_phase ORDER BY cycle) AS g FROM cph) GROUP BY scenario, {m}_phase, g"""


def _phase_events(machine: str, names: tuple[str, ...], tid: int) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT scenario, 'X' AS ph, {tid} AS tid, ([{listed}])[code + 1] AS name, 'fsm_phase' AS cat, 'rail_load' AS cname, round(s * 0.01, 6) AS ts, round(n * 0.01, 6) AS dur, '{{"start_cycle":' || s || ',"duration_cycles":' || n || ',"phase_code":' || code || '}}' AS args FROM ({PHASE_RUNS.format(m=machine)})"""


@query(f"""WITH {i.CAPTURE}, {i.PHASES}, cs AS (SELECT *, CASE WHEN valid = 1 AND ready = 1 THEN 'transfer' ELSE 'blocked' END AS state FROM cap), rn AS (SELECT scenario, boundary, state, min(cycle) AS s, count(*) AS n FROM (SELECT *, cycle - row_number() OVER (PARTITION BY scenario, boundary, state ORDER BY cycle) AS g FROM cs) GROUP BY scenario, boundary, state, g),
  tn AS (SELECT * FROM (VALUES (0, NULL), {", ".join(f"({k}, '{b}')" for b, k in TRACKS.items())}, (15, 'phase/raster'), (16, 'phase/encoder'), (17, 'latency/dct'), (18, 'latency/quantize'), (19, 'latency/zigzag'), (20, 'latency/block_transform')) v(tid, label)),
  al AS (SELECT scenario, 'X' AS ph, tid, state AS name, 'ready_valid' AS cat, CASE state WHEN 'transfer' THEN 'good' ELSE 'bad' END AS cname, round(s * 0.01, 6) AS ts, round(n * 0.01, 6) AS dur, '{{"start_cycle":' || s || ',"duration_cycles":' || n || ',"boundary":"' || boundary || '"}}' AS args FROM rn JOIN tn ON label = boundary
  UNION ALL {_phase_events('raster', captures.RASTER_PHASES, 15)} UNION ALL {_phase_events('encoder', captures.ENCODER_PHASES, 16)}
  UNION ALL SELECT x.scenario, 'X', tid, stage || ' #' || x.i, 'transaction_latency', 'rail_response', round(x.cycle * 0.01, 6), round(greatest(1, y.cycle - x.cycle) * 0.01, 6), '{{"transaction":' || x.i || ',"start_cycle":' || x.cycle || ',"end_cycle":' || y.cycle || ',"latency_cycles":' || (y.cycle - x.cycle) || '}}' FROM {STAGE} JOIN tn ON label = 'latency/' || stage JOIN fires x ON x.boundary = a JOIN fires y ON y.boundary = b AND y.scenario = x.scenario AND y.i = x.i
  UNION ALL SELECT scenario, 'M', tid, CASE WHEN tid = 0 THEN 'process_name' ELSE 'thread_name' END, NULL, NULL, NULL, NULL, '{{"name":"' || coalesce(label, scenario) || '"}}' FROM (SELECT DISTINCT scenario FROM cap), tn)
  SELECT scenario, ph, CAST(tid AS INT) AS tid, name, cat, cname, CAST(ts AS DOUBLE) AS ts, CAST(dur AS DOUBLE) AS dur, args FROM al""")
def timeline_events(spark, sf):
    samples = i.renamed_traces(spark, sf)
    return rounded(trace.timeline(samples, trace.transfers(samples), i.capture_phases(spark, sf)), "ts", "dur")


def _long(source: str, category: str, name: str, metrics: dict[str, str], prefix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT scenario, '{category}' AS category, {name} AS name, '{prefix}{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value, NULL::VARCHAR AS text, '{u}' AS unit FROM {source}" for m, u in metrics.items())


CYCLES = dict.fromkeys(trace.STATISTICS, "cycles")
RESIDENCY = f"SELECT s.scenario, machine, phase, count(cph.cycle) AS cycles FROM (SELECT DISTINCT scenario FROM cph) s CROSS JOIN {PHASE} LEFT JOIN cph ON cph.scenario = s.scenario AND code = CASE WHEN machine = 'raster' THEN raster_phase ELSE encoder_phase END GROUP BY 1, 2, 3"
METRICS = (
    f"WITH {i.PHASES}, fq AS (SELECT d.*, frame_cycles, input_acceptance_cycles_per_pixel FROM ({SQL['derived_rates']}) d JOIN (WITH {i.CAPTURE}, {i.SCENARIOS}, {START} SELECT sc.scenario, frame_cycles, input_span / pixels AS input_acceptance_cycles_per_pixel FROM sc LEFT JOIN su ON su.scenario = sc.scenario) e USING (scenario)), bq AS (SELECT *, transfer_cycles AS transfers FROM ({SQL['boundary_counts']})), lq AS ({SQL['stage_latencies']}),"
    + f" iq AS (SELECT q.*, stage FROM ({SQL['initiation_intervals']}) q JOIN {STAGE} ON a = boundary), sq AS (SELECT *, raster_startup AS raster_startup_to_first_mcu_cycles, encoder_startup AS encoder_startup_to_first_jpeg_byte_cycles, entropy_startup AS encoder_startup_to_first_entropy_block_cycles FROM ({SQL['startups']})), kq AS ({SQL['block_intervals']}),"
    + f" mq AS ({GAPS}{MCU} SELECT scenario, CASE kind WHEN 'within_row' THEN 'within_stripe_or_band' WHEN 'stripe_transition' THEN 'stripe_or_band_transition' ELSE kind END AS kind, {DIST.format(v='interval')} FROM mi GROUP BY 1, 2), yq AS ({GAPS}{MCU} SELECT scenario, {DIST.format(v='interval')} FROM mi WHERE steady GROUP BY 1), tq AS ({SQL['target_checks']}), mt AS ("
    + " UNION ALL ".join([
        _long("fq", "frame", "'frame'", trace.FRAME_UNITS),
        _long("bq", "boundary", "boundary", {"transfers": "transfers", "blocked_cycles": "cycles", "starved_cycles": "cycles", "idle_cycles": "cycles", "longest_blocked_run": "cycles", "transfers_per_cycle": "transfers/cycle"}),
        _long("lq", "stage", "stage", CYCLES, "latency_cycles."),
        _long("iq", "stage", "stage", CYCLES, "initiation_interval_cycles."),
        _long("sq", "phase", "'startup'", dict.fromkeys(("raster_startup_to_first_mcu_cycles", "encoder_startup_to_first_jpeg_byte_cycles", "encoder_startup_to_first_entropy_block_cycles"), "cycles")),
        _long("kq", "phase", "kind || '_block_interval_cycles'", CYCLES),
        _long("mq", "phase", "kind || '_mcu_interval_cycles'", CYCLES),
        _long("yq", "phase", "'steady_state_mcu_interval_cycles'", CYCLES),
        f"SELECT scenario, 'phase', machine || '_phase_cycles', phase, CAST(cycles AS DOUBLE), NULL, 'cycles' FROM ({RESIDENCY})",
        _long("tq", "target", "target", {"actual": "", "budget": "", "ratio": "ratio"}),
        "SELECT scenario, 'target', target, 'status', NULL, status, '' FROM tq",
    ])
    + ")"
)


def _metrics(spark, sf):
    return rounded(trace.metrics_table(i.renamed_traces(spark, sf), i.capture_phases(spark, sf), i.scenarios(spark, sf)), "value")


@query(METRICS + " SELECT * FROM mt")
def metrics_table(spark, sf):
    return _metrics(spark, sf)


@query(METRICS + """ SELECT scenario, CAST(count(*) AS BIGINT) AS n, 3::BIGINT AS version, scenario AS name, string_agg(category || '/' || name || '/' || metric, ',' ORDER BY category, name, metric) AS listed, string_agg(text, ',' ORDER BY category, name, metric) AS texts, round(sum(value), 3) AS total FROM mt GROUP BY scenario""")
def metrics_documents(spark, sf):
    """What the JSON documents of all metrics hold, read back from their text."""
    doc = trace.metrics_document(_metrics(spark, sf)).select("scenario", F.from_json("json", "metrics array<struct<category:string,name:string,metric:string,value:double,text:string,unit:string>>, name string, schema_version bigint").alias("d"))
    total = F.aggregate("d.metrics", F.lit(0.0), lambda a, m: a + F.coalesce(m.value, F.lit(0.0)))
    listed = F.array_join(F.transform("d.metrics", lambda m: F.concat_ws("/", m.category, m["name"], m.metric)), ",")
    return doc.select("scenario", F.size("d.metrics").cast("bigint").alias("n"), F.col("d.schema_version").alias("version"), F.col("d.name").alias("name"), listed.alias("listed"), F.array_join(F.transform("d.metrics", lambda m: m.text), ",").alias("texts"), F.round(total, 3).alias("total"))


@query(f"""WITH ct AS ({SQL['boundary_counts']}), tq AS ({SQL['target_checks']}), st AS (SELECT scenario, CASE target WHEN 'input_cycles_per_pixel' THEN 'rgb_input' WHEN 'block_transform_max_ii' THEN 'transform_input' ELSE 'mcu_output' END AS boundary, status FROM tq), cl AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in trace.STATUS_COLORS.items())}) v(status, fill, stroke))
  SELECT scenario, rank, '  b' || rank || ' [label="' || boundary || '\\n' || transfer_cycles || ' transfers", fillcolor="' || fill || '", color="' || stroke || '"];' || CASE WHEN rank > 0 THEN ' b' || (rank - 1) || ' -> b' || rank || ';' ELSE '' END AS line FROM ct LEFT JOIN st USING (scenario, boundary) JOIN cl ON cl.status = coalesce(st.status, 'neutral')
  UNION ALL SELECT scenario, r, l FROM (SELECT DISTINCT scenario FROM ct), (VALUES (-1, 'digraph performance_pipeline {{ rankdir=LR; node [shape=box, style=filled];'), (1048576, '}}')) v(r, l)""")
def pipeline_dot(spark, sf):
    fires = trace.transfers(i.renamed_traces(spark, sf))
    return trace.pipeline_dot(_counts(spark, sf), trace.target_checks(fires, i.scenarios(spark, sf)))


@query(f"WITH {i.CAPTURE}, w AS (SELECT * FROM (VALUES ('3'), ('7'), ('absent')) v(scenario)) SELECT scenario, boundary, CAST(count(*) AS BIGINT) AS n, true AS present FROM cap WHERE scenario IN (SELECT scenario FROM w) GROUP BY 1, 2 UNION ALL SELECT scenario, NULL, 0, false FROM w WHERE scenario NOT IN (SELECT scenario FROM cap)")
def requested_scenarios(spark, sf):
    kept, missing = trace.requested(i.renamed_traces(spark, sf), spark.createDataFrame([("3",), ("7",), ("absent",), ("3",)], "scenario string"))
    rows = kept.groupBy("scenario", "boundary").agg(F.count(F.lit(1)).alias("n")).withColumn("present", F.lit(True))
    return rows.unionByName(missing.select("scenario", F.lit(None).cast("string").alias("boundary"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("present")))


@query(f"WITH {i.CAPTURE}, {i.SCENARIOS} SELECT scenario, 'mcus_per_frame' AS rule, CAST(mcus AS VARCHAR) AS detail FROM sc WHERE mcus % frames <> 0 UNION ALL SELECT scenario, 'pixels', CAST(pixels + 1 AS VARCHAR) FROM sc WHERE frames = 2 UNION ALL SELECT scenario, 'unique_scenario', '2' FROM sc WHERE frames = 3")
def scenario_integrity(spark, sf):
    s = i.scenarios(spark, sf)
    broken = s.withColumn("pixels", F.col("pixels") + (F.col("frames") == 2).cast("int")).unionByName(s.where("frames = 3"))
    return captures.scenario_violations(broken)


@query(f"""WITH {i.CAPTURE}, {i.SCENARIOS}, kn AS (SELECT scenario FROM sc WHERE scenario <> '3') SELECT scenario, 'known_scenario' AS rule, CAST(cycle AS VARCHAR) AS detail FROM cap WHERE scenario = '3' UNION ALL SELECT scenario, 'flags', CAST(cycle AS VARCHAR) FROM cap WHERE cycle % 100 = 7
  UNION ALL SELECT scenario, 'unique_sample', cycle || '/' || boundary FROM cap WHERE scenario = '4' UNION ALL SELECT kn.scenario, 'complete_boundaries', boundary FROM kn CROSS JOIN {NAMES} WHERE NOT EXISTS (SELECT 1 FROM cap WHERE cap.scenario = kn.scenario AND cap.boundary = bn.boundary)""")
def sample_integrity(spark, sf):
    rows = i.renamed_traces(spark, sf)
    odd = rows.withColumn("ready", F.when(F.col("cycle") % 100 == 7, 2).otherwise(F.col("ready")))
    twice = odd.unionByName(rows.where("scenario = '4'").withColumn("ready", F.lit(1)))
    return captures.sample_violations(twice, i.scenarios(spark, sf).where("scenario <> '3'"))


@query(f"""WITH {i.TRACES}, sp AS (SELECT scenario, max(cycle) AS n FROM tr GROUP BY 1) SELECT tr.scenario, 'known_phase' AS rule, CAST(cycle AS VARCHAR) AS detail FROM tr JOIN sp USING (scenario) WHERE cycle % 9 = 0
  UNION ALL SELECT scenario, 'missing_phase', CAST(n + 1 AS VARCHAR) FROM sp UNION ALL SELECT scenario, 'extra_phase', '1' FROM sp""")
def phase_integrity(spark, sf):
    rows = i.traces(spark, sf).select("scenario", "cycle", F.when(F.col("cycle") % 9 == 0, 9).otherwise(F.col("raster_phase")).alias("raster_phase"), "encoder_phase")
    known = rows.groupBy("scenario").agg(F.lit(2).cast("bigint").alias("first_input_cycle"), (F.max("cycle") + 1).alias("last_output_cycle"))
    return captures.phase_violations(rows, known)
