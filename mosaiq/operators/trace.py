"""Cycle-trace analytics: states, runs, latencies, intervals, budgets, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.captures import BOUNDARIES, ENCODER_PHASES, RASTER_PHASES, STAGES

STATES = ("transfer", "blocked", "starved", "idle")


def state(valid: Column, ready: Column) -> Column:
    return F.when(valid & ready, "transfer").when(valid, "blocked").when(ready, "starved").otherwise("idle")


def with_state(samples: DataFrame) -> DataFrame:
    return samples.withColumn("state", state(F.col("valid") == 1, F.col("ready") == 1))


def runs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gaps and islands: (keys, value, start, duration) of runs of one value in consecutive cycles."""
    order = Window.partitionBy(*keys, value).orderBy("cycle")
    island = rows.withColumn("island", F.col("cycle") - F.row_number().over(order))
    return island.groupBy(*keys, value, "island").agg(F.min("cycle").alias("start"), F.count(F.lit(1)).alias("duration")).drop("island")


def boundary_counts(samples: DataFrame, scenarios: DataFrame, boundaries: tuple[str, ...] = BOUNDARIES) -> DataFrame:
    """One row for each scenario and boundary, also without samples: cycles by state, the longest blocked run, rates."""
    spark = samples.sparkSession
    names = spark.createDataFrame([(b, k) for k, b in enumerate(boundaries)], "boundary string, rank int")
    stated = with_state(samples)
    counts = stated.groupBy("scenario", "boundary").agg(*[F.count_if(F.col("state") == s).alias(f"{s}_cycles") for s in STATES])
    longest = runs(stated.where("state = 'blocked'"), ["scenario", "boundary"], "state").groupBy("scenario", "boundary").agg(F.max("duration").alias("longest_blocked_run"))
    dense = scenarios.select("scenario", "frame_cycles").crossJoin(F.broadcast(names))  # as many names as boundaries
    out = dense.join(counts, ["scenario", "boundary"], "left").join(longest, ["scenario", "boundary"], "left")
    filled = out.na.fill(0, [*[f"{s}_cycles" for s in STATES], "longest_blocked_run"])
    rate = F.col("transfer_cycles") / F.col("frame_cycles")
    return filled.withColumns({"transfers_per_cycle": rate, "transfer_utilization": rate})


def transfers(samples: DataFrame) -> DataFrame:
    """(scenario, boundary, cycle, i): transfers with their ordinal from 0."""
    order = Window.partitionBy("scenario", "boundary").orderBy("cycle")
    return samples.where("valid = 1 AND ready = 1").select("scenario", "boundary", "cycle").withColumn("i", F.row_number().over(order) - 1)


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, minimum, p50, p95 (nearest rank), maximum and mean of a value."""
    ranked = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))]
    return rows.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("minimum"), *ranked, F.max(value).alias("maximum"), F.avg(value).alias("mean"))


def paired(fires: DataFrame, first: str, second: str) -> DataFrame:
    """The k-th transfer of one boundary with the k-th of another."""
    a = fires.where(F.col("boundary") == first).select("scenario", "i", F.col("cycle").alias("begin"))
    b = fires.where(F.col("boundary") == second).select("scenario", "i", F.col("cycle").alias("end"))
    return a.join(b, ["scenario", "i"]).withColumn("latency", F.col("end") - F.col("begin"))


def stage_latencies(fires: DataFrame, stages: dict[str, tuple[str, str]] = STAGES) -> DataFrame:
    """Latency distribution of each scenario and stage."""
    out = None
    for name, (first, second) in stages.items():
        part = paired(fires, first, second).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return distribution(out, ["scenario", "stage"], "latency")


def unmatched_stages(fires: DataFrame, stages: dict[str, tuple[str, str]] = STAGES) -> DataFrame:
    """Stages whose inputs and outputs differ in number."""
    counts = fires.groupBy("scenario").pivot("boundary", list(BOUNDARIES)).count().na.fill(0)
    rows = [F.struct(F.lit(s).alias("stage"), F.col(a).alias("inputs"), F.col(b).alias("outputs")) for s, (a, b) in stages.items()]
    return counts.select("scenario", F.explode(F.array(*rows)).alias("s")).select("scenario", "s.*").where("inputs <> outputs")


def intervals(fires: DataFrame) -> DataFrame:
    """Add ``interval`` to the previous transfer of the same boundary; the first has none."""
    order = Window.partitionBy("scenario", "boundary").orderBy("i")
    return fires.withColumn("interval", F.col("cycle") - F.lag("cycle").over(order)).where("interval IS NOT NULL")


def block_intervals(gaps: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Transform input intervals, within and between MCUs."""
    per = F.when(F.col("sampling") == "4:4:4", 3).otherwise(6)
    rows = gaps.where("boundary = 'transform_input'").join(scenarios.select("scenario", "sampling"), "scenario")
    return rows.withColumn("kind", F.when(F.col("i") % per == 0, "between_mcu").otherwise("within_mcu"))


def mcu_intervals(gaps: DataFrame, scenarios: DataFrame) -> DataFrame:
    """MCU intervals with their kind (frame_transition, stripe_transition, within_row) and whether they are steady state."""
    s = scenarios.select("scenario", (F.col("mcus") / F.col("frames")).cast("bigint").alias("m"), F.ceil(F.col("width") / F.when(F.col("sampling") == "4:4:4", 8).otherwise(16)).alias("row"))
    rows = gaps.where("boundary = 'mcu_output'").join(s, "scenario").withColumn("k", F.col("i") % F.col("m"))
    kind = F.when(F.col("k") == 0, "frame_transition").when(F.col("k") % F.col("row") == 0, "stripe_transition").otherwise("within_row")
    return rows.withColumn("kind", kind).withColumn("steady", (F.col("kind") == "within_row") & (F.col("k") >= F.col("row")))


def residency(phases: DataFrame) -> DataFrame:
    """Cycles in each phase of both state machines, also phases without any."""
    spark = phases.sparkSession
    names = spark.createDataFrame([(m, k, n) for m, ns in (("raster", RASTER_PHASES), ("encoder", ENCODER_PHASES)) for k, n in enumerate(ns)], "machine string, code int, phase string")
    long = phases.select("scenario", F.expr("stack(2, 'raster', raster_phase, 'encoder', encoder_phase) as (machine, code)"))
    counts = long.groupBy("scenario", "machine", "code").agg(F.count(F.lit(1)).alias("cycles"))
    dense = phases.select("scenario").distinct().crossJoin(F.broadcast(names))  # 15 phases
    return dense.join(counts, ["scenario", "machine", "code"], "left").select("scenario", "machine", "phase", F.coalesce("cycles", F.lit(0)).alias("cycles"))


def startups(fires: DataFrame) -> DataFrame:
    """Cycles from the first input to the first MCU, entropy block and output byte, and the input's span."""
    first = lambda b: F.min(F.when(F.col("boundary") == b, F.col("cycle")))
    last = lambda b: F.max(F.when(F.col("boundary") == b, F.col("cycle")))
    begin = first("rgb_input")
    return fires.groupBy("scenario").agg(
        (first("mcu_output") - begin).alias("raster_startup"),
        (first("entropy_block_input") - begin).alias("entropy_startup"),
        (first("jpeg_output") - begin).alias("encoder_startup"),
        (last("rgb_input") - begin + 1).alias("input_span"),
    )


def derived(scenarios: DataFrame) -> DataFrame:
    c = F.col
    return scenarios.select(
        "scenario",
        (c("frame_cycles") / c("frames")).alias("average_frame_cycles"),
        (c("frame_cycles") * 1_000_000 / (c("clock_hz") * c("frames"))).alias("frame_time_us"),
        (c("frames") * c("clock_hz") / c("frame_cycles")).alias("frames_per_second"),
        (c("pixels") / c("frame_cycles")).alias("pixels_per_cycle"),
        (c("bytes") / c("frame_cycles")).alias("bytes_per_cycle"),
        (c("frame_cycles") / c("pixels")).alias("cycles_per_pixel"),
    )


def budget_status(actual: Column, budget: Column) -> Column:
    ratio = actual / budget
    return F.when(ratio.isNull(), "unknown").when(ratio > 1, "over").when(ratio > 0.9, "near").otherwise("within")


def budgets(spark: SparkSession) -> DataFrame:
    """Cycles allowed at 1080p30 and 100 MHz, by sampling."""
    rows = [("input_cycles_per_pixel", s, 1.61) for s in ("4:4:4", "4:2:0")]
    rows += [("block_transform_max_ii", "4:4:4", 34.3), ("block_transform_max_ii", "4:2:0", 68.1), ("steady_state_mcu_mean_ii", "4:4:4", 102.9), ("steady_state_mcu_mean_ii", "4:2:0", 408.5)]
    return spark.createDataFrame(rows, "target string, sampling string, budget double")


def target_checks(fires: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, target, actual, budget, ratio, status)."""
    gaps = intervals(fires)
    s = scenarios.select("scenario", "sampling", "pixels")
    span = startups(fires).join(s, "scenario").select("scenario", F.lit("input_cycles_per_pixel").alias("target"), (F.col("input_span") / F.col("pixels")).alias("actual"))
    block = block_intervals(gaps, scenarios).where("kind = 'within_mcu'").groupBy("scenario").agg(F.max("interval").cast("double").alias("actual")).withColumn("target", F.lit("block_transform_max_ii"))
    steady = mcu_intervals(gaps, scenarios).where("steady").groupBy("scenario").agg(F.avg("interval").alias("actual")).withColumn("target", F.lit("steady_state_mcu_mean_ii"))
    found = span.unionByName(block).unionByName(steady)
    dense = s.join(F.broadcast(budgets(fires.sparkSession)), "sampling")  # 6 rows
    out = dense.join(found, ["scenario", "target"], "left")
    return out.select("scenario", "target", "actual", "budget", (F.col("actual") / F.col("budget")).alias("ratio"), budget_status(F.col("actual"), F.col("budget")).alias("status"))


def metrics_long(counts: DataFrame) -> DataFrame:
    """Boundary counts unpivoted to (scenario, category, name, metric, value, unit), values as text."""
    cols = [f"{s}_cycles" for s in STATES] + ["longest_blocked_run"]
    long = counts.select("scenario", "boundary", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["scenario", "boundary"], cols, "metric", "value")
    return long.select("scenario", F.lit("boundary").alias("category"), F.col("boundary").alias("name"), "metric", "value", F.lit("cycles").alias("unit"))


def metrics_json(counts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One JSON document for each scenario, its boundaries in order."""
    each = F.struct("rank", F.col("boundary").alias("name"), F.col("transfer_cycles").alias("transfers"), "blocked_cycles", "starved_cycles", "idle_cycles", "longest_blocked_run")
    nested = counts.groupBy("scenario").agg(F.array_sort(F.collect_list(each)).alias("b"))
    boundaries = F.transform("b", lambda s: F.struct(s.blocked_cycles.alias("blocked_cycles"), s.idle_cycles.alias("idle_cycles"), s.longest_blocked_run.alias("longest_blocked_run"), s["name"].alias("name"), s.starved_cycles.alias("starved_cycles"), s.transfers.alias("transfers")))
    return nested.join(scenarios.select("scenario", "frame_cycles"), "scenario").select("scenario", F.to_json(F.struct(boundaries.alias("boundaries"), "frame_cycles", F.col("scenario").alias("name"), F.lit(3).alias("schema_version"))).alias("json"))


# Units of the frame's metrics, and the trace viewer's colours.
FRAME_UNITS = {"frame_cycles": "cycles", "average_frame_cycles": "cycles/frame", "frame_time_us": "microseconds", "frames_per_second": "frames/second", "pixels_per_cycle": "pixels/cycle", "bytes_per_cycle": "bytes/cycle", "input_acceptance_cycles_per_pixel": "cycles/pixel"}
COLORS = {"transfer": "good", "blocked": "bad", "starved": "thread_state_uninterruptible", "idle": "grey"}
STATISTICS = ("count", "minimum", "p50", "p95", "maximum", "mean")


def metrics_table(samples: DataFrame, phases: DataFrame, scenarios: DataFrame) -> DataFrame:
    """All metrics as (scenario, category, name, metric, value, text, unit): frames, boundaries, stages, phases and targets; ``text`` holds what is not a number."""
    fires = transfers(samples)
    gaps = intervals(fires)

    def long(df: DataFrame, category: str, name: Column, metrics: dict[str, str], prefix: str = "") -> DataFrame:
        wide = df.select("scenario", name.alias("name"), *[F.col(m).cast("double").alias(m) for m in metrics])
        rows = wide.unpivot(["scenario", "name"], list(metrics), "metric", "value")
        unit = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])
        return rows.select("scenario", F.lit(category).alias("category"), "name", F.concat(F.lit(prefix), "metric").alias("metric"), "value", F.lit(None).cast("string").alias("text"), F.element_at(unit, F.col("metric")).alias("unit"))

    cycles = dict.fromkeys(STATISTICS, "cycles")
    start = startups(fires)
    rate = start.join(scenarios.select("scenario", "pixels"), "scenario").select("scenario", (F.col("input_span") / F.col("pixels")).alias("input_acceptance_cycles_per_pixel"))
    frame = derived(scenarios).join(scenarios.select("scenario", "frame_cycles"), "scenario").join(rate, "scenario", "left")
    counts = boundary_counts(samples, scenarios).withColumnRenamed("transfer_cycles", "transfers")
    boundary = {"transfers": "transfers", **{f"{s}_cycles": "cycles" for s in STATES[1:]}, "longest_blocked_run": "cycles", "transfers_per_cycle": "transfers/cycle"}
    stage_of = F.create_map(*[F.lit(x) for s, (first, _) in STAGES.items() for x in (first, s)])
    starts = gaps.withColumn("stage", F.element_at(stage_of, F.col("boundary"))).where("stage IS NOT NULL")
    blocks = block_intervals(gaps, scenarios)
    mcus = mcu_intervals(gaps, scenarios)
    names = {"within_row": "within_stripe_or_band", "stripe_transition": "stripe_or_band_transition", "frame_transition": "frame_transition"}
    kinds = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    begun = {"raster_startup": "raster_startup_to_first_mcu_cycles", "encoder_startup": "encoder_startup_to_first_jpeg_byte_cycles", "entropy_startup": "encoder_startup_to_first_entropy_block_cycles"}
    checks = target_checks(fires, scenarios)
    none, text = F.lit(None).cast("double").alias("value"), F.col("status").alias("text")
    said = checks.select("scenario", F.lit("target").alias("category"), F.col("target").alias("name"), F.lit("status").alias("metric"), none, text, F.lit("").alias("unit"))
    stay = residency(phases).select("scenario", F.lit("phase").alias("category"), F.concat("machine", F.lit("_phase_cycles")).alias("name"), F.col("phase").alias("metric"), F.col("cycles").cast("double").alias("value"), F.lit(None).cast("string").alias("text"), F.lit("cycles").alias("unit"))
    parts = [
        long(frame, "frame", F.lit("frame"), FRAME_UNITS),
        long(counts, "boundary", F.col("boundary"), boundary),
        long(stage_latencies(fires), "stage", F.col("stage"), cycles, "latency_cycles."),
        long(distribution(starts, ["scenario", "stage"], "interval"), "stage", F.col("stage"), cycles, "initiation_interval_cycles."),
        long(start.withColumnsRenamed(begun), "phase", F.lit("startup"), dict.fromkeys(begun.values(), "cycles")),
        long(distribution(blocks, ["scenario", "kind"], "interval"), "phase", F.concat("kind", F.lit("_block_interval_cycles")), cycles),
        long(distribution(mcus.withColumn("kind", F.element_at(kinds, F.col("kind"))), ["scenario", "kind"], "interval"), "phase", F.concat("kind", F.lit("_mcu_interval_cycles")), cycles),
        long(distribution(mcus.where("steady"), ["scenario"], "interval"), "phase", F.lit("steady_state_mcu_interval_cycles"), cycles),
        stay,
        long(checks, "target", F.col("target"), {"actual": "", "budget": "", "ratio": "ratio"}),
        said,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metrics_document(table: DataFrame) -> DataFrame:
    """(scenario, json): all metrics of a scenario as one JSON document: a list of its categories, names and metrics, in order."""
    each = F.struct("category", "name", "metric", "value", "text", "unit")
    rows = table.groupBy("scenario").agg(F.array_sort(F.collect_list(each)).alias("metrics"))
    return rows.select("scenario", F.to_json(F.struct("metrics", F.col("scenario").alias("name"), F.lit(3).alias("schema_version"))).alias("json"))


def timeline(samples: DataFrame, fires: DataFrame, phases: DataFrame, clock_hz: int = 100_000_000) -> DataFrame:
    """Trace-viewer events (scenario, ph, tid, name, cat, cname, ts, dur, args), times in microseconds: names of processes and threads, runs of states and of phases, and latencies."""
    us = 1_000_000 / clock_hz
    base = len(BOUNDARIES)
    tids = {b: k for k, b in enumerate(BOUNDARIES, 1)} | {"phase/raster": base + 1, "phase/encoder": base + 2} | {f"latency/{s}": base + 3 + k for k, s in enumerate(STAGES)}
    tid = F.create_map(*[F.lit(x) for kv in tids.items() for x in kv])

    def event(df: DataFrame, track: Column, name: Column, cat: str, color: Column, start: Column, duration: Column, args: Column) -> DataFrame:
        return df.select("scenario", F.lit("X").alias("ph"), F.element_at(tid, track).alias("tid"), name.alias("name"), F.lit(cat).alias("cat"), color.alias("cname"), (start * us).alias("ts"), (duration * us).alias("dur"), F.to_json(args).alias("args"))

    span = [F.col("start").alias("start_cycle"), F.col("duration").alias("duration_cycles")]
    color = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    out = event(runs(with_state(samples), ["scenario", "boundary"], "state"), F.col("boundary"), F.col("state"), "ready_valid", F.element_at(color, F.col("state")), F.col("start"), F.col("duration"), F.struct(*span, "boundary"))
    for machine, names in (("raster", RASTER_PHASES), ("encoder", ENCODER_PHASES)):
        field = f"{machine}_phase"
        name = F.get(F.array(*[F.lit(n) for n in names]), F.col(field))
        out = out.unionByName(event(runs(phases, ["scenario"], field), F.lit(f"phase/{machine}"), name, "fsm_phase", F.lit("rail_load"), F.col("start"), F.col("duration"), F.struct(*span, F.col(field).alias("phase_code"))))
    for stage, (first, second) in STAGES.items():
        args = F.struct(F.col("i").alias("transaction"), F.col("begin").alias("start_cycle"), F.col("end").alias("end_cycle"), F.col("latency").alias("latency_cycles"))
        out = out.unionByName(event(paired(fires, first, second), F.lit(f"latency/{stage}"), F.concat(F.lit(f"{stage} #"), F.col("i").cast("string")), "transaction_latency", F.lit("rail_response"), F.col("begin"), F.greatest(F.lit(1), "latency"), args))
    labels = samples.sparkSession.createDataFrame([(0, None), *[(k, t) for t, k in tids.items()]], "tid int, label string")
    meta = samples.select("scenario").distinct().crossJoin(F.broadcast(labels))  # as many threads as boundaries, machines and stages
    none = lambda t: F.lit(None).cast(t)
    return out.unionByName(meta.select("scenario", F.lit("M").alias("ph"), "tid", F.when(F.col("tid") == 0, "process_name").otherwise("thread_name").alias("name"), none("string").alias("cat"), none("string").alias("cname"), none("double").alias("ts"), none("double").alias("dur"), F.to_json(F.struct(F.coalesce("label", "scenario").alias("name"))).alias("args")))


# Fill and stroke of a node by its status, and the boundary that shows a target's status.
STATUS_COLORS = {"over": ("#fee2e2", "#dc2626"), "near": ("#fef3c7", "#d97706"), "within": ("#dcfce7", "#16a34a"), "unknown": ("#f1f5f9", "#94a3b8"), "neutral": ("#f8fafc", "#64748b")}
TARGET_AT = {"input_cycles_per_pixel": "rgb_input", "block_transform_max_ii": "transform_input", "steady_state_mcu_mean_ii": "mcu_output"}


def pipeline_dot(counts: DataFrame, checks: DataFrame) -> DataFrame:
    """(scenario, rank, line): a DOT text of each scenario's boundaries, coloured by the status of the target that they show."""
    at = F.create_map(*[F.lit(x) for kv in TARGET_AT.items() for x in kv])
    shown = checks.select("scenario", F.element_at(at, F.col("target")).alias("boundary"), "status")
    fill, stroke = (F.create_map(*[F.lit(x) for k, v in STATUS_COLORS.items() for x in (k, v[n])]) for n in (0, 1))
    status = F.coalesce("status", F.lit("neutral"))
    node = F.concat(F.lit("  b"), F.col("rank").cast("string"), F.lit(' [label="'), "boundary", F.lit("\\n"), F.col("transfer_cycles").cast("string"), F.lit(' transfers", fillcolor="'), F.element_at(fill, status), F.lit('", color="'), F.element_at(stroke, status), F.lit('"];'))
    edge = F.when(F.col("rank") > 0, F.concat(F.lit(" b"), (F.col("rank") - 1).cast("string"), F.lit(" -> b"), F.col("rank").cast("string"), F.lit(";"))).otherwise("")
    rows = counts.join(shown, ["scenario", "boundary"], "left").select("scenario", "rank", F.concat(node, edge).alias("line"))
    ends = counts.select("scenario").distinct().select("scenario", F.explode(F.array(F.struct(F.lit(-1).alias("rank"), F.lit("digraph performance_pipeline { rankdir=LR; node [shape=box, style=filled];").alias("line")), F.struct(F.lit(1 << 20).alias("rank"), F.lit("}").alias("line")))).alias("e")).select("scenario", "e.*")
    return ends.unionByName(rows)


def requested(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the (scenario)s asked for, and the scenarios asked for that have none."""
    names = wanted.select("scenario").distinct()
    return rows.join(names, "scenario", "left_semi"), names.join(rows, "scenario", "left_anti")


def pipeline_text(counts: DataFrame) -> DataFrame:
    """A Mermaid flow chart of each scenario's boundaries with their transfers."""
    node = F.concat(F.lit("  b"), F.col("rank").cast("string"), F.lit('["'), F.col("boundary"), F.lit("<br/>"), F.col("transfer_cycles").cast("string"), F.lit(' transfers"]'))
    edge = F.when(F.col("rank") > 0, F.concat(F.lit("  b"), (F.col("rank") - 1).cast("string"), F.lit(" --> b"), F.col("rank").cast("string")))
    lines = counts.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("rank", node.alias("n"), edge.alias("e")))).alias("l"))
    return lines.select("scenario", F.concat_ws("\n", F.lit("flowchart LR"), F.transform("l", lambda s: s.n), F.filter(F.transform("l", lambda s: s.e), lambda e: e.isNotNull())).alias("mermaid"))
