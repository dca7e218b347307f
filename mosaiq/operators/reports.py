"""Text reports: lines, patterns, gates, address maps, verdicts. Rules are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import words

# Patterns of the reports' lines.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
UTILIZATION = r"^\|\s*([A-Za-z0-9_./ +()-]+?)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(?:(\d+)\s*\|\s*)?(\d+)\s*\|\s*([0-9.]+)\s*\|"
DRC_ROW = r"(?i)^\|\s*([A-Za-z0-9_.-]+)\s*\|\s*(Critical Warning|Error|Warning|Advisory)\s*\|"
DRC_MESSAGE = r"(?i)\b(CRITICAL WARNING|ERROR):\s*(.+)"
DRC_ZERO = r"(?i)\b(?:no drc violations found|violations found\s*[:=]\s*0|0\s+violations found)\b"
ROUTE = r"(?i)^\s*(?:#\s*)?([A-Za-z0-9_ /-]*(?:unrouted|routing errors?|not completely routed|routable nets|fully routed nets)[A-Za-z0-9_ /-]*)\s*(?:\.{2,})?\s*[:=]\s*(\d+)\b\s*:?"
FLOORPLAN = r"(?i)^\s*(Pblock Count|Placed Cell Count)\s*:\s*(\d+)\s*$"
HEX = r"0x[0-9a-fA-F_]+"
IGNORED = ("PS8",)


def lines(reports: DataFrame) -> DataFrame:
    """(path, text) to (path, line_no, text), lines in their order."""
    return reports.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "text"))


def first(pattern: str, group: int, of: str = "text") -> Column:
    return F.regexp_extract(F.col(of), pattern, group)


def timing(reports: DataFrame) -> DataFrame:
    """(path, wns, whs): ``WNS: v`` anywhere, else the first row with numbers in the five lines after a header that names it."""
    inline = [F.nullif(first(rf"\b{m}(?:\(ns\))?\s*[:=]\s*([-+]?\d+(?:\.\d+)?)", 1), F.lit("")).alias(f"inline_{m}") for m in ("WNS", "WHS")]
    whole = reports.select("path", *inline)
    rows = lines(reports)
    out = whole
    for metric, place in (("WNS", 1), ("WHS", 5)):
        heads = rows.where(F.col("text").contains("WNS(ns)") & F.col("text").contains(f"{metric}(ns)")).select("path", F.col("line_no").alias("head"))
        numbers = rows.select("path", "line_no", F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)).alias("ns")).where(F.size("ns") >= place)
        near = heads.join(numbers, "path").where((F.col("line_no") > F.col("head")) & (F.col("line_no") <= F.col("head") + 5))
        best = near.groupBy("path").agg(F.min(F.struct("head", "line_no", F.get("ns", F.lit(place - 1)).alias("v"))).v.alias(f"table_{metric}"))
        out = out.join(best, "path", "left")
    return out.select("path", *[F.coalesce(f"inline_{m}", f"table_{m}").cast("double").alias(m.lower()) for m in ("WNS", "WHS")])


def utilization(rows: DataFrame) -> DataFrame:
    found = rows.where(F.col("text").rlike(UTILIZATION))
    whole = lambda g: F.coalesce(F.nullif(first(UTILIZATION, g), F.lit("")), F.lit("0")).cast("bigint")
    return found.select("path", "line_no", F.regexp_replace(first(UTILIZATION, 1), r"\s+", " ").alias("name"), whole(2).alias("used"), whole(3).alias("fixed"), whole(4).alias("prohibited"), whole(5).alias("available"), first(UTILIZATION, 6).cast("double").alias("percent"))


def drc(rows: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity, message) from table rows, else from messages."""
    table, said = F.col("text").rlike(DRC_ROW), F.col("text").rlike(DRC_MESSAGE)
    severity = F.lower(F.regexp_replace(F.when(table, first(DRC_ROW, 2)).otherwise(first(DRC_MESSAGE, 1)), r"\s+", " "))
    return rows.where(table | said).select("path", "line_no", F.when(table, first(DRC_ROW, 1)).otherwise("").alias("rule"), severity.alias("severity"), F.trim(F.when(table, F.col("text")).otherwise(first(DRC_MESSAGE, 2))).alias("message"))


def route(rows: DataFrame) -> DataFrame:
    """(path, unrouted, errors): counts under their synonyms; unrouted is else routable less fully routed."""
    found = rows.where(F.col("text").rlike(ROUTE)).select("path", "line_no", words.label(first(ROUTE, 1)).alias("label"), first(ROUTE, 2).cast("bigint").alias("n"))
    value = lambda *names: F.max_by(F.when(F.col("label").isin(*names), F.col("n")), F.when(F.col("label").isin(*names), F.col("line_no")))
    wide = found.groupBy("path").agg(value("number_of_unrouted_nets", "number_of_nets_not_completely_routed").alias("u"), value("number_of_nets_with_routing_errors").alias("errors"), value("number_of_routable_nets").alias("r"), value("number_of_fully_routed_nets").alias("f"))
    return wide.select("path", F.coalesce("u", F.col("r") - F.col("f")).alias("unrouted"), "errors")


def floorplan(rows: DataFrame) -> DataFrame:
    found = rows.where(F.col("text").rlike(FLOORPLAN)).select("path", words.label(first(FLOORPLAN, 1)).alias("label"), first(FLOORPLAN, 2).cast("bigint").alias("n"))
    return found.groupBy("path").agg(F.max(F.when(F.col("label") == "pblock_count", F.col("n"))).alias("pblocks"), F.max(F.when(F.col("label") == "placed_cell_count", F.col("n"))).alias("placed_cells"))


def address(text: Column) -> Column:
    """A hexadecimal address, underscores ignored, as an unsigned 64-bit number; null for one that has more bits."""
    digits = F.regexp_replace(F.replace(F.substring(text, 3, 1 << 20), F.lit("_"), F.lit("")), "^0+(?=.)", "")
    return F.when(F.length(digits).between(1, 16), F.conv(F.when(F.length(digits).between(1, 16), digits), 16, 10).cast("decimal(20,0)"))


def address_map(rows: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(path, line_no, interface, base, high) of lines that name a component and interface, case ignored."""
    plain = rows.withColumn("plain", F.replace(F.lower("text"), F.lit("\\"), F.lit("/"))).withColumn("hex", F.regexp_extract_all("text", F.lit(HEX), F.lit(0))).where(F.size("hex") > 0)
    joined = plain.join(F.broadcast(interfaces), F.col("plain").contains(F.col("component")) & F.col("plain").contains(F.col("interface")))  # the required interfaces, a handful
    return joined.select("path", "line_no", F.concat_ws("/", "component", "interface").alias("interface"), address(F.get("hex", F.lit(0))).alias("base"), address(F.get("hex", F.lit(1))).alias("high"))


def overlaps(ranges: DataFrame, key: str = "id", step: int = 65536, within: list[str] | None = None) -> DataFrame:
    """Pairs (within, a, b), a < b, of different keys whose inclusive ranges [base, high] share an address.

    Cells have sizes ``step`` * 16^level. A range is held in the level where it touches
    at most two cells, however wide it is, and looks in the cells it touches of that and
    of the coarser levels that hold any range; a pair is reported once, in the cell where
    its later range begins. The cells are sorted and merged, never broadcast: the optimizer
    takes them for as few as the ranges, before each of these looks in its levels.
    """
    own = within or []
    size = lambda level: F.lit(float(step)) * F.pow(F.lit(16.0), level)
    cells = lambda level: F.sequence(F.floor(F.col("base").cast("double") / size(level)), F.floor(F.col("high").cast("double") / size(level)))
    length = (F.col("high") - F.col("base") + 1).cast("double")
    cut = ranges.where("base <= high").select(*own, F.col(key).alias("k"), "base", "high").withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(16.0, length / step))).cast("int"))
    present = cut.agg(F.collect_set("level").alias("present"))  # one row, 18 levels at most: 16^17 passes all 64 bits
    held = cut.select("*", F.explode(cells(F.col("level"))).alias("cell"))
    coarser = F.filter("present", lambda x: x >= F.col("level"))
    looks = cut.crossJoin(F.broadcast(present)).select("*", F.explode(coarser).alias("at")).select("*", F.explode(cells(F.col("at"))).alias("cell"))
    a, b = held.alias("a"), looks.alias("b").hint("merge")
    meet = (F.col("a.level") == F.col("b.at")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.k") != F.col("b.k"))
    for c in own:
        meet = meet & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    meet = meet & (F.col("a.base") <= F.col("b.high")) & (F.col("b.base") <= F.col("a.high"))
    once = (F.col("a.cell") == F.floor(F.greatest("a.base", "b.base").cast("double") / size(F.col("a.level")))) & ((F.col("a.level") > F.col("b.level")) | (F.col("a.k") < F.col("b.k")))
    return a.join(b, meet).where(once).select(*[F.col(f"a.{c}").alias(c) for c in own], F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))


def address_problems(entries: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(path, interface, rule) of missing, unreadable, repeated, inverted and overlapping entries of each report that has any."""
    need = interfaces.select(F.concat_ws("/", "component", "interface").alias("interface"))
    need = entries.select("path").distinct().crossJoin(F.broadcast(need))  # the required interfaces, a handful
    row = lambda df, rule: df.select("path", "interface", F.lit(rule).alias("rule"))
    distinct = entries.select("path", "interface", "base", "high").distinct()
    crossing = overlaps(distinct.where("high IS NOT NULL"), "interface", within=["path"])
    both = crossing.select("path", F.explode(F.array("a", "b")).alias("interface")).distinct()
    return (
        row(need.join(entries, ["path", "interface"], "left_anti"), "missing")
        .unionByName(row(distinct.where("base IS NULL"), "unreadable"))
        .unionByName(row(distinct.groupBy("path", "interface").count().where("count > 1"), "duplicate"))
        .unionByName(row(distinct.where("high < base"), "inverted"))
        .unionByName(row(both, "overlap"))
    )


def gates(reports: DataFrame, min_wns: float = 0.0, min_whs: float = 0.0, max_percent: float = 100.0) -> DataFrame:
    """(path, kind) reports to (path, rule, passed): timing, utilization, DRC, route and floorplan gates.

    A report whose rows cannot be found fails; hold slack is asked only of ``hold`` reports.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    of = lambda kind: reports.where(F.col("kind") == kind).select("path", "text")
    t = timing(reports.where("kind IN ('setup', 'hold')").select("path", "text")).join(reports.select("path", "kind"), "path")
    out = t.select("path", F.lit("wns").alias("rule"), ok(F.col("wns") >= min_wns).alias("passed"))
    out = out.unionByName(t.where("kind = 'hold'").select("path", F.lit("whs").alias("rule"), ok(F.col("whs") >= min_whs).alias("passed")))
    u = utilization(lines(of("utilization"))).where((F.col("available") > 0) & ~F.col("name").isin(*IGNORED))
    u = u.groupBy("path").agg(F.bool_and(F.col("percent") <= max_percent).alias("passed"))
    out = out.unionByName(of("utilization").select("path").join(u, "path", "left").select("path", F.lit("utilization").alias("rule"), ok(F.col("passed")).alias("passed")))
    d = drc(lines(of("drc"))).groupBy("path").agg(F.bool_or(F.col("severity").isin("error", "critical warning")).alias("blocking"), F.count(F.lit(1)).alias("n"))
    d = of("drc").select("path", F.col("text").rlike(DRC_ZERO).alias("zero")).join(d, "path", "left")
    out = out.unionByName(d.select("path", F.lit("drc").alias("rule"), (~F.coalesce("blocking", F.lit(False)) & (F.col("zero") | (F.coalesce("n", F.lit(0)) > 0))).alias("passed")))
    r = of("route").select("path").join(route(lines(of("route"))), "path", "left")
    out = out.unionByName(r.select("path", F.lit("route").alias("rule"), ok((F.col("unrouted") == 0) & (F.col("errors") == 0)).alias("passed")))
    f = of("floorplan").select("path").join(floorplan(lines(of("floorplan"))), "path", "left")
    return out.unionByName(f.select("path", F.lit("floorplan").alias("rule"), ok(F.col("pblocks").isNotNull() & (F.col("placed_cells") > 0)).alias("passed")))


def required(present: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """(key, status): ok, failed or missing, of everything needed; ``present`` has (key, passed)."""
    best = present.groupBy(key).agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    status = F.when(F.col("passed").isNull(), "missing").when(F.col("passed"), "ok").otherwise("failed")
    return needed.select(key).distinct().join(best, key, "left").select(key, status.alias("status"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: passed and failed counts and whether all passed; nothing checked is not complete."""
    return checks.agg(F.count_if(F.col("passed")).alias("n_passed"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_failed"), F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("complete"))
