"""Queries of module graphs, text reports, register words and evidence records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import words
from ..operators import evidence, graph, reports
from ..sources import images
from . import inputs as i

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def roots(spark):
    return spark.createDataFrame([("world",), ("n3",), ("mem_BUILDING",), ("absent",)], "root string")


REACH = f"""WITH RECURSIVE {i.LINKS}, rc(root, node) AS (SELECT root, root FROM (VALUES ('world'), ('n3'), ('mem_BUILDING'), ('absent')) v(root) UNION SELECT rc.root, lk.dst FROM rc JOIN lk ON lk.src = rc.node)"""


@query(REACH + " SELECT root, node, CASE WHEN starts_with(node, 'mem_') THEN 'memory' ELSE 'module' END AS kind FROM rc")
def graph_reachability(spark, sf):
    return graph.reachable(i.links(spark, sf), roots(spark)).withColumn("kind", graph.node_kind(F.col("node")))


@query(f"""WITH RECURSIVE {i.LINKS}, dl AS (SELECT DISTINCT * FROM lk), h(depth, module, instance, path, above, recursive) AS (SELECT 0, 'world', 'world', 'world', []::VARCHAR[], false
  UNION ALL SELECT depth + 1, dl.dst, dl.instance, path || '.' || dl.instance, list_append(above, module), list_contains(list_append(above, module), dl.dst) FROM h JOIN dl ON dl.src = h.module WHERE NOT recursive AND depth < 64) SELECT CAST(depth AS INT) AS depth, module, instance, path, recursive FROM h""")
def graph_hierarchy(spark, sf):
    return graph.hierarchy(spark, i.links(spark, sf), "world", max_instances=None)


HIERARCHY = SQL["graph_hierarchy"].rpartition(" SELECT CAST(depth")[0]
NAME = "'n_' || left(sha256({p}), 16)"
PARENT = "regexp_extract(path, '^(.*)\\.[^.]*$', 1)"


def _tree(spark, sf):
    return graph.hierarchy(spark, i.links(spark, sf), "world", max_instances=None)


@query(HIERARCHY + f" SELECT path, '  ' || CASE WHEN depth > 0 THEN {NAME.format(p=PARENT)} || ' --> ' ELSE '' END || {NAME.format(p='path')} || '[\"' || instance || CASE WHEN instance <> module THEN ': ' || module ELSE '' END || CASE WHEN recursive THEN ' (recursive)' ELSE '' END || '\"]' AS line FROM h")
def hierarchy_mermaid(spark, sf):
    return graph.hierarchy_lines(_tree(spark, sf))


@query(HIERARCHY + f" SELECT path, '  ' || {NAME.format(p='path')} || ' [label=\"' || instance || CASE WHEN instance <> module THEN ': ' || module ELSE '' END || CASE WHEN recursive THEN ' (recursive)' ELSE '' END || '\"];' || CASE WHEN depth > 0 THEN ' ' || {NAME.format(p=PARENT)} || ' -> ' || {NAME.format(p='path')} || ';' ELSE '' END AS line FROM h")
def hierarchy_dot(spark, sf):
    return graph.hierarchy_lines(_tree(spark, sf), "dot")


@query(HIERARCHY + ", rc(node) AS (SELECT 'world' UNION SELECT dst FROM rc JOIN lk ON src = node) SELECT (SELECT count(DISTINCT src) FROM lk) AS definitions, (SELECT count(*) FROM rc) AS reachable, (SELECT count(*) FROM h) AS instances")
def graph_counts(spark, sf):
    links = i.links(spark, sf)
    return graph.counts(graph.reachable(links, roots(spark).where("root = 'world'")), _tree(spark, sf), links)


@query("SELECT * FROM (VALUES ('absent')) v(root)")
def missing_focus(spark, sf):
    return graph.focus_cones(i.links(spark, sf), roots(spark))[1]


@query("SELECT 'page' || page_id || '.html' AS name, 'write' AS action, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS sha256, '- [' || url || '](page' || page_id || '.html)' AS index_line FROM pages UNION ALL SELECT 'page' || (page_id + n) || '.html', 'delete', NULL, NULL, NULL FROM pages, (SELECT max(page_id) + 1 AS n FROM pages) WHERE page_id < 5")
def artifact_manifest(spark, sf):
    """Files with their index lines, and those that only a previous manifest names; its other names lie outside the folder."""
    p = i.table(spark, sf, "pages")
    name = lambda k: F.concat(F.lit("page"), k, F.lit(".html"))
    now = p.select(name(F.col("page_id")).alias("name"), F.col("url").alias("title"), F.col("html").alias("content"))
    n = p.agg((F.max("page_id") + 1).alias("n"))
    old = p.crossJoin(F.broadcast(n)).select(F.explode(F.array(name(F.col("page_id")), F.when(F.col("page_id") < 5, name(F.col("page_id") + F.col("n"))).otherwise("../x"))).alias("name"))  # one row
    return graph.manifest(now, old)


@query(REACH + ", sel AS (SELECT node FROM rc WHERE root = 'n3') SELECT src, dst, array_to_string(list_sort(list(instance)), ',') AS instances, CAST(count(*) AS BIGINT) AS n FROM lk WHERE src IN (SELECT node FROM sel) AND dst IN (SELECT node FROM sel) GROUP BY 1, 2")
def graph_dependencies(spark, sf):
    links = i.links(spark, sf)
    cone = graph.reachable(links, roots(spark).where("root = 'n3'"))
    return graph.dependencies(links, cone).select("src", "dst", F.array_join("instances", ",").alias("instances"), F.size("instances").cast("bigint").alias("n"))


@query(f"WITH {i.LINKS} SELECT 0 AS part, 'digraph modules {{' AS line UNION ALL SELECT 2, '}}' UNION ALL SELECT 1, line FROM (SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || array_to_string(list_sort(list(instance)), '\\n') || '\"];' AS line FROM lk GROUP BY src, dst)")
def graph_dot(spark, sf):
    return graph.dot(graph.dependencies(i.links(spark, sf)))


#: A syntax tree with nested cells, a target by address, an unresolved cell and a duplicate module.
TREE = json.dumps({"modulesp": [
    {"type": "MODULE", "name": "Top", "addr": "(A)", "stmtsp": [{"type": "BEGIN", "stmtsp": [{"type": "CELL", "name": "left", "modp": "(B)"}, {"type": "CELL", "name": "right", "moduleName": "Worker"}]}, {"type": "CELL", "name": "store", "moduleName": "mem_16x8"}]},
    {"type": "MODULE", "name": "Worker", "addr": "(B)", "stmtsp": [{"type": "CELL", "name": "leaf", "modp": "(C)"}, {"type": "CELL", "name": "lost", "modp": "(Z)"}]},
    {"type": "MODULE", "name": "Leaf", "addr": "(C)"}, {"type": "MODULE", "name": "Leaf", "addr": "(D)"}, {"type": "PACKAGE", "name": "P"},
]})


@query("SELECT 'a' AS path, * FROM (VALUES ('Top', 'left', 'Worker'), ('Top', 'right', 'Worker'), ('Top', 'store', 'mem_16x8'), ('Worker', 'leaf', 'Leaf'), ('Worker', 'lost', NULL)) v(src, instance, dst)")
def graph_syntax_tree(spark, sf):
    return graph.edges(graph.parse_ast(spark.createDataFrame([("a", TREE)], "path string, text string")))


@query("SELECT * FROM (VALUES ('a', 'duplicate_module', 'Leaf'), ('a', 'unresolved_cell', 'Worker.lost'), ('b', 'no_modules', NULL), ('b', 'missing_top', 'Top'), ('c', 'no_modules', NULL), ('c', 'missing_top', 'Top')) v(path, rule, detail)")
def graph_problems(spark, sf):
    files = spark.createDataFrame([("a", TREE), ("b", "{}"), ("c", "not json")], "path string, text string")
    return graph.problems(files, graph.parse_ast(files), "Top")


TIMING = "| WNS(ns) TNS(ns) TNS Failing WHS(ns) |\n  -------  ------\n   {wns}   0.000   0   1024   {whs}  0\n"


def report_rows(spark, sf):
    """A report of each kind for each supplier, its figures from the supplier's key."""
    k = F.col("s_suppkey")
    figure = F.format_string("%d.%03d", F.floor(k / 4), (k * 37) % 1000)
    slack = F.concat(F.when(k % 3 == 0, "-").otherwise(""), figure)
    kinds = {
        "setup": F.concat(F.lit("Timing\nWNS(ns): "), slack, F.lit("\n")),
        "hold": F.concat(F.lit("x\n  WNS(ns)  TNS(ns)  n  m  WHS(ns)\n  -----\n  0.125 0.000 0 1024 "), slack, F.lit(" 0\n")),
        "utilization": F.concat(F.lit("| CLB LUTs | 10 | 0 | 100 | "), (k % 120).cast("string"), F.lit(".50 |\n| PS8 | 1 | 0 | 1 | 999.0 |\n| CLB  Registers | 5 | 0 | 7 | 200 | 2.50 |\n")),
        "drc": F.when(k % 4 == 0, F.lit("| AVAL-4 | Critical Warning | x |\n")).when(k % 4 == 1, F.lit("No DRC violations found\n")).when(k % 4 == 2, F.lit("| RPBF-3 | Warning | y |\n")).otherwise(F.lit("nothing\n")),
        "route": F.concat(F.lit("# of routable nets.......... : "), (100 + k % 3).cast("string"), F.lit(" :\n# of fully routed nets.......... : 100 :\n# of nets with routing errors.......... : 0 :\n")),
        "floorplan": F.concat(F.lit("Pblock Count: 0\nPlaced Cell Count : "), (k % 2 * 12345).cast("string"), F.lit("\n")),
    }
    base = i.table(spark, sf, "supplier").select("s_suppkey", *[v.alias(n) for n, v in kinds.items()])
    long = base.unpivot(["s_suppkey"], list(kinds), "kind", "text")
    return long.select(F.concat_ws("/", "kind", F.col("s_suppkey").cast("string")).alias("path"), "kind", "text")


SLACK = "(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END) * (s_suppkey // 4 + (s_suppkey * 37 % 1000) / 1000.0)"


@query(f"SELECT 'setup/' || s_suppkey AS path, round(CAST({SLACK} AS DOUBLE), 6) AS wns, NULL::DOUBLE AS whs FROM supplier UNION ALL SELECT 'hold/' || s_suppkey, 0.125, round(CAST({SLACK} AS DOUBLE), 6) FROM supplier")
def report_timing(spark, sf):
    found = reports.timing(report_rows(spark, sf).where("kind IN ('setup', 'hold')").select("path", "text"))
    return found.select("path", F.round("wns", 6).alias("wns"), F.round("whs", 6).alias("whs"))


@query("SELECT 'utilization/' || s_suppkey AS path, CAST(v.line_no AS INT) AS line_no, name, used::BIGINT AS used, 0::BIGINT AS fixed, p::BIGINT AS prohibited, available::BIGINT AS available, CAST(CASE WHEN v.line_no = 0 THEN s_suppkey % 120 + 0.5 ELSE percent END AS DOUBLE) AS percent FROM supplier, (VALUES (0, 'CLB LUTs', 10, 0, 100, 0), (1, 'PS8', 1, 0, 1, 999.0), (2, 'CLB Registers', 5, 7, 200, 2.5)) v(line_no, name, used, p, available, percent)")
def report_utilization(spark, sf):
    return reports.utilization(reports.lines(report_rows(spark, sf).where("kind = 'utilization'").select("path", "text")))


@query("SELECT 'drc/' || s_suppkey AS path, 0 AS line_no, CASE WHEN s_suppkey % 4 = 0 THEN 'AVAL-4' ELSE 'RPBF-3' END AS rule, CASE WHEN s_suppkey % 4 = 0 THEN 'critical warning' ELSE 'warning' END AS severity, CASE WHEN s_suppkey % 4 = 0 THEN '| AVAL-4 | Critical Warning | x |' ELSE '| RPBF-3 | Warning | y |' END AS message FROM supplier WHERE s_suppkey % 2 = 0")
def report_drc(spark, sf):
    return reports.drc(reports.lines(report_rows(spark, sf).where("kind = 'drc'").select("path", "text")))


@query("SELECT 'route/' || s_suppkey AS path, CAST(s_suppkey % 3 AS BIGINT) AS unrouted, 0::BIGINT AS errors FROM supplier")
def report_route(spark, sf):
    return reports.route(reports.lines(report_rows(spark, sf).where("kind = 'route'").select("path", "text")))


GATES = f"""gt AS (SELECT 'setup/' || s_suppkey AS path, 'wns' AS rule, {SLACK} >= 0 AS passed FROM supplier UNION ALL SELECT 'hold/' || s_suppkey, 'wns', true FROM supplier UNION ALL SELECT 'hold/' || s_suppkey, 'whs', {SLACK} >= 0 FROM supplier
  UNION ALL SELECT 'utilization/' || s_suppkey, 'utilization', s_suppkey % 120 + 0.5 <= 100 FROM supplier UNION ALL SELECT 'drc/' || s_suppkey, 'drc', s_suppkey % 4 IN (1, 2) FROM supplier
  UNION ALL SELECT 'route/' || s_suppkey, 'route', s_suppkey % 3 = 0 FROM supplier UNION ALL SELECT 'floorplan/' || s_suppkey, 'floorplan', s_suppkey % 2 = 1 FROM supplier)"""


@query(f"WITH {GATES} SELECT * FROM gt")
def report_gates(spark, sf):
    return reports.gates(report_rows(spark, sf))


@query(f"WITH {GATES} SELECT CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_failed, bool_and(passed) AS complete FROM gt")
def report_verdict(spark, sf):
    return reports.verdict(reports.gates(report_rows(spark, sf)))


@query(f"WITH {GATES}, sm AS (SELECT rule, count(*) AS n, count(*) FILTER (passed) AS p FROM gt GROUP BY 1) SELECT nd.rule, CASE WHEN n IS NULL THEN 'missing' WHEN p = n THEN 'ok' ELSE 'failed' END AS status FROM (VALUES ('wns'), ('drc'), ('power')) nd(rule) LEFT JOIN sm USING (rule)")
def required_rules(spark, sf):
    need = spark.createDataFrame([("wns",), ("drc",), ("power",)], "rule string")
    return reports.required(reports.gates(report_rows(spark, sf)).select("rule", "passed"), need, "rule")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_partkey * 10 <= b.p_partkey * 10 + b.p_size AND b.p_partkey * 10 <= a.p_partkey * 10 + a.p_size")
def range_overlaps(spark, sf):
    r = i.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10).alias("base"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("high"))
    return reports.overlaps(r, step=64)


NEEDED = [("encoder", "s_axi_control"), ("dma", "s_axi_lite"), ("intc", "s_axi"), ("uart", "s_axi")]


def _map(spark, sf):
    """An address map for each supplier, its entries from the supplier's key: overlapping, inverted, repeated, missing and too wide ones among them."""
    k = F.col("s_suppkey")
    hex_ = lambda v: F.concat(F.lit("0x"), F.regexp_replace(F.lpad(F.hex(v), 9, "0"), "(.{4})$", "_$1"))
    entry = lambda name, base, size: F.concat(F.lit(name + " base "), hex_(base), F.lit(" high "), hex_(base + size), F.lit("\n"))
    text = F.concat(
        entry("Slave /encoder/s_axi_control", k * 65536, F.lit(65535)),
        F.when(k % 4 != 0, entry("DMA\\S_AXI_LITE", k * 65536 + F.when(k % 3 == 0, 32768).otherwise(65536), F.when(k % 5 == 0, -1).otherwise(1 << 30))).otherwise("nothing 0x1\n"),
        entry("/intc/s_axi", k * 65536 + (1 << 33), F.lit(255)),
        F.when(k % 6 == 0, entry("/intc/s_axi", k * 65536 + (1 << 33), F.lit(511))).otherwise(""),
        F.when(k % 7 == 0, "uart s_axi 0xFFFF_FFFF_FFFF_FFFF 0x1_0000_0000_0000_0000\n").when(k % 7 == 1, "uart s_axi 0x1_0000_0000_0000_0000\n").otherwise(""),
    )
    need = spark.createDataFrame(NEEDED, "component string, interface string")
    return reports.address_map(reports.lines(i.table(spark, sf, "supplier").select(F.concat(F.lit("m"), k).alias("path"), text.alias("text"))), need), need


MAP = """k AS (SELECT s_suppkey AS k FROM supplier), mp AS (SELECT k, 0 AS line_no, 'encoder/s_axi_control' AS interface, (k * 65536)::HUGEINT AS base, (k * 65536 + 65535)::HUGEINT AS high FROM k
  UNION ALL SELECT k, 1, 'dma/s_axi_lite', b, b + CASE WHEN k % 5 = 0 THEN -1 ELSE 1073741824 END FROM (SELECT k, k * 65536 + CASE WHEN k % 3 = 0 THEN 32768 ELSE 65536 END AS b FROM k) WHERE k % 4 <> 0
  UNION ALL SELECT k, 2, 'intc/s_axi', k * 65536 + 8589934592, k * 65536 + 8589934847 FROM k UNION ALL SELECT k, 3, 'intc/s_axi', k * 65536 + 8589934592, k * 65536 + 8589935103 FROM k WHERE k % 6 = 0
  UNION ALL SELECT k, CASE WHEN k % 6 = 0 THEN 4 ELSE 3 END, 'uart/s_axi', CASE WHEN k % 7 = 0 THEN 18446744073709551615::HUGEINT END, NULL FROM k WHERE k % 7 < 2)"""


@query(f"WITH {MAP} SELECT 'm' || k AS path, CAST(line_no AS INT) AS line_no, interface, CAST(base AS VARCHAR) AS base, CAST(high AS VARCHAR) AS high FROM mp")
def address_map(spark, sf):
    return _map(spark, sf)[0].withColumns({c: F.col(c).cast("string") for c in ("base", "high")})


@query(f"""WITH {MAP}, d AS (SELECT DISTINCT k, interface, base, high FROM mp) SELECT 'm' || k AS path, interface, rule FROM (
  SELECT k, interface, 'missing' AS rule FROM k CROSS JOIN (VALUES ('encoder/s_axi_control'), ('dma/s_axi_lite'), ('intc/s_axi'), ('uart/s_axi')) n(interface) WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.k = k.k AND mp.interface = n.interface)
  UNION ALL SELECT k, interface, 'unreadable' FROM d WHERE base IS NULL UNION ALL SELECT k, interface, 'duplicate' FROM d GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT k, interface, 'inverted' FROM d WHERE high < base
  UNION ALL SELECT DISTINCT x.k, x.interface, 'overlap' FROM d x JOIN d y ON x.k = y.k AND x.interface <> y.interface AND x.base <= x.high AND y.base <= y.high AND x.base <= y.high AND y.base <= x.high)""")
def address_problems(spark, sf):
    entries, need = _map(spark, sf)
    return reports.address_problems(entries, need)


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug, CASE WHEN starts_with(l, 'of_') THEN 'number_' ELSE '' END || replace(replace(l, '-', '_'), '/', '_') AS label
  FROM (SELECT p_partkey, p_brand || p_type || 'XMLFile' || p_name AS n, regexp_replace(lower(trim(' ' || CASE WHEN p_partkey % 2 = 0 THEN 'of ' ELSE '' END || p_type || ' -/  ' || p_name || '-x ')), '\s+', '_', 'g') AS l FROM part)""")
def name_slugs(spark, sf):
    p = i.table(spark, sf, "part")
    text = F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "of ").otherwise(""), "p_type", F.lit(" -/  "), "p_name", F.lit("-x "))
    return p.select("p_partkey", words.slug(F.concat("p_brand", "p_type", F.lit("XMLFile"), "p_name")).alias("slug"), words.label(text).alias("label"))


@query("""SELECT l_orderkey, w AS status, CASE WHEN w & 3 = 0 THEN 'idle' WHEN w & 3 = 1 THEN 'busy' WHEN w & 3 = 2 THEN 'protocol_error' ELSE 'busy,protocol_error' END AS status_text, (w & 1) | (w & 2) | CASE WHEN l_tax > 0.04 THEN 4 ELSE 0 END | CASE WHEN l_discount > 0.05 THEN 8 ELSE 0 END AS control, '0x' || lpad(lower(to_hex((o & (4294967295 - m)) | (n & m))), 8, '0') AS merged, count(*) AS rows
  FROM (SELECT *, l_linenumber % 4 AS w, l_partkey * 65537 % 4294967296 AS o, l_orderkey * 40503 % 4294967296 AS n, (CASE WHEN l_suppkey & 1 > 0 THEN 255 ELSE 0 END + CASE WHEN l_suppkey & 2 > 0 THEN 65280 ELSE 0 END + CASE WHEN l_suppkey & 4 > 0 THEN 16711680 ELSE 0 END + CASE WHEN l_suppkey & 8 > 0 THEN 4278190080 ELSE 0 END) AS m FROM lineitem) GROUP BY ALL""")
def register_words(spark, sf):
    rows = i.table(spark, sf, "lineitem").withColumns({"w": (F.col("l_linenumber") % 4).cast("int"), "o": F.col("l_partkey") * 65537 % 4294967296, "n": F.col("l_orderkey") * 40503 % 4294967296})
    control = words.control_word(F.col("w").bitwiseAND(1) != 0, F.col("w").bitwiseAND(2) != 0, F.col("l_tax") > 0.04, F.col("l_discount") > 0.05)
    out = rows.select("l_orderkey", F.col("w").alias("status"), words.status_text(F.col("w")).alias("status_text"), control.alias("control"), words.hex32(words.merged(F.col("o"), F.col("n"), F.col("l_suppkey"))).alias("merged"))
    return out.groupBy(out.columns).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT l_orderkey, l_linenumber, w & 1 > 0 AS start, w & 2 > 0 AS clear, w & 4 > 0 AS subsample, w & 8 > 0 AS jfif, count(*) AS n FROM (SELECT *, l_partkey % 32 AS w FROM lineitem) GROUP BY ALL")
def control_flags(spark, sf):
    flags = words.control_flags(F.col("l_partkey") % 32)
    out = i.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in flags.items()])
    return out.groupBy(out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN k < 5 THEN v END AS clock_period_ns, CASE WHEN k IN (1, 2, 3, 4) THEN round(1000.0 / v, 9) END AS clock_frequency_mhz, k < 5 AS clock_period_finite, k IN (1, 2, 4, 5) AS clock_period_positive, k IN (1, 2, 3, 4) AS clock_frequency_finite, k IN (1, 2, 4) AS clock_frequency_positive, k IN (1, 2, 4) AS period_frequency_match, k IN (1, 2, 4) AS valid
  FROM (SELECT o_orderkey, o_orderkey % 7 AS k, CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 3 THEN -2.5 ELSE o_totalprice + 1 END::DOUBLE AS v FROM orders)""")
def clock_records(spark, sf):
    """Periods, also zero, negative, infinite and not a number, with their frequencies."""
    k = F.col("o_orderkey") % 7
    v = F.when(k == 0, 0.0).when(k == 1, 10.0).when(k == 3, -2.5).when(k == 5, float("inf")).when(k == 6, float("nan")).otherwise(F.col("o_totalprice") + 1)
    r = i.table(spark, sf, "orders").select("o_orderkey", words.clock_record(v).alias("r")).select("o_orderkey", "r.*")
    return r.withColumn("clock_frequency_mhz", F.round("clock_frequency_mhz", 9))


@query("SELECT user_id, bool_and(event_id % 4 = 0) AS all_idle, bool_or(event_id % 4 = 1) AS any_busy, bool_or(event_id % 8 = 2) AS any_protocol_error FROM events GROUP BY 1")
def status_roll_ups(spark, sf):
    k = F.col("event_id") % 4
    e = i.table(spark, sf, "events").select("user_id", F.when(k == 0, "idle").when(k == 1, "busy").otherwise("protocol_error").alias("text"), F.when(k != 3, k == 1).alias("busy"), (F.col("event_id") % 8 == 2).alias("protocol_error"))
    return evidence.status_roll_up(e, ["user_id"])


@query("SELECT field, CAST(count(v) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM (UNPIVOT (SELECT l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem) ON part, supplier, quantity INTO NAME field VALUE v) GROUP BY 1")
def record_sums(spark, sf):
    rows = i.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return evidence.sums_by_field(rows, ["part", "supplier", "quantity"])


@query(f"WITH {GATES}, s AS (SELECT CAST(split_part(path, '/', 2) AS BIGINT) AS supplier, split_part(path, '/', 1) || ':' || rule AS rule, passed FROM gt), g AS (SELECT * FROM (VALUES ('setup:wns', 'timing'), ('hold:wns', 'timing'), ('hold:whs', 'timing'), ('utilization:utilization', 'area'), ('floorplan:floorplan', 'area'), ('power:power', 'power')) v(rule, grp)), d AS (SELECT DISTINCT supplier FROM s) SELECT d.supplier, grp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(passed, false)) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT coalesce(passed, false)) AS BIGINT) AS n_failed, coalesce(string_agg(g.rule, ',' ORDER BY g.rule) FILTER (NOT coalesce(passed, false)), '') AS failed, bool_and(coalesce(passed, false)) AS complete FROM d CROSS JOIN g LEFT JOIN s ON s.supplier = d.supplier AND s.rule = g.rule GROUP BY 1, 2")
def named_checks(spark, sf):
    """Named checks in groups for each supplier; a named check without a row has failed."""
    rows = reports.gates(report_rows(spark, sf)).select(F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint").alias("supplier"), F.concat_ws(":", F.split_part("path", F.lit("/"), F.lit(1)), "rule").alias("rule"), "passed")
    groups = spark.createDataFrame([("setup:wns", "timing"), ("hold:wns", "timing"), ("hold:whs", "timing"), ("utilization:utilization", "area"), ("floorplan:floorplan", "area"), ("power:power", "power")], "rule string, grp string")
    return evidence.grouped_checks(rows, groups, ["supplier"]).withColumn("failed", F.array_join("failed", ","))


@query("""WITH h AS (SELECT s_suppkey AS host, s_suppkey % 2 = 0 AS win, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END AS mk, s_suppkey % 5 AS ve FROM supplier)
  SELECT host, rule, kind FROM (SELECT host, 'no_make' AS rule, 'problem' AS kind FROM h WHERE mk IS NULL UNION ALL SELECT host, 'no_verilator', 'problem' FROM h WHERE ve = 0 UNION ALL SELECT host, 'unix_make_on_windows', 'problem' FROM h WHERE win AND mk = 1
  UNION ALL SELECT host, 'unix_verilator_on_windows', 'warning' FROM h WHERE win AND ve = 1 UNION ALL SELECT host, 'cmd_shell_override', 'warning' FROM h WHERE win AND mk = 1 AND host % 7 = 0)""")
def toolchain_rules(spark, sf):
    k = F.col("s_suppkey")
    make = F.when(k % 3 == 1, "C:\\msys64\\usr\\bin\\make.exe").when(k % 3 == 2, "/opt/make")
    verilator = F.when(k % 5 == 1, "c:/msys64/mingw64/bin/verilator.exe").when(k % 5 != 0, "/opt/verilator")
    rows = i.table(spark, sf, "supplier").select(k.alias("host"), F.when(k % 2 == 0, "nt").otherwise("posix").alias("os"), make.alias("make"), F.lit("C:/msys64/usr/bin/sh.exe").alias("sh"), verilator.alias("verilator"), F.when(k % 7 == 0, "C:\\Windows\\cmd.exe").alias("shell"), F.lit(None).cast("string").alias("makeshell"))
    return evidence.toolchain(rows)


@query("""SELECT CAST(k AS INT) AS code, CASE WHEN k BETWEEN 208 AND 215 THEN 'RST' || (k - 208) WHEN k BETWEEN 224 AND 239 THEN 'APP' || (k - 224) WHEN k = 216 THEN 'SOI' WHEN k = 217 THEN 'EOI' WHEN k = 219 THEN 'DQT' WHEN k = 221 THEN 'DRI' WHEN k = 192 THEN 'SOF0' WHEN k = 196 THEN 'DHT' WHEN k = 218 THEN 'SOS' ELSE '0xFF' || lpad(upper(to_hex(k)), 2, '0') END AS name FROM range(256) t(k)""")
def marker_names(spark, sf):
    return spark.range(256).select(F.col("id").cast("int").alias("code"), words.marker_name(F.col("id").cast("int")).alias("name"))


@query("SELECT o_orderkey, abs(a - b) <= greatest(1e-12 * greatest(abs(a), abs(b)), 1e-9) AS near FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5e-10 ELSE 1e-3 END AS b FROM orders)")
def close_numbers(spark, sf):
    k = F.col("o_orderkey") % 3
    b = F.col("o_totalprice") + F.when(k == 0, 0.0).when(k == 1, 5e-10).otherwise(1e-3)
    return i.table(spark, sf, "orders").select("o_orderkey", words.near(F.col("o_totalprice"), b).alias("near"))


@query("SELECT doc_id, sha256(left(text, 4096)) AS sha256, length(text) > 4096 AS cut FROM documents")
def truncated_texts(spark, sf):
    short, cut = words.truncated(F.col("text"))
    return i.table(spark, sf, "documents").select("doc_id", F.sha2(short, 256).alias("sha256"), cut.alias("cut"))


@query("SELECT p.path, url IS NOT NULL AS exists, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS sha256 FROM (SELECT 'page' || k AS path, k FROM (SELECT DISTINCT page_id + d AS k FROM pages, (VALUES (0), (3)) v(d))) p LEFT JOIN (SELECT min(url) AS url, min(html) AS html, page_id FROM pages GROUP BY 3) g ON g.page_id = p.k")
def file_records(spark, sf):
    found = i.table(spark, sf, "pages").select(F.concat(F.lit("page"), "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    wanted = i.table(spark, sf, "pages").select(F.explode(F.array("page_id", F.col("page_id") + 3)).alias("id"))  # the last three are absent
    return evidence.file_records(found, wanted.select(F.concat(F.lit("page"), "id").alias("path")))


@query("""SELECT event_id, kind, is_true FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'int' WHEN 2 THEN 'missing' WHEN 3 THEN 'null' WHEN 4 THEN 'string' WHEN 5 THEN 'array' ELSE 'number' END AS kind, event_id % 7 = 0 AS is_true FROM events)""")
def strict_kinds(spark, sf):
    """What a field of a JSON record is; only true counts as true."""
    k = F.col("event_id") % 7
    text = F.when(k == 0, '{"ok": true}').when(k == 1, '{"ok": 1}').when(k == 2, '{"no": 1}').when(k == 3, '{"ok": null}').when(k == 4, '{"ok": "true"}').when(k == 5, '{"ok": [true]}').otherwise('{"ok": 1.5}')
    rows = evidence.strict(i.table(spark, sf, "events").select(F.col("event_id").alias("path"), text.alias("text")))
    return rows.select(F.col("path").alias("event_id"), evidence.kind(F.col("v"), "$.ok").alias("kind"), F.coalesce(evidence.is_true(F.col("v"), "$.ok"), F.lit(False)).alias("is_true"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not JSON' WHEN 2 THEN 'root is not an object' WHEN 3 THEN 'not a finite number' WHEN 4 THEN NULL ELSE 'not a finite number' END AS error FROM events""")
def strict_errors(spark, sf):
    """Texts that are JSON objects, some with words in strings that would be refused as numbers, and texts that are not."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"x": {"y": [1, 2.5, "NaN"]}, "n": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit("{x"), n)).when(k == 2, F.concat(F.lit("["), n, F.lit("]")))
    text = text.when(k == 3, F.concat(F.lit('{"x": NaN, "n": '), n, F.lit("}"))).when(k == 4, F.concat(F.lit('{"a": "is NaN here: \\" -Infinity, ", "n": '), n, F.lit("}"))).otherwise(F.concat(F.lit('{"n": '), n, F.lit(', "x": [-Infinity]}')))
    return evidence.strict(i.table(spark, sf, "events").select(F.col("event_id").alias("path"), text.alias("text"))).select(F.col("path").alias("event_id"), "error")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY seen), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) GROUP BY 1")
def first_seen_values(spark, sf):
    out = evidence.first_seen(i.table(spark, sf, "events"), ["user_id"], "event_type", "event_id")
    return out.select("user_id", F.array_join("values", ",").alias("types"))


@query(f"WITH {GATES} SELECT rule AS grp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_failed, coalesce(string_agg(path, ',' ORDER BY path) FILTER (NOT passed), '') AS failed, bool_and(passed) AS complete FROM gt GROUP BY 1")
def check_summaries(spark, sf):
    rows = reports.gates(report_rows(spark, sf)).select(F.col("rule").alias("grp"), F.col("path").alias("rule"), "passed")
    return evidence.summary(rows, ["grp"]).withColumn("failed", F.array_join("failed", ","))


@query("SELECT o_custkey, field, saved, recomputed FROM (SELECT o_custkey, 'n' AS field, CAST(n + 1 AS VARCHAR) AS saved, CAST(n AS VARCHAR) AS recomputed FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE o_custkey % 10 = 0)")
def record_differences(spark, sf):
    now = i.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    saved = now.withColumn("n", F.col("n") + (F.col("o_custkey") % 10 == 0).cast("int"))
    return evidence.differing(saved, now, "o_custkey")


@query("SELECT l_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_values, count(DISTINCT l_suppkey) <= 1 AS consistent FROM lineitem GROUP BY 1")
def consistent_values(spark, sf):
    return evidence.consistent(i.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT n_nationkey, total, a + b AS sum_of_parts FROM (SELECT n_nationkey, c.n + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS total, c.p AS a, c.n - c.p AS b FROM nation JOIN (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS p FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey) WHERE total <> a + b")
def roll_up_mismatches(spark, sf):
    c = i.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("a"))
    rows = c.select("n_nationkey", (F.col("n") + (F.col("n_nationkey") % 5 == 0).cast("int")).alias("total"), "a", (F.col("n") - F.col("a")).alias("b"))
    return evidence.rolled_up(rows, "n_nationkey", "total", ["a", "b"])


@query("""SELECT 'p' || k AS path, CASE WHEN k % 4 = 0 THEN 2 END AS width, CASE WHEN k % 4 = 0 THEN 1 END AS height, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'magic is not P6' WHEN 2 THEN 'payload is truncated' ELSE 'maximum value is not 255' END AS error FROM (SELECT l_linenumber * 1000 + l_orderkey % 50 AS k FROM lineitem GROUP BY 1)""")
def ppm_files(spark, sf):
    k = F.col("k") % 4
    head = F.when(k == 1, "P5 2 1 255\n").when(k == 3, "P6\n2 1\n15\n").otherwise("P6 # a comment\n2 1 # another\n255\n")
    body = F.when(k == 2, "abc").otherwise("abcdef")
    keys = i.table(spark, sf, "lineitem").select((F.col("l_linenumber") * 1000 + F.col("l_orderkey") % 50).alias("k")).distinct()
    found = images.ppm(keys.select(F.concat(F.lit("p"), "k").alias("path"), F.concat(head, body).cast("binary").alias("content")))
    return found.select("path", "width", "height", "error")


@query("SELECT o_orderkey, array_to_string(CASE WHEN list_bool_or([contains(x, '{jpeg}') for x in a]) THEN [replace(x, '{jpeg}', f) for x in a] ELSE list_append(a, f) END, ' ') AS argv FROM (SELECT o_orderkey, o_orderkey || '.jpg' AS f, CASE WHEN o_orderkey % 2 = 0 THEN ['decode', '--in={jpeg}', o_orderpriority] ELSE ['decode', o_orderpriority] END AS a FROM orders)")
def decoder_arguments(spark, sf):
    plain = F.array(F.lit("decode"), F.col("o_orderpriority"))
    asked = F.array(F.lit("decode"), F.lit("--in={jpeg}"), F.col("o_orderpriority"))
    argv = F.when(F.col("o_orderkey") % 2 == 0, asked).otherwise(plain)
    return i.table(spark, sf, "orders").select("o_orderkey", F.array_join(words.expanded(argv, F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg"))), " ").alias("argv"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) * 3 - 20 BETWEEN 1 AND 100 AS quality_ok, l_partkey * 400 BETWEEN 0 AND 65535 AS interval_ok, l_suppkey IS NOT DISTINCT FROM nullif(l_linenumber, 1) AND l_tax IS NOT DISTINCT FROM l_discount AS same, count(*) AS n FROM lineitem GROUP BY ALL""")
def setting_domains(spark, sf):
    li = i.table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    same = words.same_settings([F.col("l_suppkey"), F.col("l_tax")], [F.nullif(F.col("l_linenumber").cast("bigint"), F.lit(1).cast("bigint")), F.col("l_discount")])
    out = li.select("l_orderkey", "l_linenumber", q.alias("q"), words.in_domain("quality", q * 3 - 20).alias("quality_ok"), words.in_domain("restart_interval", F.col("l_partkey") * 400).alias("interval_ok"), same.alias("same"))
    return out.groupBy(out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS subset_ok, o_orderkey % 3 = 1 AS positions_ok FROM orders")
def record_matches(spark, sf):
    o = i.table(spark, sf, "orders")
    actual = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"), F.lit("more"), F.lit("x"))
    wanted = F.create_map(F.lit("priority"), F.lit("1-URGENT"), F.lit("status"), F.lit("F"))
    k = F.col("o_orderkey") % 3
    listed = F.when(k == 0, F.array(F.lit(1))).when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1)))
    return o.select("o_orderkey", evidence.subset_matches(wanted, actual).alias("subset_ok"), evidence.same_positions(F.array(F.lit(1), F.lit(2)), listed).alias("positions_ok"))


@query("SELECT field, array_to_string(list(value ORDER BY seen), ',') AS found FROM (SELECT field, value, min(o_orderkey) AS seen FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders) ON status, priority INTO NAME field VALUE value) GROUP BY 1, 2) GROUP BY 1")
def distinct_by_field(spark, sf):
    o = i.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return evidence.distinct_by_field(o, ["status", "priority"], "o_orderkey").select("field", F.array_join("values", ",").alias("found"))


@query(f"""WITH {GATES}, s AS (SELECT path, count(*) AS n, count(*) FILTER (passed) AS p, coalesce(string_agg('"' || rule || '"', ',' ORDER BY rule) FILTER (NOT passed), '') AS f FROM gt GROUP BY 1)
  SELECT path, '{{{{"checks":{{{{"complete":' || (n = p) || ',"failed":[' || f || '],"n":' || n || ',"n_failed":' || (n - p) || ',"n_passed":' || p || '}}}},"facts":{{{{"kind":"' || split_part(path, '/', 1) || '"}}}},"path":"' || path || '","schema_version":1}}}}' AS record FROM s""".replace("{{", "{").replace("}}", "}"))
def evidence_records(spark, sf):
    rows = report_rows(spark, sf)
    return evidence.run_records(rows.select("path", "kind"), reports.gates(rows))


@query(f"WITH {GATES}, s AS (SELECT path, bool_and(passed) AS ok FROM gt GROUP BY 1) SELECT path, CASE WHEN NOT ok THEN 'not complete' ELSE 'summary differs' END AS problem FROM s WHERE NOT ok OR ends_with(path, '/7')")
def evidence_recheck(spark, sf):
    """Saved records against recomputed checks; the records of one supplier were tampered with."""
    rows = report_rows(spark, sf)
    checks = reports.gates(rows)
    saved = evidence.run_records(rows.select("path", "kind"), checks)
    odd = F.regexp_replace("record", '"n_passed":[0-9]+', '"n_passed":99')
    return evidence.rechecked(saved.withColumn("record", F.when(F.col("path").endswith("/7"), odd).otherwise(F.col("record"))), checks)
