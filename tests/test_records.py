import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import words
from mosaiq.operators import evidence, graph, reports


def links(spark, rows):
    return spark.createDataFrame([(a, f"{a}_{b}" if isinstance(b, str) else b[0], b if isinstance(b, str) else b[1]) for a, b in rows], "src string, instance string, dst string")


def test_reachability_ends_on_cycles(spark):
    df = links(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    out = graph.reachable(df, spark.createDataFrame([("a",), ("d",), ("x",)], "root string")).collect()
    assert sorted(map(tuple, out)) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "d"), ("x", "x")]


def test_hierarchy_marks_recursion_and_limits(spark):
    df = links(spark, [("Top", ("left", "Worker")), ("Top", ("right", "Worker")), ("Top", ("store", "mem_16x8")), ("Worker", ("leaf", "Leaf")), ("Leaf", ("up", "Top"))])
    out = graph.hierarchy(spark, df, "Top").collect()
    assert [(r.path, r.recursive) for r in out][:4] == [("Top", False), ("Top.left", False), ("Top.left.leaf", False), ("Top.left.leaf.up", True)]
    assert len(out) == 8
    assert max(r.depth for r in graph.hierarchy(spark, df, "Top", max_depth=1).collect()) == 1
    with pytest.raises(ValueError):
        graph.hierarchy(spark, df, "Top", max_instances=3)


def test_dependencies_and_dot(spark):
    df = links(spark, [("Top", ("right", "W<1>")), ("Top", ("left", "W<1>")), ("W<1>", ("m", "mem_x"))])
    out = {(r.src, r.dst): r.instances for r in graph.dependencies(df).collect()}
    assert out["Top", "W<1>"] == ["left", "right"]
    some = spark.createDataFrame([("Top",), ("W<1>",)], "node string")
    assert graph.dependencies(df, some).count() == 1
    lines = [r.line for r in graph.dot(graph.dependencies(df)).orderBy("part", "line").collect()]
    assert lines[0] == "digraph modules {" and lines[-1] == "}" and '  "Top" -> "W&lt;1&gt;" [label="left\\nright"];' in lines


def test_syntax_tree_at_any_depth(spark):
    deep = {"type": "CELL", "name": "x", "moduleName": "L"}
    for _ in range(200):
        deep = {"type": "BEGIN", "stmtsp": [deep]}
    tree = json.dumps({"modulesp": [{"type": "MODULE", "name": "T", "addr": "(1)", "stmtsp": [deep, {"type": "CELL", "name": "y", "modp": "(1)"}]}]})
    files = spark.createDataFrame([("p", tree)], "path string, text string")
    cells = graph.parse_ast(files)
    assert sorted(map(tuple, graph.edges(cells).select("src", "instance", "dst").collect())) == [("T", "x", "L"), ("T", "y", "T")]
    assert graph.problems(files, cells, "T").count() == 0


def report(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, kind string, text string")


def test_timing_forms(spark):
    table = "| Design Timing Summary\n    WNS(ns)      TNS(ns)  TNS Failing Endpoints  TNS Total Endpoints      WHS(ns)\n    -------\n      0.125        0.000                      0                 4096        0.050\n"
    df = spark.createDataFrame([("t", table), ("i", "WNS: -1.5\nWHS = 2"), ("n", "nothing")], "path string, text string")
    out = {r.path: (r.wns, r.whs) for r in reports.timing(df).collect()}
    assert out == {"t": (0.125, 0.05), "i": (-1.5, 2.0), "n": (None, None)}


def test_route_synonyms_and_last_value(spark):
    a = "# of routable nets.......... :       75115 :\n# of fully routed nets.......... :       75113 :\n# of nets with routing errors.......... :           0 :\n"
    b = "Number of unrouted nets = 4\nnumber of unrouted nets: 3\n"
    c = "# nets not completely routed : 7\n"
    df = spark.createDataFrame([("a", a), ("b", b), ("c", "Number of nets not completely routed: 7")], "path string, text string")
    out = {r.path: (r.unrouted, r.errors) for r in reports.route(reports.lines(df)).collect()}
    assert out == {"a": (2, 0), "b": (3, None), "c": (7, None)} and c


def test_gates_fail_without_rows(spark):
    kinds = ("setup", "hold", "utilization", "drc", "route", "floorplan")
    out = reports.gates(report(spark, *[(k, k, "nothing here") for k in kinds])).collect()
    assert len(out) == 7 and not any(r.passed for r in out)
    zero = report(spark, ("d", "drc", "Violations found: 0"), ("e", "drc", "ERROR: bad thing"))
    assert {r.path: r.passed for r in reports.gates(zero).collect()} == {"d": True, "e": False}


def test_overlaps_meet_once_across_blocks(spark):
    rows = [(1, 0, 1000), (2, 999, 5000), (3, 5001, 6000), (4, 200, 100), (5, 0, 9000), (6, 1000, 1000)]
    out = reports.overlaps(spark.createDataFrame(rows, "id int, base bigint, high bigint"), step=64).collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]}
    assert sorted(map(tuple, out)) == sorted(want)


def test_overlaps_of_wide_ranges(spark):
    rnd = random.Random(5)
    rows = [(0, 0, 2**64 - 1), (1, 2**63, 2**63), (2, 2**40 - 1, 2**41)] + [(k, b, b + rnd.choice((0, 5, 10**6, 2**40, 2**59))) for k in range(3, 60) for b in [rnd.randrange(2 ** rnd.randint(1, 63))]]
    df = spark.createDataFrame([(k, Decimal(b), Decimal(h)) for k, b, h in rows], "id int, base decimal(20,0), high decimal(20,0)")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    for step in (64, 65536):
        assert sorted(map(tuple, reports.overlaps(df, step=step).collect())) == sorted(want)


def test_overlaps_are_merged_and_look_where_ranges_are(spark):
    """Spark's own threshold would take the cells of a small table for broadcast; levels 1 and 3 to 17 hold nothing here."""
    base = F.col("id") * 10
    df = spark.range(3000).select("id", base.alias("base"), (base + F.when(F.col("id") % 500 == 7, 9000).otherwise(F.col("id") % 50)).alias("high"))
    found = reports.overlaps(df, step=64)
    rows = [(r.id, r.base, r.high) for r in df.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows[a[0] + 1 : a[0] + 1000] if b[1] <= a[2]}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_addresses(spark):
    df = spark.createDataFrame([("0xFFFF_FFFF_FFFF_FFFF",), ("0x0000_0000_0000_0000_0000_001f",), ("0x1_0000_0000_0000_0000",), ("0x0",)], "s string")
    assert [r[0] for r in df.select(reports.address(df.s)).collect()] == [2**64 - 1, 31, None, 0]


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None)], "rule string, passed boolean")
    need = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "rule string")
    assert {r.rule: r.status for r in reports.required(rows, need, "rule").collect()} == {"a": "failed", "b": "ok", "c": "failed", "d": "missing"}
    v = reports.verdict(rows).first()
    assert (v.n_passed, v.n_failed, v.complete) == (2, 2, False)
    assert reports.verdict(rows.where("rule = 'z'")).first().complete is False


def test_strict_json(spark):
    rows = [("a", '{"n": 1, "t": true, "f": 1.5, "s": "x", "l": [], "o": {}, "z": null}'), ("b", "[1]"), ("c", "{"), ("d", '{"n": NaN}'), ("e", None)]
    out = evidence.strict(spark.createDataFrame(rows, "path string, text string"))
    errors = {r.path: r.error for r in out.select("path", "error").collect()}
    assert errors["a"] is None and errors["b"] == "root is not an object" and errors["c"] and errors["d"] and errors["e"]
    v = out.where("path = 'a'").select(*[evidence.kind(out.v, f"$.{k}").alias(k) for k in "ntfslozx"]).first()
    assert tuple(v) == ("int", "true", "number", "string", "array", "object", "null", "missing")


def test_hash_predicate(spark):
    h = "0a" * 32
    df = spark.createDataFrame([(h,), (h.upper(),), (h[:-1],), (None,)], "h string")
    out = df.select(evidence.is_sha256(df.h), evidence.is_sha256(df.h, any_case=True)).collect()
    assert [tuple(r) for r in out] == [(True, True), (False, True), (False, False), (False, False)]


def test_differing_records(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("y", 2, None)], "k string, n int, s string")
    b = spark.createDataFrame([("x", 1, "q"), ("z", 2, None)], "k string, n int, s string")
    out = sorted((r.k, r.field) for r in evidence.differing(a, b, "k").collect())
    assert out == [("x", "s"), ("y", "n"), ("y", "s"), ("z", "n"), ("z", "s")]


def test_slugs_and_labels(spark):
    df = spark.createDataFrame([("JpegMcuStage",), ("AXIStreamCore2X",), ("--",), ("plain",)], "s string")
    assert [r[0] for r in df.select(words.slug(df.s)).collect()] == ["jpeg-mcu-stage", "axi-stream-core2-x", "graph", "plain"]
    df = spark.createDataFrame([("of nets",), ("Fully-Routed / nets",), (" nets - not/ routed\t",)], "s string")
    assert [r[0] for r in df.select(words.label(df.s)).collect()] == ["number_of_nets", "fully_routed___nets", "nets___not__routed"]
