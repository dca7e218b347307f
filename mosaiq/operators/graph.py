"""Module-graph queries: reachability, hierarchy, grouped dependencies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import materialize

CELLS = pa.schema([("path", pa.string()), ("module", pa.string()), ("address", pa.string()), ("instance", pa.string()), ("target", pa.string()), ("target_address", pa.string())])


def _cells(value) -> Iterator[dict]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if v.get("type") == "CELL":
                yield v
            stack += v.values()
        elif isinstance(v, list):
            stack += v


def parse_ast(files: DataFrame) -> DataFrame:
    """(path, text) of JSON syntax trees to cells at any depth; a module without cells has one row without instance."""

    def text(v) -> str | None:
        return v if isinstance(v, str) and v else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(raw or "")
                except ValueError:
                    continue
                modules = tree.get("modulesp") if isinstance(tree, dict) else None
                for m in modules if isinstance(modules, list) else []:
                    if isinstance(m, dict) and m.get("type") == "MODULE":
                        own = {"path": path, "module": text(m.get("name")), "address": text(m.get("addr"))}
                        cells = list(_cells(m.get("stmtsp", [])))
                        rows += [own | {"instance": text(c.get("name")), "target": text(c.get("moduleName")), "target_address": text(c.get("modp"))} for c in cells] or [own]
            yield pa.RecordBatch.from_pylist(rows, schema=CELLS)

    return files.select("path", "text").mapInArrow(run, "path string, module string, address string, instance string, target string, target_address string")


def edges(cells: DataFrame) -> DataFrame:
    """(path, src, instance, dst): targets by name, else by address; null where unresolved."""
    names = cells.where("address IS NOT NULL").select("path", F.col("address").alias("target_address"), F.col("module").alias("by_address")).distinct()
    placed = cells.where("instance IS NOT NULL OR target IS NOT NULL OR target_address IS NOT NULL").join(names, ["path", "target_address"], "left")
    return placed.select("path", F.col("module").alias("src"), "instance", F.coalesce("target", "by_address").alias("dst")).distinct()


def problems(files: DataFrame, cells: DataFrame, top: str) -> DataFrame:
    """(path, rule, detail): no modules, unnamed modules, duplicate modules, unresolved cells, a missing top."""
    row = lambda df, rule, detail: df.select("path", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    modules = cells.select("path", "module", "address").distinct()
    twice = modules.groupBy("path", "module").count().where("count > 1")
    missing = files.select("path").join(modules.where(F.col("module") == top), "path", "left_anti")
    return (
        row(files.join(modules, "path", "left_anti"), "no_modules", F.lit(None))
        .unionByName(row(modules.where("module IS NULL"), "unnamed_module", F.col("address")))
        .unionByName(row(twice, "duplicate_module", F.col("module")))
        .unionByName(row(edges(cells).where("dst IS NULL OR instance IS NULL"), "unresolved_cell", F.concat_ws(".", "src", "instance")))
        .unionByName(row(missing, "missing_top", F.lit(top)))
    )


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) closure of (src, dst) from (root): a frontier that only ever meets new nodes, so cycles end it."""
    step = links.select("src", "dst").distinct()
    seen = frontier = materialize(roots.select("root", F.col("root").alias("node")).distinct(), "reach")
    while not frontier.isEmpty():
        found = frontier.join(step, frontier.node == step.src).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(found.join(seen, ["root", "node"], "left_anti"), "reach")
        seen = seen.unionByName(frontier)
    return seen


def hierarchy(spark: SparkSession, links: DataFrame, top: str, max_depth: int = 64, max_instances: int | None = 10_000) -> DataFrame:
    """The instance tree below ``top``: (depth, module, instance, path, recursive), parents before children.

    A module that is its own ancestor is listed once more, marked, and not entered.
    More than ``max_instances`` nodes are an error.
    """
    step = links.select("src", "instance", "dst").distinct()
    level = spark.range(1).select(F.lit(0).alias("depth"), F.lit(top).alias("module"), F.lit(top).alias("instance"), F.array(F.lit(top)).alias("steps"), F.array().cast("array<string>").alias("above"), F.lit(False).alias("recursive"))
    out, n = level, 1
    for _ in range(max_depth):
        inner = level.where("NOT recursive").join(step, F.col("module") == step.src)
        above = F.concat("above", F.array("module"))
        level = materialize(inner.select((F.col("depth") + 1).alias("depth"), F.col("dst").alias("module"), step.instance, F.concat("steps", F.array(step.instance)).alias("steps"), above.alias("above"), F.array_contains(above, F.col("dst")).alias("recursive")), "hierarchy")
        k = level.count()
        n += k
        if max_instances is not None and n > max_instances:
            raise ValueError(f"the hierarchy has more than {max_instances} instances")
        if not k:
            break
        out = out.unionByName(level)
    return out.orderBy("steps").select("depth", "module", "instance", F.array_join("steps", ".").alias("path"), "recursive")


def dependencies(links: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(src, dst, instances): parallel instances as one sorted list; with ``selected`` (node), both ends in it."""
    rows = links.where("dst IS NOT NULL")
    if selected is not None:
        nodes = selected.select("node").distinct()
        rows = rows.join(nodes, rows.src == nodes.node, "left_semi")
        rows = rows.join(nodes, rows.dst == nodes.node, "left_semi")
    return rows.groupBy("src", "dst").agg(F.array_sort(F.collect_list("instance")).alias("instances"))


def node_kind(name):
    return F.when(name.startswith("mem_"), "memory").otherwise("module")


def escaped(text):
    """HTML entities, then JSON-style quotes, for graph labels."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def counts(reached: DataFrame, tree: DataFrame, links: DataFrame) -> DataFrame:
    """One row: modules with instances of their own, modules reached, and instances of the hierarchy."""
    return links.agg(F.count_distinct("src").alias("definitions")).crossJoin(reached.agg(F.count_distinct("node").alias("reachable"))).crossJoin(tree.agg(F.count(F.lit(1)).alias("instances")))  # three single rows


def focus_cones(links: DataFrame, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cones (root, node) of the (root)s that the graph knows, and the roots it does not."""
    known = links.select(F.col("src").alias("root")).unionByName(links.where("dst IS NOT NULL").select(F.col("dst").alias("root"))).distinct()
    return reachable(links, focus.join(known, "root", "left_semi")), focus.select("root").distinct().join(known, "root", "left_anti")


def hierarchy_lines(tree: DataFrame, form: str = "mermaid") -> DataFrame:
    """(steps, line): an instance tree as the lines of a Mermaid or DOT text, parents before children; a node is named by its path."""
    name = F.concat(F.lit("n_"), F.substring(F.sha2("path", 256), 1, 16))
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    above = F.when(parent != "", F.concat(F.lit("n_"), F.substring(F.sha2(parent, 256), 1, 16)))
    said = F.concat(escaped(F.col("instance")), F.when(F.col("instance") != F.col("module"), F.concat(F.lit(": "), escaped(F.col("module")))).otherwise(""), F.when(F.col("recursive"), " (recursive)").otherwise(""))
    if form == "dot":
        line = F.concat(F.lit("  "), name, F.lit(' [label="'), said, F.lit('"];'), F.when(above.isNotNull(), F.concat(F.lit(" "), above, F.lit(" -> "), name, F.lit(";"))).otherwise(""))
    else:
        line = F.concat(F.lit("  "), F.when(above.isNotNull(), F.concat(above, F.lit(" --> "))).otherwise(""), name, F.lit('["'), said, F.lit('"]'))
    return tree.select("path", line.alias("line"))


def manifest(artifacts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(name, title, content) to the manifest's rows: size, hash and index line of each file; with the (name)s of a previous manifest also those that it owned and that are gone, to be deleted."""
    own = artifacts.select("name", F.lit("write").alias("action"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.concat(F.lit("- ["), "title", F.lit("]("), "name", F.lit(")")).alias("index_line"))
    if previous is None:
        return own
    safe = previous.where(~F.col("name").rlike(r"[/\\\\]") & ~F.col("name").isin("", ".", ".."))  # only names within the folder
    gone = safe.select("name").distinct().join(artifacts, "name", "left_anti")
    return own.unionByName(gone.select("name", F.lit("delete").alias("action"), F.lit(None).cast("bigint").alias("n_bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("index_line")))


def dot(deps: DataFrame) -> DataFrame:
    """(part, line): the dependency graph as the lines of a DOT text, in order of part and line."""
    quoted = lambda c: F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"'))
    line = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(' [label="'), F.array_join(F.transform("instances", escaped), "\\n"), F.lit('"];'))
    edge = F.array(F.lit("digraph modules {"), F.lit("}"))
    ends = deps.sparkSession.range(1).select(F.posexplode(edge).alias("part", "line")).select((F.col("part") * 2).alias("part"), "line")
    return ends.unionByName(deps.select(F.lit(1).alias("part"), line.alias("line")))
