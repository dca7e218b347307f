"""Evidence records: strict typing, first-seen distinct values, recomputed summaries, cross-file checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def strict(files: DataFrame) -> DataFrame:
    """(path, text) to (path, v, error): JSON objects only, without NaN or Infinity."""
    parsed = files.select("path", "text", F.try_parse_json("text").alias("v"))
    outside = F.regexp_replace("text", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')  # what stands in strings is not judged
    bad = outside.rlike(r"\b(?:NaN|Infinity)\b")
    kind = F.schema_of_variant("v")
    error = F.when(bad, "not a finite number").when(F.col("v").isNull(), "not JSON").when(~kind.startswith("OBJECT"), "root is not an object")
    return parsed.select("path", F.when(error.isNull(), F.col("v")).alias("v"), error.alias("error"))


def kind(v: Column, path: str) -> Column:
    """missing, null, true, false, int, number, string, array or object: what a field is, without conversion."""
    got = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    said = F.try_variant_get(v, path, "string")
    return (
        F.when(got.isNull(), "missing").when(got == "VOID", "null").when(got == "BOOLEAN", said).when(got == "BIGINT", "int")
        .when(got.startswith("DECIMAL") | got.isin("DOUBLE", "FLOAT"), "number").when(got == "STRING", "string").when(got.startswith("ARRAY"), "array").otherwise("object")
    )


def is_true(v: Column, path: str) -> Column:
    """Only JSON true counts."""
    return kind(v, path) == "true"


def is_sha256(text: Column, any_case: bool = False) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$" if any_case else "^[0-9a-f]{64}$"), F.lit(False))


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str, kinds: tuple[str, ...] | None = None, kind_of: str = "kind") -> DataFrame:
    """(keys, values): distinct values in the order in which they first appear; with ``kinds`` only those whose ``kind_of`` is one of them."""
    if kinds is not None:
        rows = rows.where(F.col(kind_of).isin(*kinds))
    once = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    listed = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("vs"))
    return listed.select(*keys, F.transform("vs", lambda s: s.v).alias("values"))


def summary(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(path, rule, passed) rows to counts, failed names and a verdict for each key."""
    ok = F.coalesce("passed", F.lit(False))
    return checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_passed"), F.count_if(~ok).alias("n_failed"), F.array_sort(F.collect_set(F.when(~ok, F.col("rule")))).alias("failed"), F.bool_and(ok).alias("complete"))


def status_roll_up(rows: DataFrame, keys: list[str], text: str = "text", busy: str = "busy", error: str = "protocol_error") -> DataFrame:
    """(keys, all_idle, any_busy, any_protocol_error); a missing flag is not set, a missing text is not idle."""
    set_ = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy(*keys).agg(F.bool_and(set_(F.col(text) == "idle")).alias("all_idle"), F.bool_or(set_(F.col(busy))).alias("any_busy"), F.bool_or(set_(F.col(error))).alias("any_protocol_error"))


def sums_by_field(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, total): how many records have each number, and their sum."""
    long = records.select(*[F.col(f).cast("bigint").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    return long.groupBy("field").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def grouped_checks(checks: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp) summaries of (rule, passed) rows by the groups (rule, grp) that rules belong to; a rule of a group without a row counts as failed."""
    need = checks.select(*keys).distinct().crossJoin(F.broadcast(groups))  # as many rows as there are named rules
    return summary(need.join(checks, [*keys, "rule"], "left"), [*keys, "grp"])


def toolchain(rows: DataFrame) -> DataFrame:
    """(host, os, make, sh, verilator, shell, makeshell) to (host, rule, kind): problems and warnings of a host's tools."""
    said = lambda c: F.lower(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("/")))
    tool = lambda c, name, folder: said(c).rlike(rf"/{folder}/{name}(?:\.exe)?$")
    windows = F.col("os") == "nt"
    unix_make, unix_sh = tool("make", "make", "usr/bin"), tool("sh", "sh", "usr/bin")
    unix_verilator = tool("verilator", "verilator", "(?:mingw64|mingw32|ucrt64|clang64|usr)/bin")
    cmd = said("shell").rlike(r"(?:^|/)cmd(?:\.exe)?$") | said("makeshell").rlike(r"(?:^|/)cmd(?:\.exe)?$")
    rules = {
        ("no_make", "problem"): F.col("make").isNull(),
        ("no_verilator", "problem"): F.col("verilator").isNull(),
        ("unix_make_on_windows", "problem"): windows & unix_make & unix_sh,
        ("unix_verilator_on_windows", "warning"): windows & unix_verilator,
        ("cmd_shell_override", "warning"): windows & unix_make & cmd,
    }
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("kind"), F.coalesce(c, F.lit(False)).alias("found")) for (r, k), c in rules.items()])
    return rows.select("host", F.explode(found).alias("r")).where("r.found").select("host", "r.rule", "r.kind")


def differing(saved: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """(key, field, saved, recomputed) where two records of a key differ in a field, or one is absent."""
    fields = [c for c in saved.columns if c != key]
    a = saved.select(F.col(key), *[F.col(c).cast("string").alias(f"a_{c}") for c in fields], F.lit(True).alias("in_a"))
    b = recomputed.select(F.col(key), *[F.col(c).cast("string").alias(f"b_{c}") for c in fields], F.lit(True).alias("in_b"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("saved"), F.col(f"b_{c}").alias("recomputed")) for c in fields])
    each = a.join(b, key, "full").select(key, F.explode(pairs).alias("p"), (F.col("in_a") & F.col("in_b")).alias("both"))
    return each.where(~F.col("p.saved").eqNullSafe(F.col("p.recomputed")) | F.col("both").isNull()).select(key, "p.*")


def rolled_up(rows: DataFrame, category: str, total: str, parts: list[str]) -> DataFrame:
    """(category) whose parts do not add up to their total."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return rows.where(F.col(total) != whole).select(category, total, whole.alias("sum_of_parts"))


def consistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values, consistent): at most one distinct value for a key."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).withColumn("consistent", F.col("n_values") <= 1)


def file_records(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, exists, n_bytes, sha256) of all wanted paths; ``found`` has (path, content)."""
    have = found.select("path", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    return wanted.select("path").distinct().join(have, "path", "left").select("path", F.col("n_bytes").isNotNull().alias("exists"), "n_bytes", "sha256")


def subset_matches(expected: Column, actual: Column) -> Column:
    """Whether every field of one string map stands in another with the same value."""
    return F.forall(F.map_entries(expected), lambda e: F.get(F.map_values(F.map_filter(actual, lambda k, v: k == e["key"])), F.lit(0)).eqNullSafe(e["value"]))


def same_positions(expected: Column, actual: Column) -> Column:
    """Whether two lists agree in length and at every position."""
    return (F.size(expected) == F.size(actual)) & F.forall(F.zip_with(expected, actual, lambda a, b: a.eqNullSafe(b)), lambda x: x)


def distinct_by_field(records: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(field, values): each field's distinct values over all records, in the order in which they are first seen."""
    long = records.select(order, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([order], fields, "field", "value")
    return first_seen(long, ["field"], "value", order)


def run_records(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """(path, record): one JSON record for each file, its facts and the summary of its checks, keys sorted."""
    s = summary(checks, ["path"])
    cols = sorted(c for c in facts.columns if c != "path")
    body = F.struct(F.struct("complete", "failed", "n", "n_failed", "n_passed").alias("checks"), F.struct(*cols).alias("facts"), F.col("path").alias("path"), F.lit(1).alias("schema_version"))
    return facts.join(s, "path").select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))


def rechecked(records: DataFrame, checks: DataFrame) -> DataFrame:
    """(path, problem) of saved records: not strict JSON, wrong version, or a summary that differs from the recomputed one."""
    now = summary(checks, ["path"]).select("path", F.col("n_passed").alias("now_passed"), F.col("n_failed").alias("now_failed"))
    v = strict(records.select("path", F.col("record").alias("text"))).join(now, "path", "left")
    number = lambda at: F.try_variant_get("v", at, "bigint")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((kind(F.col("v"), "$.schema_version") != "int") | ~F.coalesce(number("$.schema_version") == 1, F.lit(False)), "schema version")
        .when(~is_true(F.col("v"), "$.checks.complete"), "not complete")
        .when(~number("$.checks.n_passed").eqNullSafe(F.col("now_passed")) | ~number("$.checks.n_failed").eqNullSafe(F.col("now_failed")), "summary differs")
    )
    return v.select("path", problem.alias("problem")).where("problem IS NOT NULL")
