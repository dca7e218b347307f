"""URL filters with redirect equivalence.

Rules name a host and a path prefix and fit the host and its subdomains; the longest
fitting rule decides. URLs without a rule get the decision of their aliases: pages
are joined to the targets of the canonical links, refresh redirects and og:url in their
HTML, which are decoded and resolved against the page's own URL; connected components
over these edges carry a block to every alias, unless an alias is explicitly allowed.
URLs are compared without scheme and fragment, their dot segments resolved; no other
two are taken for the same unless a page declares it.

Rules are matched by joining the host's suffixes (as many as it has labels) to the
rules' hosts, once for each distinct host and path, so neither side is broadcast
unless Spark finds it small. Components pre-aggregate before each shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule, no alias by its own form, and is allowed unless its HTML links to a blocked
page; null HTML has no links; a null page_id is judged by its own rule alone;
repeated rows are aliases of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import components
from .store import materialize

# Fixed values of the contract: action, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"(?s)^.*?://(.*)$"
VALUES = ('"([^">]*)"', "'([^'>]*)'", r"""([^\s>"']+)""")  # of an attribute: in either quotes, or bare
ENTITIES = ((r"&#(?:38|[xX]26);?|&amp;?", "&"), (r"&#(?:47|[xX]2[fF]);?", "/"), (r"&#(?:39|[xX]27);?|&apos;", "'"), (r"&#(?:34|[xX]22);?|&quot;?", '"'))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _absolute(host: Column, path: Column, query: Column) -> Column:
    """One form of a URL: lower-case host, dot segments resolved, an empty path as ``/``, the query kept; null without a host."""
    segments = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    # a path that ends in a dot segment names a folder
    path = F.concat(F.array_join(segments, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.translate(host, UPPER, LOWER), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _split(rest: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of what follows ``://``."""
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    return F.regexp_extract(rest, r"^[^/?]*", 0), F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)


def canonical(url: Column) -> Column:
    """The form by which URLs are compared: no scheme, no fragment; null for no URL. Nothing else is taken to be the same."""
    return _absolute(*_split(F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 1)))


def decoded(text: Column) -> Column:
    """The entities that URLs in attributes are written with."""
    for pattern, plain in ENTITIES:
        text = F.regexp_replace(text, pattern, plain)
    return F.trim(text)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The canonical form of a target as written on the page of that host and path: absolute, or relative to scheme, host, path or query."""
    h, p, q = _split(F.regexp_replace(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", ""))
    own = F.regexp_replace(target, r"(?s)#.*$", "")
    query, before = F.regexp_extract(own, r"(?s)^[^?]*\?(.*)$", 1), F.regexp_extract(own, r"^[^?]*", 0)
    folder = F.regexp_extract(path, r"^(?:.*/)?", 0)
    return (
        F.when(target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), _absolute(h, p, q))
        .when((own == "") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))  # the page itself, or no place
        .when(target.startswith("?"), _absolute(host, path, query))
        .when(target.startswith("/"), _absolute(host, before, query))
        .otherwise(_absolute(host, F.concat(folder, before), query))
    )


def links(html: Column) -> Column:
    """Targets of all of the HTML's canonical links, refresh redirects and og:url, decoded."""
    text = F.coalesce(html, F.lit(""))
    value = lambda tag, name: decoded(F.concat(*[F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*{v}", 1) for v in VALUES]))
    tags = lambda pattern, target: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), target)
    refresh = lambda t: F.regexp_replace(F.regexp_extract(value(t, "content"), r"(?i)\burl\s*=\s*(.*)$", 1), r"""^["']|["']$""", "")
    return F.concat(
        tags(r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>""", lambda t: value(t, "href")),
        tags(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", refresh),
        tags(r"""(?i)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*>""", lambda t: value(t, "content")),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(a, h.lower(), p) for a, h, p in rules], "action string, rule_host string, rule_path string")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct (host, path): the longest fitting rule, of equals the one with the longer host, of these a block."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    each = urls.select("host", "path").distinct().where("host <> ''").withColumn("suffix", F.explode(suffixes))
    fits = each.join(rules, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("action").alias("action"), F.concat("rule_host", "rule_path").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def aliases(pages: DataFrame) -> DataFrame:
    """(page_id, component): pages joined by shared canonical forms; component is the smallest page_id."""
    keys = F.array_compact(F.concat(F.array("own"), "targets"))
    edges = pages.select("page_id", F.explode(F.array_distinct(keys)).alias("key")).where("page_id IS NOT NULL")
    edges = materialize(edges.distinct(), "alias-edges")
    first = edges.groupBy("key").agg(F.min("page_id").alias("a"))
    return components(edges.join(first, "key").select("a", F.col("page_id").alias("b"))).select(F.col("node").alias("page_id"), F.col("label").alias("component"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component."""
    u = F.col(url)
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("own"), links(F.col(html)).alias("targets"))
    base = materialize(base.withColumn("targets", F.transform("targets", lambda t: resolved(t, F.col("host"), F.col("path")))), "urls")
    ruled = base.join(matched(base, rules), ["host", "path"], "left")
    ruled = materialize(ruled.join(aliases(base), "page_id", "left").select("page_id", "host", "path", "rule", "action", "component"), "ruled")
    says = ruled.where("component IS NOT NULL AND action IS NOT NULL").groupBy("component").agg(F.bool_or(F.col("action") == "block").alias("block"), F.bool_or(F.col("action") == "allow").alias("allow"))
    out = ruled.join(says, "component", "left")
    spread = F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", spread).alias("verdict"), "component")


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))
