"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak parts of a credential (an
identifier, a secret value, an endpoint) are common in clean text, so they are
reported only when complementary parts meet: the parts of a document are sorted and
interval-joined, within one paragraph (the scope) and a bounded distance, and a weak
secret counts with an identifier or an endpoint near it; these partners then count
too. A strong span can also be the partner of a weak part.

Offsets are code points, ends exclusive. Defined results: null and empty texts have
no spans; repeated rows are scanned alike; an empty table gives an empty result;
other columns are kept where a redacted table is asked for and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import LOWER, frugal

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # AKIA[A-Z0-9]+ of 18 or more characters
HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ of 16 or more characters
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")

LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENT = re.compile(r"(?:(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}|(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,31}(?![A-Za-z0-9]))", re.ASCII)
ENDPOINT = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?i:endpoint|host(?:name)?|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}(?::\d{2,5})?)", re.ASCII)
TURN = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
SCOPE = re.compile(r"\n[\x20\t]*\n")

_LOWER = bytes(LOWER.tolist())


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Strong spans as (start, kind, end) in order, and assignments whose value is too short to be strong."""
    raw = text.encode().translate(_LOWER)
    found, short = [], []
    if any(k in raw for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 12:
                found.append((m.start(), 0, m.end()))
            elif size >= 8:
                short.append((m.start(), 4, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found), short


def _mixed(s: str) -> bool:
    """Letters and digits, many different ones, in both cases or in many turns: not a word, path or rule line."""
    if len(set(s)) * 3 < min(len(s), 40) or not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return False
    return (any(c.islower() for c in s) and any(c.isupper() for c in s)) or len(TURN.findall(s)) >= 4


def _apart(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end) that meet none of ``taken``, which is in order and may nest."""
    begins, ends = [], []
    for s, e in taken:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    first = [bisect_right(ends, x[0]) for x in spans]
    return [x for x, k in zip(spans, first, strict=True) if k == len(ends) or begins[k] >= x[2]]


def linked_spans(text: str, strong: list[tuple[int, int, int]], short: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Weak parts that have a complementary part within ``reach`` code points of their paragraph."""
    taken = [(s, e) for s, _, e in strong]
    spans = lambda kind, pattern, ok=lambda t: True, taken=taken: _apart([(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m[0])], taken)
    secrets = _apart(sorted(short), taken)
    secrets += spans(4, LONG, _mixed, sorted([*taken, *((s, e) for s, _, e in secrets)]))
    if not secrets and not strong:
        return []
    keys = sorted([*secrets, *(x for x in strong if x[1] != 1)])
    # spans of one kind never overlap, so their ends are in order like their starts
    kinds = [[x for x in strong if x[1] == 1], spans(3, IDENT, lambda t: any(c.isdigit() or c in ":=" for c in t)), spans(5, ENDPOINT)]
    if not keys or not any(kinds):
        return []
    breaks = [m.start() for m in SCOPE.finditer(text)]
    out = set()
    for near in kinds:
        begins, ends = [x[0] for x in near], [x[2] for x in near]
        scopes = [bisect_right(breaks, x) for x in begins]
        for s in keys:
            scope = bisect_right(breaks, s[0])
            for k in range(bisect_right(ends, s[0] - reach), bisect_left(begins, s[2] + reach)):
                p = near[k]
                if scopes[k] == scope and (p[2] <= s[0] or p[0] >= s[2]):
                    out |= {x for x in (s, p) if x[1] > 2}
    return sorted(out)


def scan_text(text: str | None, reach: int = 300) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Strong and linked spans of one text."""
    if not text:
        return [], []
    strong, short = base_spans(text)
    return strong, linked_spans(text, strong, short, reach)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])


@frugal
def _scan(it: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for x in batch.column(1):
            strong, linked = scan_text(x.as_py(), reach)
            kinds = [k for _, k, _ in strong]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(strong).encode()).hexdigest(), written(sorted(strong + linked)), len(linked)))
        cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(SCANNED)[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=SCANNED)


def scan(docs: DataFrame, reach: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_scan, reach=reach), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")


@frugal
def _redact(it: Iterator[pa.RecordBatch], at: int, reach: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = []
        for x in batch.column(at):
            t = x.as_py()
            strong, linked = scan_text(t, reach)
            out.append(redact(t, strong + linked) if strong or linked else t)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redacted(docs: DataFrame, reach: int = 300, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The same table with every found span replaced in ``text``; no row is dropped.

    A column named by ``n_chars`` gets the new texts' lengths.
    """
    out = docs.mapInArrow(partial(_redact, at=docs.columns.index(text), reach=reach), docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars else out


def op8(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
