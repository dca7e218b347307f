"""DuckDB SQL of the operators that SQL can express, for their contracts' columns."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  n AS (SELECT doc_id, w, len(w) AS n FROM d),
  p AS (SELECT doc_id, unnest(range(1, greatest(n - 11, 1))) AS i, w FROM n),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM p),
  firsts AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x),
  hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (x) WHERE first < win.doc_id),
  gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 13) t(k)),
  each AS (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(w) AS x FROM n),
  kept AS (SELECT each.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY each.i) AS kept FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
"""
OP4 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
  n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
  win AS (SELECT doc_id, i, md5(CAST(b[i:i + 199] AS BLOB)::VARCHAR) AS x FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200)),
  many AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
  hit AS (SELECT doc_id, i FROM win SEMI JOIN many USING (x)),
  runs AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, g),
  cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM runs GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1), lambda k: substr(hex(b), CASE WHEN k = 0 THEN 1 ELSE 2 * z[k] + 1 END, CASE WHEN k = coalesce(n_spans, 0) THEN 2 * n + 1 ELSE 2 * a[k + 1] - 1 END - CASE WHEN k = 0 THEN 1 ELSE 2 * z[k] + 1 END)), ''))) AS kept_sha256 FROM n LEFT JOIN cut USING (doc_id)
"""
OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
  sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  sets AS (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS digest FROM sh GROUP BY 1),
  reps AS (SELECT digest, min(doc_id) AS rep FROM sets GROUP BY 1),
  rs AS (SELECT sh.* FROM sh SEMI JOIN reps ON rep = doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM rs a JOIN rs b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
  bi AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT reach.a, bi.b FROM reach JOIN bi ON bi.a = reach.b),
  comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sz ON sz.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN reps USING (digest) LEFT JOIN comp ON comp.a = rep
"""
AFTER = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def canon(rest: str) -> str:
    """The form by which URLs are compared, from what follows their ://; dot segments do not occur in the tables."""
    rest = f"regexp_replace({rest}, '#.*$', '', 's')"
    h, p, q = LOW.format(x=f"regexp_extract({rest}, '^[^/?]*')"), f"regexp_extract({rest}, '^[^/?]*([^?]*)', 1)", f"regexp_extract({rest}, '^[^?]*\\?(.*)$', 1, 's')"
    return f"(CASE WHEN {h} = '' THEN NULL ELSE {h} || CASE WHEN starts_with({p}, '/') THEN '' ELSE '/' END || {p} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END END)"


def tags(pattern: str, value: str) -> str:
    """All targets that one kind of tag names, entities decoded."""
    found = f"regexp_extract_all(coalesce(html, ''), '(?i){pattern}')"
    return f"list_transform({found}, lambda t: trim(replace(regexp_extract(t, '(?i){value}=[\"'']?([^\"''\\s>]+)', 1), '&amp;', '&')))"


TARGETS = "list_concat(list_concat(" + tags("<link\\b[^>]*\\brel=[^>]{0,2}canonical\\b[^>]*>", "href") + ", " + tags("<meta\\b[^>]*\\bproperty=[^>]?og:url\\b[^>]*>", "content") + "), " + tags("<meta\\b[^>]*\\bhttp-equiv=[^>]?refresh\\b[^>]*>", "url") + ")"
#: What follows the :// of a target's resolved form.
ABSOLUTE = r"""CASE WHEN t = '' OR starts_with(t, '#') THEN '' WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN regexp_replace(t, '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ''
  WHEN host = '' THEN '' WHEN starts_with(t, '?') THEN host || path || t WHEN starts_with(t, '/') THEN host || t ELSE host || '/' || ltrim(regexp_extract(path, '^(?:.*/)?'), '/') || t END"""


OP2 = rf"""
WITH RECURSIVE u AS (SELECT page_id, {LOW.format(x="regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, {canon('r')} AS own, {TARGETS} AS targets
    FROM (SELECT *, {AFTER.format(u="coalesce(url, '')")} AS r FROM pages)),
  w AS (SELECT page_id, {canon('x')} AS key FROM (SELECT page_id, {ABSOLUTE} AS x FROM (SELECT page_id, host, path, unnest(targets) AS t FROM u))),
  rl AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(action, h, p)),
  best AS (SELECT host, path, max_by(h || p, length(h) + length(p)) AS rule, max_by(action, length(h) + length(p)) AS action FROM (SELECT DISTINCT host, path FROM u) JOIN rl ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
  e AS (SELECT page_id, own AS key FROM u UNION SELECT page_id, key FROM w),
  f AS (SELECT page_id, key, min(page_id) OVER (PARTITION BY key) AS first FROM e WHERE key IS NOT NULL),
  l AS (SELECT DISTINCT page_id AS a, first AS b FROM f UNION SELECT first, page_id FROM f),
  reach(a, b) AS (SELECT page_id, page_id FROM u UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
  comp AS (SELECT a AS page_id, min(b) AS component FROM reach GROUP BY 1),
  j AS (SELECT u.page_id, u.host, u.path, rule, action, CASE WHEN u.page_id IN (SELECT page_id FROM e WHERE key IS NOT NULL) THEN component END AS component FROM u LEFT JOIN best ON best.host = u.host AND best.path = u.path LEFT JOIN comp ON comp.page_id = u.page_id),
  s AS (SELECT component, bool_or(action = 'block') AS block, bool_or(action = 'allow') AS allow FROM j WHERE component IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN block AND NOT coalesce(allow, false) THEN 'block' ELSE 'allow' END) AS verdict, j.component FROM j LEFT JOIN s ON s.component = j.component
"""
