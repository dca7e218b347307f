import re

from mosaiq.llm import url_filter as u


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute_rule(host, path, rules=u.RULES):
    fits = [(len(h) + len(p), a, h + p) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(fits)[1]) if fits else (None, None)


def page(i, url, link=None):
    return (i, url, None if link is None else f'<html><head><LINK href="{link}" rel="canonical"></head>')


PAGES = [
    page(1, "https://a.example.com/en/1"),  # blocked
    page(2, "http://www.a.example.com/en/1/?utm_source=x#top"),  # ruled itself
    page(3, "https://other.org/x", "https://a.example.com/en/1"),  # alias of a blocked page
    page(4, "https://third.org/y", "http://OTHER.org/x#top"),  # alias of an alias
    page(5, "https://b.example.com/en/7"),  # allowed explicitly
    page(6, "https://free.org/z", "https://b.example.com/en/7"),
    page(7, "https://mixed.org/z", "https://b.example.com/en/9"),
    page(8, "https://b.example.com/en/9", "https://free.org/z"),  # blocked, and an alias of an allowed page
    page(9, None),
    page(10, "no scheme/en/"),
    page(11, "https://EXAMPLE.NET/de/8?a://b"),
    page(12, "x://example.net/de/9"),
    page(13, "https://notexample.com/en/7"),
    page(14, "://com/en/"),
    page(15, "https://site.org/es"),
    page(16, "https://site.org/es/://x#y"),
    page(17, "https://a.org?x=/es/"),
    page(17, "https://a.org?x=/es/"),
    page(None, "https://q.com/en/3"),
    page(None, None),
    page(18, ""),
    page(19, "https://redir.org/a", None),
]


def test_rules_hosts_and_aliases(spark):
    pages = [(*p, 1, "c") for p in PAGES]
    pages.append((20, "https://r.org/1", '<meta http-equiv="refresh" content="0; url=https://a.example.com/en/1">', 1, "c"))
    pages.append((21, "https://r.org/2", '<meta property="og:url" content="https://r.org/1">', 1, "c"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int, component string")
    out = u.judge(df, u.rule_table(spark)).collect()
    assert len(out) == len(pages)
    by = {r.page_id: r for r in out if r.page_id is not None}
    for i, url, *_ in pages:
        h, p = host_path(url)
        rule, action = brute_rule(h, p)
        found = [r for r in out if r.page_id == i and (r.host, r.path) == (h, p)]
        assert found and all(r.rule == rule for r in found), (i, url)
        assert action is None or found[0].verdict == action
    verdicts = {i: r.verdict for i, r in by.items()}
    assert [verdicts[i] for i in (3, 4, 20, 21)] == ["block"] * 4
    assert verdicts[5] == verdicts[6] == verdicts[7] == "allow" and verdicts[8] == "block"
    assert verdicts[9] == verdicts[10] == verdicts[18] == verdicts[19] == "allow"
    assert by[11].rule == "example.net/de/8" and by[12].verdict == "allow" and by[13].rule == "com/en/"


def test_targets_are_resolved_and_decoded(spark):
    blocked = "https://a.example.com/en/1?x=1&y=2"
    near = [
        ("https://r.org/1", '<link rel="alternate canonical" href="//a.example.com/en/1?x=1&amp;y=2">'),
        ("https://r.org/2", "<meta http-equiv='refresh' content='0;URL=&quot;https:&#47;&#47;a.example.com/en/1?x=1&#38;y=2&quot;'>"),
        ("https://r.org/3", '<link rel=canonical href=/1><meta property="og:url" content="https://other.org/">'),
        ("https://r.org/d/e/4", '<meta property="og:url" content="../.././d/../3#top">'),
        ("https://r.org/d/5", '<p>x</p><LINK REL = "canonical" HREF = "e/4">'),
        ("https://r.org/6?q", '<link rel="canonical" href="https://no.org/"><link href="1" rel="canonical">'),
        ("https://s.org/p?z=1", '<link rel="canonical" href="?z=2">'),
        ("https://s.org/p?z=2", '<link rel="canonical" href="https://R.org/1">'),
    ]
    apart = [
        ("https://t.org/?source=1", None),
        ("https://t.org/?source=2", '<link rel="canonical" href="https://r.org/1">'),
        ("https://www.r.org/1", None),
        ("https://r.org/1/", '<link rel="canonical" href="#x">'),
        ("https://r.org/1.html", '<link rel="canonical" href="mailto:x@r.org/1">'),
        (None, '<link rel="canonical" href="/1">'),
    ]
    rows = [(0, blocked, None)] + [(k + 1, *p) for k, p in enumerate(near)] + [(100 + k, *p) for k, p in enumerate(apart)]
    out = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), u.rule_table(spark)).collect()}
    assert {out[k].component for k in range(9)} == {0} and all(out[k].verdict == "block" for k in range(9))
    assert out[101].component == 0 and all(out[100 + k].component != 0 and out[100 + k].verdict == "allow" for k in (0, 2, 3, 4, 5))


def test_longest_rule_and_ties(spark):
    rules = [("allow", "b.c", "/xy"), ("block", "a.b.c", "/x"), ("allow", "c", "/"), ("block", "c", "/xyz/ab")]
    df = spark.createDataFrame([(1, "s://a.b.c/xyq", None), (2, "s://a.b.c/xyz/abc", None), (3, "s://c/", None), (4, "s://c", None)], "page_id long, url string, html string")
    out = {r.page_id: (r.rule, r.verdict) for r in u.judge(df, u.rule_table(spark, rules)).collect()}
    assert out == {1: ("a.b.c/x", "block"), 2: ("c/xyz/ab", "block"), 3: ("c/", "allow"), 4: (None, "allow")}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert u.judge(df, u.rule_table(spark)).collect() == []
