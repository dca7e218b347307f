import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mosaiq.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    repeated = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n_words, n_repeat = len(w), len(repeated)
    return n_words, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n_repeat, n_words < 10 or 100 * n_repeat > 20 * n_words


TEXTS = [
    "a b c d e f g h a b c d e",
    "a a a a a a a",
    "x\n\nx\n \nx \nx\r\ny",
    "# * $ % & | < > ##\n#",
    "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w6 w7 w1 w2 w3 w4 w5",
    "\U0001f600\U0001f600 é \x85 \x1c",
    "one two three four",
    "p q r s t\np q r s t",
]


def test_statistics_against_brute_force(spark, edge_docs, edge_rows, no_docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in q.judge(df).collect():
        assert tuple(r)[1:7] == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    out = sorted((str(r[0]), *tuple(r)[1:7]) for r in q.judge(edge_docs).collect())
    assert out == sorted((str(r[0]), *brute(r[1])) for r in edge_rows)
    assert q.judge(no_docs).collect() == []


def test_kept_follows_base_and_posterior(edge_docs):
    for r in q.judge(edge_docs).collect():
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
        assert 0 <= r.quality <= 1


def test_maximisation_finds_the_rules_accuracies():
    """Two kinds of bad documents, each with its own rule and a noisy companion."""
    rnd = random.Random(1)
    patterns, truth = Counter(), Counter()
    for _ in range(20_000):
        kind = rnd.choices([0, 1, 2], [0.8, 0.12, 0.08])[0]
        p = tuple(-1 if rnd.random() < (0.97 if kind == k else 0.01) else 1 if rnd.random() < 0.9 else 0 for k in (1, 2))
        noisy = -1 if rnd.random() < (0.6 if kind == 1 else 0.05) else 1
        patterns[(*p, noisy)] += 1
        truth[(*p, noisy), kind == 0] += 1
    model = q.estimate(patterns, 3)
    assert abs(model[0][0] - 0.8) < 0.05
    for r, found in enumerate(q.accuracies(model)):
        says = Counter()
        for (p, good), n in truth.items():
            says[p[r] * (1 if good else -1)] += n
        assert abs(found - says[1] / (says[1] + says[-1])) < 0.06
    right = sum(n for (p, good), n in truth.items() if (q.responsibilities(p, model)[0] >= 0.5) == good)
    assert right > 0.93 * 20_000


def test_posterior_expression_equals_the_estimate(spark):
    patterns = {(1, 1): 50, (-1, -1): 30, (1, 0): 10, (0, -1): 4, (-1, 1): 3}
    df = spark.createDataFrame([p for p, n in patterns.items() for _ in range(n)], "a int, b int")
    rows = {(r.a, r.b): r.quality for r in q.supervise(df, ["a", "b"]).distinct().collect()}
    model = q.estimate(patterns, 2)
    assert all(abs(rows[p] - q.responsibilities(p, model)[0]) < 1e-9 for p in patterns)
    assert rows[1, 1] > 0.9 and rows[-1, -1] < 0.1
    plan = q.supervise(df, ["a", "b"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_stays_and_junk_goes(spark):
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(["alpha", "bravo", "golf", "hotel", "india", "lima", "oscar", "tango"]) + str(rnd.randrange(999)) + (". " if k % 9 == 8 else "") for k in range(120)) for _ in range(200)]
    junk = ["BUY!! NOW!! " * 40, "### $$$ %%% &&& " * 30 + "x", "a|b|c|d " * 60]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in q.judge(df).where(F.col("kept")).collect()}
    assert kept == set(range(200))
