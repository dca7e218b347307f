"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains
(0). Nobody says which rules are right: expectation-maximisation over the votes
estimates, for good documents and for each kind of bad ones, how often each rule says
what, and the classes' shares; from these follow the rules' accuracies. A document's posterior probability of being good then joins all votes, so no single
rule has to pass.

The votes of R rules have at most 3^R patterns. Documents are counted by pattern,
and only those counts (their number does not depend on the corpus) come to the
driver, where the maximisation runs. The posterior is an expression over the votes.

Statistics need no shuffle: they are one nested expression over a text's own words.
``let`` binds a value once; a plain alias would be inlined into the lambdas and
computed again for each word.

Defined results: null and empty texts have no words, fail the base rule and are not
kept; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .store import materialize
from .textops import WORD

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"  # all but the symbols


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def covered(positions: Column, width: int) -> Column:
    """Places covered by windows of ``width`` at sorted distinct positions."""
    step = F.transform(positions, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(positions, i + 1) - p, F.lit(width))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included."""

    def places(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda ps: F.filter(ps, lambda p, k: (p.h == F.get(ps, k - 1).h) | (p.h == F.get(ps, k + 1).h))
        return let(F.sort_array(F.transform(let(pairs, again), lambda p: p.i)), lambda at: covered(at, width))

    def count(hashes: Column) -> Column:
        n = F.size(hashes) - (width - 1)
        keys = F.slice(F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)])), F.lit(1), F.greatest(n, F.lit(0)))
        return let(keys, lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.lit(0)).otherwise(places(ks)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics and those the rules look at, one row for each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    inner = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda ws: F.struct(F.size(ws).alias("n_words"), F.size(F.array_distinct(ws)).alias("n_distinct"), repeated_words(ws).alias("n_repeat_words")))
    at_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        inner.alias("w"),
        at_lines.alias("l"),
        F.length(F.regexp_replace(t, SPACES, "")).alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).alias("n_capitals"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).alias("n_shouts"),
        F.length(F.regexp_replace(t, r"[^.?!…]+", "")).alias("n_stops"),
    )
    whole = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_capitals", "n_shouts", "n_stops"]
    place = {"n_words": "w.", "n_distinct": "w.", "n_repeat_words": "w.", "n_lines": "l.", "n_dup_lines": "l."}
    return found.select("doc_id", *[F.col(place.get(c, "") + c).cast("long").alias(c) for c in whole])


def rules() -> dict[str, Column]:
    """Name to vote: 1 good, -1 bad, 0 abstains."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    size, mean = F.col("n_words"), chars / n
    return {
        "length": vote(size >= 50, size < 10),
        "symbols": vote(F.col("n_symbols") * 100 <= n, F.col("n_symbols") * 10 > n),
        "repeats": vote(F.col("n_repeat_words") == 0, F.col("n_repeat_words") * 5 > n),
        "lines": vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), F.col("n_dup_lines") * 10 > F.col("n_lines") * 6),
        "word_length": vote((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 15)),
        "variety": vote((F.col("n_distinct") * 10 > n * 3) | (size >= 2000), (F.col("n_distinct") * 5 < n) & (size < 2000)),
        "capitals": vote(F.col("n_capitals") * 10 <= chars, F.col("n_capitals") * 10 > chars * 3),
        "stops": vote((F.col("n_stops") * 40 >= n) & (F.col("n_shouts") * 10 < n), F.col("n_shouts") * 5 > n),
    }


VOTES = (-1, 0, 1)
ANCHOR = {-1: 0.98, 0: 0.01, 1: 0.01}

Model = tuple[list[float], list[list[dict[int, float]]]]  # the classes' shares; for each class and rule its votes' probabilities


def responsibilities(pattern: tuple[int, ...], model: Model) -> list[float]:
    """The classes' posterior probabilities; class 0 is the good one."""
    odds = [math.log(share) + sum(math.log(says[r][v]) for r, v in enumerate(pattern)) for share, says in zip(*model, strict=True)]
    top = max(odds)
    parts = [math.exp(x - top) for x in odds]
    return [x / sum(parts) for x in parts]


def estimate(patterns: dict[tuple[int, ...], int], width: int, rounds: int = 50, smooth: float = 1.0, belief_in_anchor: float = 0.2) -> Model:
    """Expectation-maximisation over counted vote patterns.

    Bad documents are of several kinds that share no symptom, so there is a class for
    each rule beside the good one. It starts from the documents with that rule's bad
    vote. How the rule votes on its own class is estimated like all else, with a prior
    (``ANCHOR``, worth the share ``belief_in_anchor`` of all documents) that keeps the
    classes apart from each other.
    """
    classes = width + 1
    belief = {}
    for p in patterns:
        bad = [r + 1 for r, v in enumerate(p) if v < 0] or [0]
        belief[p] = [0.1 / classes + 0.9 * (c in bad) / len(bad) for c in range(classes)]
    total = sum(patterns.values())
    for k in range(rounds + 1):
        mass = [sum(n * belief[p][c] for p, n in patterns.items()) for c in range(classes)]
        shares = [(m + smooth) / (total + classes * smooth) for m in mass]
        says = []
        for c in range(classes):
            counts = [dict.fromkeys(VOTES, smooth) for _ in range(width)]
            for p, n in patterns.items():
                for r, v in enumerate(p):
                    counts[r][v] += n * belief[p][c]
            if c:
                for v in VOTES:
                    counts[c - 1][v] += belief_in_anchor * total * ANCHOR[v]
            says.append([{v: x / sum(own.values()) for v, x in own.items()} for own in counts])
        if k < rounds:
            belief = {p: responsibilities(p, (shares, says)) for p in patterns}
    return shares, says


def accuracies(model: Model) -> list[float]:
    """How often each rule is right when it votes."""
    shares, says = model
    out = []
    for r in range(len(says[0])):
        right = shares[0] * says[0][r][1] + sum(s * x[r][-1] for s, x in zip(shares[1:], says[1:], strict=True))
        wrong = shares[0] * says[0][r][-1] + sum(s * x[r][1] for s, x in zip(shares[1:], says[1:], strict=True))
        out.append(right / (right + wrong))
    return out


def posterior(model: Model, names: list[str]) -> Column:
    """The good class's posterior probability, over the votes in the columns ``names``."""
    parts = []
    for share, says in zip(*model, strict=True):
        odds = F.lit(math.log(share))
        for name, s in zip(names, says, strict=True):
            odds = odds + F.when(F.col(name) == 1, math.log(s[1])).when(F.col(name) == -1, math.log(s[-1])).otherwise(math.log(s[0]))
        parts.append(odds)
    # 1 / (1 + the others' odds against it); votes are few, so no sum underflows
    against = F.lit(0.0)
    for x in parts[1:]:
        against = against + F.exp(x - parts[0])
    return 1 / (1 + against)


def supervise(voted: DataFrame, names: list[str], out: str = "quality") -> DataFrame:
    """Add the posterior probability of being good to a table with the rules' votes."""
    counts = voted.groupBy(*names).count().collect()  # at most 3 ^ rules rows
    model = estimate({tuple(int(v) for v in r[:-1]): r[-1] for r in counts}, len(names))
    return voted.withColumn(out, posterior(model, names))


def judge(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base statistics, base_failed, kept, quality (the posterior) and each rule's vote."""
    votes = rules()
    names = [f"vote_{k}" for k in votes]
    voted = statistics(docs, doc_id, text).select("*", *[c.cast("int").alias(f"vote_{k}") for k, c in votes.items()])
    scored = supervise(materialize(voted, "votes"), names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality", *names)


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
