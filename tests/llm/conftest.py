import random

import pytest

WS = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, shared passages, near copies."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdeéñß") for _ in range(rnd.randint(1, 9))) for _ in range(400)]

    def words(n):
        return [rnd.choice(vocab) + rnd.choice(["", "", "", ".", ","]) for _ in range(n)]

    passage = words(60)
    base = words(120)
    rows = [
        (0, None, "en", "a", None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", None, "a", 4),
        (3, "one", "en", None, 3),
        (4, " ".join(base), "en", "a", 5),
        (5, " ".join(base), "en", "b", 5),
        (6, "\n".join(base).upper(), "en", "b", 5),
        (7, "x " + " ".join(passage) + " y", "de", "b", 5),
        (8, " ".join(words(30) + passage + words(30)), "de", None, 5),
        (9, " ".join(passage[:12]), "de", "c", 5),
        (9, " ".join(passage[5:40]), "de", "c", 5),
        (10, " ".join(passage[5:40]), "de", "c", 5),
        (10, " ".join(passage[5:40]), "de", "c", 5),
        (None, " ".join(passage + words(5)), "de", "c", 5),
        (None, "z " * 700, "fr", "c", 5),
        (11, " ".join(words(9000)) + " \x1f\x85　 " + "q" * 5000, "fr", "d", 5),
        (12, "tic tac " * 300, "fr", "d", 5),
    ]
    for k in range(25):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((20 + k, rnd.choice([" ", "  ", "\n"]).join(w), "en", rnd.choice(["a", "b", None]), 9))
    for k in range(40):
        rows.append((60 + k, WS[k % 6].join(words(rnd.randint(1, 260))), "en", rnd.choice("abcd"), 9))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).selectExpr("*", "'x' AS key_id", "1 AS bucket", "2.5 AS kept", "array(1) AS positions", "'t' AS _g", "1 AS _i", "2 AS i", "3 AS t", "4 AS d", "5 AS copies", "'r' AS row", "0.5 AS position", "1 AS node", "2 AS label", "3 AS taken", "4 AS _copies").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id < -1")
