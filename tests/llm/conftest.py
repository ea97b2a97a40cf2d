import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_bytes int, n_lines int, row int, fp int, ids int, y int"


def fill(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: fill(spark, rows)


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "the", "of", "é", "ß", "日本", "x|y", "##", "don't", "<|endoftext|>"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "A line that many of the documents have in common, word for word."
    rows = [(i, f"{say(20)}\n{'  ' if i % 2 else ''}{shared if i % 3 else shared.upper()}\n{say(rng.randint(1, 60))}") for i in range(12)]
    passage = say(120)
    rows += [(20 + i, f"{say(9)} {passage} {say(7)}") for i in range(4)]
    rows += [(30, "Der " * 300), (31, "word " * 20_000), (32, say(8000)), (33, "a" * 50_000), (None, passage), (None, None), (34, None), (35, ""), (36, " \t\n\r\x0b\x0c "), (37, "\n\n"), (38, "one"), (39, "one two"), (40, "\x1c \x85\xa0x y")]
    rows += [(41, passage), (41, passage), (3, rows[3][1]), (42, say(30)), (42, say(30))]
    return rows


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_rows):
    return make_docs(edge_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
