import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    syllables = ["tha", "re", "on", "wi", "le", "mo", "sta", "ing", "er", "do"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with nulls, empties, repeats, copies, long texts."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(5, 400)), "en", "s", 1) for i in range(40)]
    base = prose(rng, 300).split()
    for i in range(40, 60):  # near copies of one text
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = "edit%d" % rng.randrange(99)
        rows.append((i, " ".join(own), "en", "s", 1))
    rows += [(100 + i, " ".join(base), "en", "s", 1) for i in range(8)]  # exact copies
    rows += [(200, None, None, None, None), (201, "", "xx", "", 0), (202, " \n\t ", "fr", "s", 4), (None, prose(rng, 30), "en", "s", 1), (None, None, None, None, None)]
    rows += [(5, rows[5][1], "en", "s", 1), (203, "a b", "en", "s", 3), (204, "a b", "en", "s", 3), (205, "word " * 9000, "de", "s", 1), (206, "x" * 70000, "en", "s", 1)]
    rows += [(207, "Ünïcödé, <|endoftext|> it's a_b 12.5 — 日本語 🙂!!!", "es", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With further columns whose names operators use inside."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as key", "2 as block", "'x' as part", "3 as size", "4 as rank", "5 as label", "6 as score", "7 as bands")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
