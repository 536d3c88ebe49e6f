from __future__ import annotations

import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = "id string, ids int, tie int, block string, queue int, before int, h int, place int, removed int, failures string, n int, node int, score string, kind int"


def passage(seed: int, words: int) -> str:
    rng = random.Random(seed)
    text = [rng.choice(("the", "a", "of", "to")) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(words)]
    for i in range(6, words, 7):
        text[i] += rng.choice((".", ",", ".\n"))
    return " ".join(text)


def rows_of_texts() -> list[tuple]:
    """Ids and texts: near and exact copies, a shared passage, a long text, nulls, blanks and repeated rows."""
    base, shared = passage(1, 120), passage(2, 60)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:40], *passage(3, 80).split(" ")])
    rows = [(1, base), (2, near), (3, base), (4, far), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "One\ttwo")]
    rows += [(10, passage(4, 50) + ". " + shared), (11, passage(5, 50) + ". " + shared + " " + passage(6, 20)), (12, passage(7, 6000))]
    rows += [(13, "x" * 5000), (14, "naïve café — 日本 's it's"), (14, "naïve café — 日本 's it's"), (None, passage(8, 30)), (15, "# # # $ $ |" * 20), (16, "AAA BBB CCC DDD EEE FFF GGG HHH III JJJ KKK"), (17, "a b c d e f " * 10)]
    return rows


@pytest.fixture(scope="session")
def texts():
    return rows_of_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    extra = [None] * len(CLASHING.split(","))
    rows = [(i, t, "en", "hot" if (i or 0) % 3 else None, len(t or ""), *extra) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
