"""Patterns of phrases behind a guard, and spaces that need no change: the same is found as without."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from voxtally.functions.common import WHITE_SPACE, WHITE_SPACE_RUN, squeeze, strip
from voxtally.functions.keywords import categories_in
from voxtally.rules import Dictionary, Phrases, any_case, phrase_regex

PHRASES = ["kind of", "is it", "schst", "ção", "a", "Zu Ende", "(x|y)", "\U0001F600 ok"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def mixed(pieces, count: int = 150) -> list[str]:
    rng = random.Random(5)
    return ["", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(count))]


def test_guarded_patterns_find_what_they_did(value):
    """F15, F16, F18: a look-ahead by plain classes goes before the folding of letters."""
    pieces = [*PHRASES, "KİND OF", "Kınd of", "ſCHST", "ÇÃO", "zu ende", "sch", "st", "i", "k", " ", "\U0001F600", "x"]
    for phrases in (PHRASES, PHRASES[:4], ["zu", "ıs"], ["e", "ende"], [f"{c}x" for c in "abcdefghijklmno"]):
        def both(t, phrases=phrases):
            return F.struct(*[F.regexp_extract_all(t, F.lit("(?iU)" + p), F.lit(0)).alias(n) for n, p in (("now", any_case(phrases)), ("was", phrase_regex(phrases)))])

        assert all(found["now"] == found["was"] for found in value(both, *mixed(pieces)))
    assert Phrases.of(["schst", "die"]).regex.startswith("(?iU)(?-i:(?=[DSds")
    assert any_case(["", "abc"]) == phrase_regex(["", "abc"])  # an empty phrase begins anywhere


def test_categories_of_repeated_and_blank_rows(spark):
    df = spark.createDataFrame([("SCHST",), ("SCHST",), (None,), ("",), ("s",)], "t string")
    rows = df.select(categories_in(F.col("t"), Dictionary.of({"one": ["schst"], "two": ["di", "sch"]})).alias("c")).collect()
    assert [r.c for r in rows] == [["one", "two"], ["one", "two"], [], [], []]


def test_squeeze_leaves_single_spaces_alone(value, spark):
    texts = mixed(["a", "b", " ", "  ", "\t", "\n", " ", "　", "\x1c", "\x85", "é"], 300)

    def both(t):
        return F.struct(squeeze(t).alias("now"), strip(F.regexp_replace(t, WHITE_SPACE_RUN, " ")).alias("was"))

    assert all(found["now"] == found["was"] for found in value(both, *texts, *WHITE_SPACE))
    assert "&&[^ ]" in plan(spark.createDataFrame([("a",)], "t string").select(squeeze(F.col("t"))))
