"""Several dictionaries in one pass, and lexicons whose tokens are known when the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxtally.functions.keywords import categories_in, categories_in_each, keywords_in, keywords_in_each
from voxtally.functions.lexicon import Scorer
from voxtally.operators import polarity
from voxtally.rules import GROUP, Dictionary, default_profile, phrase_regex

DICTIONARIES = {
    "one": Dictionary.of({"a": ["not working", "work"], "b": ["king at", "ΣΑΣ", "ción"], "none": []}),
    "two": Dictionary.of({"c": ["not", "working at all"], "a": ["r\\E\\Q", "(x|y)"]}),
    "empty": Dictionary.of({}),
    "full": default_profile("tagged_chat").dictionary,
}
TEXTS = [
    "It is NOT WorKing at all, not working; WORK", "not wor", "", None, "r\\E\\Q (X|Y) canCIÓN σας ΣΑΣ σασ",
    "money ſhort of, I was charged double: not worKing", "kıng at KİNG AT",
]


def test_keywords_of_each_dictionary_as_alone(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    together = df.select(keywords_in_each(F.col("t"), DICTIONARIES).alias("k")).select("k.*")
    alone = df.select(*[keywords_in(F.col("t"), d).alias(n) for n, d in DICTIONARIES.items() if d.phrases], F.array().cast("array<string>").alias("empty"))
    assert together.collect() == alone.select(*together.columns).collect()
    # a pass for all and a short pattern of each row's own, where there was a whole pattern for each dictionary
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iU)(?=(") == 1


def test_categories_of_each_dictionary_as_alone(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(categories_in_each(F.col("t"), DICTIONARIES).alias("m"), *[categories_in(F.col("t"), d).alias(n) for n, d in DICTIONARIES.items()]).collect()
    assert [[(m.profile, m.category) for m in r.m] for r in rows] == [[(n, c) for n in DICTIONARIES for c in r[n]] for r in rows]
    assert rows[0].one == ["a", "b"] and rows[0].two == ["c"]


def test_starts_stand_in_groups():
    phrases = [f"{chr(97 + i)}{chr(97 + j)}x" for i in range(2 * GROUP) for j in range(2 * GROUP)]
    assert phrase_regex(phrases).startswith("(?:(?=[abcdef])(?:a")
    assert re.findall(phrase_regex(phrases), " ".join(phrases) + " zzx aax") == [*phrases, "aax"]


def test_texts_send_only_words_that_a_small_lexicon_holds(spark):
    df = spark.createDataFrame([(1, "good morning to all, Good! bad"), (2, "nothing known"), (3, None)], "k int, t string")
    lexicon = spark.createDataFrame([("good", 19), ("good", 20), ("bad", -25), (None, 1)], "token string, valence_tenths int")
    hits = polarity._known_words(df, "k", "t", lexicon)
    assert [(r.k, dict(r._hits)) for r in hits.collect()] == [(1, {"good": 20, "bad": -25})]
    assert "filter(array_distinct" in hits._jdf.queryExecution().optimizedPlan().toString()
    inside = polarity.score_polarity(df, "k", "t", lexicon, Scorer()).select("k", "polarity").collect()
    assert sorted(inside) == sorted(polarity.polarity_by_join(df, "k", "t", lexicon, Scorer()).select("k", "polarity").collect())


def test_repeated_keys_of_texts(spark):
    df = spark.createDataFrame([(1, "good"), (1, "good")], "k int, t string")
    lexicon = spark.createDataFrame([("good", 19)], "token string, valence_tenths int")
    assert polarity.polarity_by_join(df, "k", "t", lexicon, Scorer()).count() == 2
