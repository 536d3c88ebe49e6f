"""Phrase tables: the inverted index against plain containment."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from voxtally.functions.hybrid import keyword_group_score
from voxtally.functions.keywords import keywords_in
from voxtally.operators import phrase_tables
from voxtally.rules import Dictionary

TEXTS = [
    "The app is NOT working, not Working at all; called twice",
    "",
    None,
    "refund",
    "a\nb a.b (x|y) \\E end \\Q",
    "Été à la carte: ÉTÉ",
    "aaaa aaaaa",
    "abc" * 5000 + " late phrase here",
    "not working",
]
PHRASES = ["not working", "Working at", "app", "a", "b a", "fund", "refund", "zz", "", None, "APP", "été", "aaaa", "aaaaa", "(x|y)", "\\E end", "phrase here", "cabc"]


def rows_of(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def table_of(spark, phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def contained(text, phrases):
    return sorted({p.lower() for p in phrases if p and p.lower() in (text or "").lower()})


def test_phrases_are_those_contained(spark):
    for max_bytes in (0, 1 << 20):
        out = phrase_tables.with_phrases(rows_of(spark), "k", "t", table_of(spark, PHRASES), max_bytes=max_bytes)
        assert out.columns == ["k", "t", "phrases"]
        assert {r.k: r.phrases for r in out.collect()} == {k: contained(t, PHRASES) for k, t in enumerate(TEXTS)}


def test_runs_across_slabs_and_keys_of_two_columns(spark):
    texts = ["x" * (phrase_tables.SLAB - n) + "needle" + "y" * n for n in range(9)]
    df = rows_of(spark, texts).select((F.col("k") % 3).alias("a"), (F.col("k") / 3).cast("int").alias("b"), "t")
    out = phrase_tables.with_phrases(df, ["a", "b"], "t", table_of(spark, ["needle", "eedley", "absent"]))
    assert {(r.a, r.b): r.phrases for r in out.collect()} == {(k % 3, k // 3): contained(t, ["needle", "eedley"]) for k, t in enumerate(texts)}


def test_empty_tables(spark):
    none = table_of(spark, PHRASES).limit(0)
    assert [r.phrases for r in phrase_tables.with_phrases(rows_of(spark), "k", "t", none).collect()] == [[]] * len(TEXTS)
    assert phrase_tables.with_phrases(rows_of(spark).limit(0), "k", "t", table_of(spark, PHRASES)).count() == 0


def test_many_phrases_need_no_nested_loop(spark):
    """Two hundred thousand phrases, one of them in every text: shares of the index are joined by runs."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    phrases = {" ".join(rng.sample(words, 2)) for _ in range(200_000)} | {"hot phrase"}
    texts = [" ".join([*rng.sample(words, 40), "hot phrase"]) for _ in range(300)]
    out = phrase_tables.with_phrases(rows_of(spark, texts), "k", "t", table_of(spark, phrases), max_bytes=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    by_two = {}
    for r in out.collect():
        by_two[r.k] = set(r.phrases)
    for k, text in enumerate(texts):
        parts = {text[i:j] for i in range(len(text)) for j in range(i + 5, min(len(text), i + 16) + 1)}
        assert by_two[k] == phrases & parts


def test_rare_runs_are_chosen(spark):
    index = {r.phrase: r.gram for r in phrase_tables.phrase_index(table_of(spark, ["of the cat", "of the dog", "of the", "cat", "ab"])).collect()}
    assert index["cat"] == "cat" and index["ab"] == "ab"
    assert index["of the cat"] not in "of the" and index["of the dog"] not in "of the"


def test_keywords_by_table_are_those_of_the_pattern(spark):
    dictionary = Dictionary.of({"one": ["not working", "working at all", "app", "fund"], "two": ["refund", "aaaa", "aaaaa", "a.b", "(x|y)", "ÉTÉ"]})
    out = phrase_tables.keywords_by_table(rows_of(spark), "k", "t", table_of(spark, dictionary.phrases))
    plain = rows_of(spark).select("k", keywords_in(F.col("t"), dictionary).alias("keywords"))
    assert {r.k: r.keywords for r in out.collect()} == {r.k: r.keywords for r in plain.collect()}


def test_quoted_phrases_with_the_end_of_a_quote(spark):
    out = phrase_tables.keywords_by_table(rows_of(spark, ["x \\E end", "x E end"]), "k", "t", table_of(spark, ["\\E end"]))
    assert {r.k: r.keywords for r in out.collect()} == {0: ["\\E end"], 1: []}


def test_group_counts_and_scores(spark):
    groups = {"negative_phrases": ["not working", "refund", "Refund"], "positive": ["app", "été"], "very_negative": ["refund"]}
    weights = {"negative_phrases": -7.0, "positive": 7.0, "very_negative": -9.0}
    table = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "grp string, phrase string")
    counts = phrase_tables.phrase_group_counts(rows_of(spark), "k", "t", table)
    expected = {k: {g: len(c) for g, ps in groups.items() if (c := contained(t, ps))} for k, t in enumerate(TEXTS)}
    assert {r.k: r.group_counts for r in counts.collect()} == expected
    lowered = {g: sorted({p.lower() for p in ps}) for g, ps in groups.items()}
    scored = phrase_tables.group_score_by_table(rows_of(spark), "k", "t", table, weights)
    plain = rows_of(spark).select("k", keyword_group_score(F.col("t"), lowered, weights).alias("keyword"))
    assert scored.columns == ["k", "t", "keyword"]
    assert {r.k: r.keyword for r in scored.collect()} == {r.k: r.keyword for r in plain.collect()}


def test_few_phrases_need_no_join(spark):
    for few, plan_joins in ((PHRASES, False), ([*PHRASES, *(f"phrase {i}" for i in range(phrase_tables.FEW_PHRASES))], True)):
        out = phrase_tables.with_phrases(rows_of(spark), "k", "t", table_of(spark, few))
        assert ("Join" in out._jdf.queryExecution().executedPlan().toString()) == plan_joins
        assert {r.k: r.phrases for r in out.collect()} == {k: contained(t, few) for k, t in enumerate(TEXTS)}


def test_broadcast_counts_what_a_row_takes_in_memory(spark):
    """Many short phrases are more memory than text, on the driver too."""
    phrases = spark.range(3000).select(F.concat(F.lit("p"), F.col("id")).alias("phrase"))
    out = phrase_tables.with_phrases(rows_of(spark), "k", "t", phrases, max_bytes=3000 * 60)
    assert "strategy=broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_large_tables_are_cut_down_before_they_are_filed(spark):
    """Of many phrases only those go on whose runs lie in the texts; long and short ones, and letters of several bytes, are found."""
    long = "the same beginning of more than thirty two bytes, then "
    texts = ["Ein Übermaß ist da", f"x {long}A", f"{long}B y", "ab", None, "", "c"]
    real = ["übermaß ist", "maß", "ß", "ist da", "ab", "c", f"{long}a", f"{long}b", long, "ein übermaß ist da"]
    phrases = [*real, f"{long}q", *(f"absent {i:05d} phrase" for i in range(20_000)), *real]
    known = phrase_tables._filed(rows_of(spark, texts), table_of(spark, phrases), "t")
    kept = [r.phrase for r in known.collect()]
    assert set(real) <= set(kept) and len(kept) == len(set(kept)) < 100
    assert {r.size for r in known.collect()} <= set(range(1, 33))
    for max_bytes in (0, 1 << 20):
        out = phrase_tables.with_phrases(rows_of(spark, texts), "k", "t", table_of(spark, phrases), max_bytes=max_bytes)
        assert {r.k: r.phrases for r in out.collect()} == {k: contained(t, phrases) for k, t in enumerate(texts)}
