"""Steps that take a share of the time of their whole forms: what they leave out, and that they find the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions.hybrid import hybrid_score, keyword_group_score
from voxtally.functions.lexicon import PUNCTUATION, Scorer, polarity_parts, words_of

def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_marked_words_are_trimmed(value, spark):
    words = ["ok?", "a", "it.", "(kind)", "'tis", "don't", "x-y", "é!", "--", "(ab)", "(abc", "élan,", "İ.", "99%", "a\U0001F600!"]
    trimmed = [w.strip(PUNCTUATION) for w in words]
    assert value(words_of, " ".join(words)) == [w if len(s) <= 2 else s for w, s in zip(words, trimmed)]
    assert "ascii(" in plan(spark.createDataFrame([("a",)], "t string").select(words_of(F.col("t"))))


def test_words_count_until_a_text_is_long(value, spark):
    """5, 6, 20 and 21 words are told apart, whatever stands around them."""
    def weights(t):
        keyword = F.struct(F.lit(5.0).alias("kw_score"), F.lit(1).alias("kw_total"))
        return hybrid_score(t, F.struct(F.lit(0.0).alias("compound"), F.lit(1.0).alias("strongest")), keyword)["score"]

    counts = [1, 5, 6, 20, 21, 22, 23, 24, 60]
    for form in ("{}", " {} ", "\n{}\t\t", "{} "):
        got = value(weights, *[form.format("  ".join(["ab"] * n)) for n in counts])
        kinds = [{round(v, 9) for v in part} for part in (got[:2], got[2:4], got[4:])]
        assert [len(kind) for kind in kinds] == [1, 1, 1] and len(set.union(*kinds)) == 3
    assert ", 23)" in plan(spark.createDataFrame([("a",)], "t string").select(weights(F.col("t"))))


def test_overrides_are_looked_for_where_their_words_are(value, spark):
    """the pattern of an override runs behind plain searches, and finds the same."""
    got = value(keyword_group_score, "nothing but good", "good, but nothing", "no complaint, all great", "no great complaint", "nothing\ngood")
    assert [g["kw_total"] for g in got] == [3, 2, 2, 1, 2]
    assert plan(spark.createDataFrame([("a",)], "t string").select(keyword_group_score(F.col("t")))).count("Contains(") > 14


def test_words_without_a_valence_keep_nothing(value, spark):
    scorer = Scorer(lexicon={"good": 20, "naught": 0, "very": 9})
    got = value(lambda t: polarity_parts(t, scorer), "good naught very thing", "")
    # naught counts 0 and very is a booster: three of four words are neutral, against 2.0 + 1
    assert [(g["compound"], g["strongest"]) for g in got] == [(round(2 / (4 + 15) ** 0.5, 4), 0.5), (0.0, 0.0)]
    # what is known of a word stands alone, not in a structure with its case and its marks
    assert "contracted" not in plan(spark.createDataFrame([("a",)], "t string").select(polarity_parts(F.col("t"), scorer)))
