"""Profiles end to end, with expected values worked out by hand from the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxtally import analyze, default_profile
from voxtally.functions.lexicon import Scorer
from voxtally.sources.positions import assign_row_key

COLUMNS = ["consumer_score", "consumer_sentiment", "confidence", "validation_source", "_rule_fired"]


def said(text):
    return f"<b>10:00:01 Agent:</b> hello <br/><b>10:00:02 Dana:</b> {text} <br/>"


def run(spark, profile, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ID int, Comments string")
    rows = analyze(df, profile, "ID", "Comments", **options).orderBy("ID").collect()
    return [tuple(r[c] for c in COLUMNS) for r in rows], rows


def overrides(spark, pairs):
    return spark.createDataFrame(pairs, "_id_norm string, override_label string")


def test_tagged_chat_tiers(spark):
    got, rows = run(
        spark,
        "tagged_chat",
        [
            said("this is the worst experience, thanks"),
            said("you exceeded expectations"),
            said("thanks, that is great"),
            said("terrible, thanks"),
            said("the agent was rude to me"),
            said("payment is pending, okay"),
            said("I am annoyed now"),
            said("how do i log in"),
            said("talk to agent"),
            None,
            said("the green chair"),
        ],
    )
    assert got[:10] == [
        (-0.85, "Very Negative", 0.95, "Model", "rule:very_negative"),
        (0.85, "Very Positive", 0.95, "Model", "rule:very_positive"),
        (0.75, "Very Positive", 0.90, "Model", "rule:positive_strong"),
        (0.35, "Positive", 0.80, "Model", "rule:positive"),
        (-0.7, "Very Negative", 0.95, "Model", "rule:strong_negative"),
        (0.0, "Neutral", 0.75, "Model", "rule:neutral_resolved"),
        (-0.55, "Negative", 0.80, "Model", "rule:negative"),
        (0.0, "Neutral", 0.80, "Model", "rule:neutral"),
        (0.0, "Neutral", 0.0, "Model", "blank"),
        (0.0, "Neutral", 0.0, "Model", "blank"),
    ]
    assert got[10] == (0.0, "Neutral", 0.5, "Model", "vader") and rows[10]["_raw_vader"] == 0.0
    assert all(r["_raw_vader"] is None for r in rows[:10])
    assert rows[0]["Negative_Keywords"] == "worst"


def test_substring_matching_is_kept(spark):
    got, _ = run(spark, "tagged_chat", [said("my issue is open"), said("the city centre")])
    assert [g[4] for g in got] == ["rule:very_negative", "rule:positive"]


def test_blend_above_the_threshold(spark):
    scorer = Scorer(lexicon={"pending": 20})
    got, rows = run(spark, "tagged_chat", [said("payment is pending, okay")], rule_threshold=0.75, scorer=scorer)
    raw = round(2.0 / (4 + 15) ** 0.5, 4)
    assert rows[0]["_raw_vader"] == pytest.approx(raw)
    assert got[0] == (round(raw * 0.25, 3), "Neutral", 0.5, "Model", "rule:neutral_resolved")


def test_overrides_win_and_unknown_labels_score_zero(spark):
    got, _ = run(
        spark,
        "tagged_chat",
        [said("terrible thing"), said("terrible thing"), None],
        overrides=overrides(spark, [("0", "Very Positive"), ("1", "mixed"), ("2", "Negative")]),
    )
    assert got == [
        (0.85, "Very Positive", 1.0, "Validation", "validation"),
        (0.0, "Neutral", 1.0, "Validation", "validation"),
        (-0.55, "Negative", 1.0, "Validation", "validation"),
    ]


def test_bracket_chat(spark):
    texts = [f"[10:00:02 CUSTOMER]: {t}" for t in (
        "what an amazing crew", "thanks, perfect day", "great reply", "without my permission again",
        "angry, got it", "so frustrated with it", "please refund me", "thank you all",
    )]
    got, _ = run(spark, "bracket_chat", texts)
    assert [(g[0], g[2], g[4]) for g in got] == [
        (0.85, 0.90, "rule:very_positive"),
        (0.85, 0.90, "rule:very_positive"),
        (0.40, 0.80, "rule:positive"),
        (-0.65, 0.95, "rule:strong_negative"),
        (0.0, 0.75, "rule:neutral_resolved"),
        (-0.60, 0.80, "rule:negative"),
        (0.0, 0.80, "rule:neutral"),
        (0.361, 0.5, "vader"),  # the name "you" is stripped, which leaves "thank all"
    ]


def test_pipe_or_plain(spark):
    got, _ = run(spark, "pipe_or_plain", ["my account locked me out", "there is a problem, ok", "angry customer here",
                                          "x | Customer: how do i pay", "lovely day today"])
    assert [(g[0], g[2], g[4]) for g in got[:4]] == [
        (-0.70, 0.95, "rule:strong_negative"),
        (0.0, 0.75, "rule:neutral_resolved"),
        (-0.55, 0.80, "rule:negative"),
        (0.0, 0.80, "rule:neutral"),
    ]
    assert got[4][4] == "vader"


def test_pipe_chat_and_signed_correction(spark):
    texts = ["Consumer: a problem with it", "Consumer: please refund me", "Consumer: the chair", "no marker", "Consumer: the table"]
    got, rows = run(spark, "pipe_chat", texts, overrides=overrides(spark, [("4", "Positive")]))
    assert got == [
        (-0.6, "Negative", 0.7, "Model", "trigger:negative"),
        (0.0, "Neutral", 0.7, "Model", "trigger:neutral"),
        (0.0, "Neutral", 0.7, "Model", "vader"),
        (None, "", 0.0, "Model", "blank"),
        (0.35, "Positive", 1.0, "Validation", "validation"),
    ]
    assert [r["Language"] for r in rows] == ["en", "en", "en", "non-en", "en"]
    predictions = spark.createDataFrame(
        [(0, "NEGATIVE", 0.9), (1, "NEGATIVE", 0.6), (2, "POSITIVE", 0.55), (3, "POSITIVE", 0.9), (4, "NEGATIVE", 0.9)],
        "row_key int, label string, score double",
    )
    corrected, _ = run(
        spark, "pipe_chat", texts, overrides=overrides(spark, [("4", "Positive")]), predictions=predictions, row_key="ID"
    )
    assert corrected == [
        (-0.6, "Negative", 0.7, "Model", "trigger:negative"),
        # score, label and rule are restored, the confidence of the prediction stays
        (0.0, "Neutral", 0.6, "Model", "trigger:neutral"),
        (0.55, "Positive", 0.55, "Model", "bert:positive"),
        (None, "", 0.0, "Model", "blank"),
        (0.35, "Positive", 1.0, "Validation", "validation"),
    ]


def test_language_gate(spark):
    df = spark.createDataFrame([(0, "Consumer: un problem", "fr")], "ID int, Comments string, lang string")
    row = analyze(df, "pipe_chat", "ID", "Comments", language_column="lang").first()
    assert (row["Language"], row["_rule_fired"], row["consumer_score"], row["consumer_sentiment"]) == (
        "non-en", "non_english", None, "",
    )


def test_model_correction(spark):
    predictions = spark.createDataFrame(
        [(0, "POSITIVE", 0.76), (1, "NEGATIVE", 0.75), (2, "NEGATIVE", 0.9), (3, "NEGATIVE", 0.8123), (4, "POSITIVE", 0.9)],
        "row_key int, label string, score double",
    )
    texts = [said("the green chair"), said("the green chair"), said("I am annoyed now"), said("the red chair"), None]
    got, _ = run(spark, "tagged_chat", texts, predictions=predictions, row_key="ID")
    assert got == [
        (0.35, "Positive", 0.76, "Model", "bert:positive"),
        (0.0, "Neutral", 0.5, "Model", "vader"),
        (-0.55, "Negative", 0.8, "Model", "rule:negative"),
        (-0.35, "Negative", 0.812, "Model", "bert:negative"),
        (0.0, "Neutral", 0.0, "Model", "blank"),
    ]


def test_review(spark):
    texts = ["n/a", None, "excellent and amazing stay", "Terrible room, the worst!"]
    got, rows = run(spark, "review", texts, overrides=overrides(spark, [("1", "odd label")]))
    assert got[0] == (0.0, "Neutral", 0.0, "Model", "blank")
    assert got[1] == (0.0, "odd label", 1.0, "Validation", "validation")
    assert got[2][1] == "Very Positive" and got[2][4] == "hybrid" and 5 <= got[2][0] <= 10
    assert got[3][1] == "Very Negative" and -10 <= got[3][0] < -3
    assert all(0.3 <= g[2] <= 0.95 for g in got[2:])
    assert rows[3]["Negative_Keywords"] == "Terrible; worst" and rows[3]["_raw_vader"] is None


def test_review_translations(spark):
    translations = spark.createDataFrame([(0, "excellent"), (1, "excellent"), (2, "excellent")], "row_key int, translated string")
    _, rows = run(spark, "review", ["está muy bien todo", "fine by me", "n/a"], translations=translations, row_key="ID")
    assert [r["Translated_Text"] for r in rows] == ["excellent", "", ""]
    assert [r["Text_For_Analysis"] for r in rows] == ["excellent", "fine by me", "n/a"]


def test_input_columns_stay_and_keys_are_checked(spark):
    df = spark.createDataFrame([(1, "x", "hello there you")], "ID int, extra string, Comments string")
    out = analyze(df, default_profile("pipe_or_plain"))
    assert out.columns[:4] == ["ID", "extra", "Comments", "_id_norm"]
    with pytest.raises(ValueError):
        analyze(df, "pipe_or_plain", text_column="missing")
    with pytest.raises(ValueError):
        analyze(df, "pipe_or_plain", predictions=df)


def test_row_keys_are_stable(spark):
    keyed = assign_row_key(spark.range(100).repartition(7).withColumn("t", F.lit("x")))
    first, second = keyed.collect(), keyed.collect()
    assert first == second and len({r["row_key"] for r in first}) == 100


def test_all_profiles_are_map_only_without_lookups(spark):
    df = spark.createDataFrame([("1", "hello")], "ID string, Comments string")
    for name in ("tagged_chat", "bracket_chat", "pipe_chat", "pipe_or_plain", "review"):
        plan = analyze(df, name, "ID", "Comments")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert ("ArrowEvalPython" in plan) == (name == "review")
        assert "BatchEvalPython" not in plan


def test_broadcast_only_below_the_measured_size(spark):
    df = spark.createDataFrame([("1", "hello"), ("1", "there")], "ID string, Comments string")
    labels = overrides(spark, [("1", "Positive")])
    small = analyze(df, "pipe_or_plain", overrides=labels)._jdf.queryExecution().optimizedPlan().toString()
    large = analyze(df, "pipe_or_plain", overrides=labels, max_broadcast_bytes=1)
    assert "strategy=broadcast" in small
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert [r["_rule_fired"] for r in large.collect()] == ["validation", "validation"]


def test_same_answer_whatever_the_partitions(spark):
    from conftest import SMALL

    from registered import fixtures as fx

    seen = []
    for partitions in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            seen.append(sorted(map(str, fx.result(spark, SMALL).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_properties_of_the_result(spark):
    from conftest import SMALL

    from registered import fixtures as fx
    from voxtally.operators.audit import with_triage

    rows = with_triage(fx.result(spark, SMALL)).collect()
    assert all(-1 <= r["consumer_score"] <= 1 and 0 <= r["confidence"] <= 1 for r in rows)
    assert all(any(r[c] for c in r.asDict() if c.startswith("in_")) for r in rows)
    for r in rows:
        for k in filter(None, r["Negative_Keywords"].split("; ")):
            assert k in r["Text_For_Analysis"]
