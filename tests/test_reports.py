from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.operators import audit, keyword_reports, reports
from voxtally.rules import Dictionary

RESULT = (
    "k int, Comments string, Text_For_Analysis string, consumer_score double, consumer_sentiment string, "
    "confidence double, validation_source string, _rule_fired string, _raw_vader double, Negative_Keywords string"
)


def result(spark):
    rows = [
        (0, "raw slow app", "slow app", -0.55, "Negative", 0.8, "Model", "rule:negative", None, "Slow"),
        (1, "raw slow and stuck", "slow and stuck", 0.35, "Positive", 1.0, "Validation", "validation", None, "slow; stuck"),
        (2, "fine", "fine", 0.1, "Neutral", 0.5, "Model", "vader", 0.1, ""),
        (3, "", "", None, "", 0.0, "Model", "blank", None, ""),
        (4, "x", "x", -0.6, "Negative", 0.7, "Model", "trigger:negative", None, ""),
        (5, "y", "y", 0.35, "Positive", 0.9, "Model", "bert:positive", 0.02, None),
    ]
    return spark.createDataFrame(rows, RESULT)


def test_summary_keeps_absent_labels_and_reports_unscored(spark):
    rows = reports.zero_filled_summary(result(spark)).orderBy("ordinal").collect()
    assert [(r["label"], r["records"], r["pct"]) for r in rows] == [
        ("Very Positive", 0, 0.0), ("Positive", 2, 33.3), ("Neutral", 1, 16.7),
        ("Negative", 2, 33.3), ("Very Negative", 0, 0.0), ("unscored", 1, 16.7),
    ]


def test_reports_of_an_empty_table(spark):
    empty = result(spark).limit(0)
    assert [r["pct"] for r in reports.zero_filled_summary(empty).collect()] == [0.0] * 6
    assert reports.executive_summary(empty).first()["mood"] == "mixed"
    assert reports.kpis(empty).first()["total"] == 0


def test_kpis(spark):
    row = reports.kpis(result(spark)).first()
    assert (row["total"], row["high_confidence"], row["overridden"], row["overridden_pct"]) == (6, 3, 1, 16.7)
    assert round(row["median_score"], 6) == 0.1 and round(row["mean_score"], 6) == -0.07


def test_triage(spark):
    rows = {r["bucket"]: r["records"] for r in audit.triage_counts(result(spark)).collect()}
    assert rows == {"validation": 1, "rule": 1, "lexicon": 1, "model": 1, "low_confidence": 1, "blank": 1, "other": 1}
    kept = audit.triage_filter(result(spark), "model", "Positive", "High").collect()
    assert [r["k"] for r in kept] == [5]


def test_evidence(spark):
    df = result(spark)
    assert [r["k"] for r in audit.evidence(df, search="STUCK").collect()] == [1]
    assert [r["k"] for r in audit.evidence(df, ["Negative"], ["Model"], "slow").collect()] == [0]
    assert [r["k"] for r in audit.evidence(df, search="raw", columns=["Comments", "absent"]).collect()] == [0, 1]
    assert audit.evidence(df).count() == 6
    assert audit.record_at(df, "k", 2).first()["Comments"] == "fine"


def test_lineage(spark):
    df = result(spark)
    steps = {r["k"]: [(s["step"], s["value"]) for s in r["l"]] for r in df.select("k", audit.lineage(df, "Comments").alias("l")).collect()}
    assert steps[1] == [
        ("Source text", "raw slow and stuck"),
        ("Text For Analysis", "slow and stuck"),
        ("Classification method", "validation"),
        ("Final score", "+0.3500"),
        ("Sentiment · Confidence", "Positive · 1.00"),
        ("Override", "Validation file — model output replaced"),
        ("Negative keywords", "slow; stuck"),
    ]
    assert steps[2] == [
        ("Source text", "fine"), ("Classification method", "vader"), ("VADER raw score", "+0.1000"),
        ("Final score", "+0.1000"), ("Sentiment · Confidence", "Neutral · 0.50"),
    ]
    assert steps[3][0] == ("Classification method", "blank")


def test_lineage_cuts_and_redacts(spark):
    long = spark.createDataFrame([(0, "a@b.org " + "x" * 300, "y", 0.0, "Neutral", 0.0, "Model", "blank", None, "")], RESULT)
    shown = long.select(audit.lineage(long, "Comments", redacted=True).alias("l")).first()["l"][0]["value"]
    assert shown.startswith("[EMAIL] x") and shown.endswith("…") and len(shown) == len("[EMAIL] ") + 292 + 1


def test_keyword_counts_ignore_spelling(spark):
    rows = {r["keyword"]: r["records"] for r in keyword_reports.keyword_frequency(result(spark)).collect()}
    assert rows == {"slow": 2, "stuck": 1}
    assert [r["keyword"] for r in keyword_reports.top_keywords(result(spark), 1).collect()] == ["slow"]


def test_categories(spark):
    dictionary = Dictionary.of({"speed_issues": ["slow", "stuck"], "none_here": ["zz"], "inner": ["tuck"]})
    df = result(spark)
    rows = [tuple(r) for r in keyword_reports.category_summary(df, dictionary).collect()]
    assert rows == [(0, "speed_issues", "Speed Issues", 2, 33.3), (2, "inner", "Inner", 1, 16.7)]
    mix = {r["category"]: r for r in keyword_reports.category_mix(df, dictionary).collect()}
    assert (mix["speed_issues"]["positive"], mix["speed_issues"]["negative"], mix["speed_issues"]["negative_pct"]) == (1, 1, 50.0)
    top = sorted(tuple(r) for r in keyword_reports.category_keywords(df, dictionary).collect())
    # "tuck" is always inside "stuck", so its category falls back to all keywords of its records
    assert top == [("inner", 1, "slow", 1), ("inner", 2, "stuck", 1), ("speed_issues", 1, "slow", 2), ("speed_issues", 2, "stuck", 1)]
    samples = sorted(tuple(r) for r in keyword_reports.category_samples(df, dictionary, "k", size=1, mark="*").collect())
    assert samples == [("inner", 1, 1, "slow and s*tuck*"), ("speed_issues", 1, 0, "*slow* app")]


def test_no_text_is_searched_twice(spark):
    dictionary = Dictionary.of({"speed_issues": ["slow", "stuck"], "inner": ["tuck"]})
    plan = keyword_reports.category_mix(result(spark), dictionary)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_group_limit_before_the_shuffle(spark):
    from conftest import SMALL

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    dictionary = Dictionary.of({"a": ["the"], "b": ["of"]})
    plan = keyword_reports.category_samples(df, dictionary, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_distribution(spark):
    rows = {r["label"]: (r["records"], r["pct"]) for r in reports.label_distribution(result(spark)).collect()}
    assert rows == {"Negative": (2, 33.3), "Positive": (2, 33.3), "Neutral": (1, 16.7), "": (1, 16.7)}
    assert reports.buckets(result(spark)).first().asDict() == {"positive": 2, "neutral": 1, "negative": 2}
    assert result(spark).select(F.sum("k")).first()[0] == 15
