"""Audit: triage buckets, evidence search, confidence filters and record lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.common import and_all, or_all, strip, text_or_empty
from voxtally.functions.labels import in_band
from voxtally.functions.text import redact, shorten
from voxtally.operators.reports import aliased, percent

TRIAGE_LABELS = {
    "validation": "Validation Overrides",
    "rule": "Rule-fired",
    "lexicon": "VADER",
    "model": "BERT Corrections",
    "low_confidence": "Low Confidence",
    "blank": "Blank / Unscored",
    "other": "Other",
}


def triage_flags() -> dict[str, Column]:
    """Six overlapping tests, and ``other`` for the rows that pass none of them."""
    rule, source = F.col("_rule_fired"), F.col("validation_source")
    six = {
        "validation": source == "Validation",
        "rule": F.startswith(rule, F.lit("rule:")),
        "lexicon": rule == "vader",
        "model": F.startswith(rule, F.lit("bert:")),
        "low_confidence": (F.col("confidence") < 0.3) & (source == "Model"),
        "blank": rule.isin("blank", "non_english"),
    }
    sure = {name: F.coalesce(test, F.lit(False)) for name, test in six.items()}
    return {**sure, "other": ~or_all(list(sure.values()))}


def with_triage(df: DataFrame) -> DataFrame:
    return df.select("*", *[test.alias("in_" + name) for name, test in triage_flags().items()])


def is_stored(df: DataFrame) -> bool:
    """Whether the table holds its triage flags, as a stored analysis does."""
    return all("in_" + name in df.columns for name in TRIAGE_LABELS)


def _rows_that(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """The rows that pass all tests.

    Over a table stored by ``sources.sinks.store_analysis`` the tests are plain filters, which reach the scan.
    Over a lazy result the verdict goes through a generator: a filter over computed columns
    would be pushed below them and repeat the analysis inside the filter.
    """
    if not tests:
        return df
    if is_stored(df):
        return df.where(and_all(tests))
    passed = and_all([F.coalesce(test, F.lit(False)) for test in tests])
    return df.withColumn("_passed", F.explode_outer(F.array(passed))).where("_passed").drop("_passed")


def triage_filter(
    df: DataFrame, bucket: str | None = None, label: str | None = None, band: str | None = None
) -> DataFrame:
    tests = []
    if bucket:
        tests.append(F.col("in_" + bucket) if is_stored(df) else triage_flags()[bucket])
    if label:
        tests.append(F.col("consumer_sentiment") == label)
    if band:
        tests.append(in_band(F.col("confidence"), band))
    return _rows_that(df, tests)


def triage_counts(df: DataFrame) -> DataFrame:
    """Rows and share per bucket; the buckets overlap, so one pass counts them side by side."""
    return triage_rows(df.agg(*aliased(triage_metrics())))


def triage_metrics() -> dict[str, Column]:
    return {"total": F.count(F.lit(1)), **{"in_" + name: F.count_if(test) for name, test in triage_flags().items()}}


def triage_rows(one: DataFrame) -> DataFrame:
    """The counts from one row of their metrics."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("bucket"),
                F.col("in_" + name).alias("records"),
                percent(F.col("in_" + name), F.col("total")).alias("pct"),
            )
            for i, name in enumerate(TRIAGE_LABELS)
        ]
    )
    return one.select(F.inline(rows))


def evidence(
    df: DataFrame,
    labels: Sequence[str] = (),
    sources: Sequence[str] = (),
    search: str = "",
    columns: Sequence[str] = ("Negative_Keywords", "Text_For_Analysis"),
) -> DataFrame:
    """Rows with one of the labels, one of the sources and the literal text in any column."""
    tests = []
    if labels:
        tests.append(F.col("consumer_sentiment").isin(list(labels)))
    if sources:
        tests.append(F.col("validation_source").isin(list(sources)))
    wanted = search.strip().lower()
    if wanted:
        present = [c for c in columns if c in df.columns]
        tests.append(or_all([F.contains(F.lower(text_or_empty(F.col(c))), F.lit(wanted)) for c in present]))
    return _rows_that(df, tests)


def record_at(df: DataFrame, row_key: str, value) -> DataFrame:
    return df.where(F.col(row_key) == value)


def lineage(df: DataFrame, text: str, redacted: bool = False) -> Column:
    """``array<struct<step, value>>``: how the row of a result table came to its label."""

    def shown(column: Column) -> Column:
        # the text is cut first, as it is shown; the mark tells that more follows
        head = F.substring(column, 1, 300)
        head = redact(head) if redacted else head
        return F.concat(head, F.when(F.length(column) > 300, F.lit("…")).otherwise(F.lit("")))

    def step(when: Column, name: Column | str, value: Column) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        return F.when(when, F.struct(label.alias("step"), value.alias("value")))

    raw = text_or_empty(F.col(text))
    always = F.lit(True)
    extracted = F.lit(None).cast("struct<step:string,value:string>")
    for name in reversed([c for c in ("CustomerOnly", "ConsumerOnly", "Text_For_Analysis") if c in df.columns]):
        column = text_or_empty(F.col(name))
        extracted = F.when(
            (strip(column) != "") & (column != raw),
            F.struct(F.lit(name.replace("_", " ")).alias("step"), shown(column).alias("value")),
        ).otherwise(extracted)

    score = F.coalesce(F.col("consumer_score"), F.lit(0.0))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    return F.array_compact(
        F.array(
            step(strip(raw) != "", "Source text", shown(raw)),
            extracted,
            step(always, "Classification method", F.col("_rule_fired")),
            step(
                F.col("_raw_vader").isNotNull() & ~F.isnan("_raw_vader"),
                "VADER raw score",
                F.format_string("%+.4f", F.col("_raw_vader")),
            ),
            step(always, "Final score", F.format_string("%+.4f", score)),
            step(
                always,
                "Sentiment · Confidence",
                F.concat(F.col("consumer_sentiment"), F.lit(" · "), F.format_string("%.2f", confidence)),
            ),
            step(
                F.col("validation_source") == "Validation",
                "Override",
                F.lit("Validation file — model output replaced"),
            ),
            step(
                strip(text_or_empty(F.col("Negative_Keywords"))) != "",
                "Negative keywords",
                F.col("Negative_Keywords"),
            ),
        )
    )


def sample_text(column: Column, redacted: bool = False, limit: int = 220) -> Column:
    return shorten(redact(column) if redacted else column, limit)
