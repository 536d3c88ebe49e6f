"""Reports over a result table.  Each is one aggregation whose output is a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally import fixed_values as fixed

POSITIVE = ["Very Positive", "Positive"]
NEGATIVE = ["Negative", "Very Negative"]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 1)).otherwise(F.lit(0.0))


def label_distribution(df: DataFrame, label: str = "consumer_sentiment") -> DataFrame:
    """Rows and share per label.  The total is summed over the few label counts."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records"))
    total = F.sum("records").over(Window.partitionBy())
    return counts.select("label", "records", percent(F.col("records"), total).alias("pct"))


def zero_filled_summary(df: DataFrame, label: str = "consumer_sentiment") -> DataFrame:
    """The five labels in order, absent ones with zero; the share is of all rows.

    A sixth row, ``unscored``, holds the rows whose label is none of the five.
    """
    return summary_rows(df.agg(*aliased(summary_metrics(label))))


def aliased(metrics: dict[str, Column]) -> list[Column]:
    return [metric.alias(name) for name, metric in metrics.items()]


def summary_metrics(label: str = "consumer_sentiment") -> dict[str, Column]:
    known = F.col(label).isin(fixed.LABELS)
    return {
        "total": F.count(F.lit(1)),
        **{f"label_{i}": F.count_if(F.col(label) == name) for i, name in enumerate(fixed.LABELS)},
        f"label_{len(fixed.LABELS)}": F.count_if(~F.coalesce(known, F.lit(False))),
    }


def summary_rows(one: DataFrame) -> DataFrame:
    """The summary from one row of its metrics."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("label"),
                F.col(f"label_{i}").alias("records"),
                percent(F.col(f"label_{i}"), F.col("total")).alias("pct"),
            )
            for i, name in enumerate([*fixed.LABELS, "unscored"])
        ]
    )
    return one.select(F.inline(rows))


def buckets(df: DataFrame, label: str = "consumer_sentiment") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label).isin(POSITIVE)).alias("positive"),
        F.count_if(F.col(label) == "Neutral").alias("neutral"),
        F.count_if(F.col(label).isin(NEGATIVE)).alias("negative"),
    )


def kpis(df: DataFrame, wide: bool = False) -> DataFrame:
    """Total, mean and exact median score, trusted rows, overridden rows and their share.

    Scores are rounded to three decimals, so the exact median keeps a few
    thousand distinct values with their counts, whatever the number of rows.
    """
    return kpi_row(df.agg(*aliased(kpi_metrics(wide))))


def kpi_metrics(wide: bool = False) -> dict[str, Column]:
    score = F.col("consumer_score") / 10.0 if wide else F.col("consumer_score")
    return {
        "total": F.count(F.lit(1)),
        "mean_score": F.avg(score),
        "median_score": F.median(score),
        "high_confidence": F.count_if(F.col("confidence") > 0.7),
        "overridden": F.count_if(F.col("validation_source") == "Validation"),
    }


def kpi_row(one: DataFrame) -> DataFrame:
    """The report from one row of its metrics."""
    return one.select(*kpi_metrics(), percent(F.col("overridden"), F.col("total")).alias("overridden_pct"))


def executive_summary(df: DataFrame, label: str = "consumer_sentiment") -> DataFrame:
    one = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label).isin(POSITIVE)).alias("p"),
        F.count_if(F.col(label) == "Neutral").alias("n"),
        F.count_if(F.col(label).isin(NEGATIVE)).alias("m"),
        F.count_if(F.col("validation_source") == "Validation").alias("validated"),
    )

    def share(c: str) -> Column:
        return F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))

    mood = (
        F.when(share("p") >= 0.5, F.lit("positive"))
        .when(share("m") >= 0.4, F.lit("negative"))
        .otherwise(F.lit("mixed"))
    )
    return one.select(
        "total",
        share("p").alias("positive_share"),
        share("n").alias("neutral_share"),
        share("m").alias("negative_share"),
        "validated",
        mood.alias("mood"),
    )


def confidence_bands(df: DataFrame) -> DataFrame:
    from voxtally.functions.labels import confidence_band

    return df.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("records"))
