"""Writing result tables and the three-table report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.audit import triage_metrics, triage_rows, with_triage

from voxtally.operators.keyword_reports import keyword_frequency
from voxtally.operators.reports import aliased, kpi_metrics, kpi_row, summary_metrics, summary_rows, zero_filled_summary


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with headers, written in parallel."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_result(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The result table as Parquet; the reports read it back instead of scoring again."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


@dataclass(frozen=True)
class Observed:
    """Reports over an analysis, from metrics taken while it was written: no report reads the result again."""

    spark: SparkSession
    metrics: dict[str, int | float | None]

    def _row(self) -> DataFrame:
        kinds = ", ".join(f"{name} {'double' if name.endswith('_score') else 'bigint'}" for name in self.metrics)
        return self.spark.createDataFrame([tuple(self.metrics.values())], kinds)

    def kpis(self) -> DataFrame:
        return kpi_row(self._row())

    def triage_counts(self) -> DataFrame:
        return triage_rows(self._row())

    def summary(self) -> DataFrame:
        return summary_rows(self._row())


def store_analysis(result: DataFrame, path: str, wide: bool = False) -> Observed:
    """Writes the result with its triage flags, a folder for each ``validation_source``, and observes its reports.

    Filters over the stored table (``triage_filter``, ``evidence``) reach the scan: the source chooses folders,
    flags, labels and confidence are pushed to Parquet.  ``wide`` is for scores from -10 to 10.
    """
    observation = Observation()
    metrics = kpi_metrics(wide) | triage_metrics() | summary_metrics()
    write_result(with_triage(result.observe(observation, *aliased(metrics))), path, "validation_source")
    found = observation.get
    return Observed(result.sparkSession, {name: found[name] for name in metrics})


def report_tables(result: DataFrame) -> dict[str, DataFrame]:
    return {
        "results": result,
        "summary": zero_filled_summary(result),
        "keywords": keyword_frequency(result).orderBy(F.desc("records"), "keyword"),
    }


def write_report(result: DataFrame, path: str) -> None:
    """``results``, ``summary`` and ``keywords`` under one path."""
    for name, table in report_tables(result).items():
        write_csv(table, f"{path}/{name}")
