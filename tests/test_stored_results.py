"""A stored analysis: reports observed while it was written, filters that reach the scan."""

from __future__ import annotations

import pytest
from conftest import SMALL

from registered import fixtures as fx
from voxtally.operators import audit, reports
from voxtally.sources.sinks import store_analysis


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stored')}/result"
    result = fx.result(spark, SMALL)
    return result, store_analysis(result, path), spark.read.parquet(path)


def test_observed_reports_are_those_of_the_result(stored):
    result, observed, _ = stored
    one, two = observed.kpis().first().asDict(), reports.kpis(result).first().asDict()
    assert one == pytest.approx(two) and list(one) == list(two)
    assert observed.triage_counts().collect() == audit.triage_counts(result).collect()
    assert observed.summary().collect() == reports.zero_filled_summary(result).collect()


def test_observed_reports_of_an_empty_result(spark, tmp_path):
    empty = fx.result(spark, SMALL).limit(0)
    observed = store_analysis(empty, f"{tmp_path}/empty")
    row = observed.kpis().first()
    assert (row.total, row.mean_score, row.median_score, row.overridden_pct) == (0, None, None, 0.0)


@pytest.mark.parametrize("bucket", [*audit.TRIAGE_LABELS, None])
@pytest.mark.parametrize("band", ["High", "Medium", "Low", None])
def test_stored_filters_give_the_rows_of_the_lazy_ones(stored, bucket, band):
    result, _, table = stored
    assert audit.is_stored(table) and not audit.is_stored(result)
    one, two = (sorted(r.doc_id for r in audit.triage_filter(df, bucket, None, band).select("doc_id").collect()) for df in (result, table))
    assert one == two


def test_filters_reach_the_scan(stored):
    _, _, table = stored
    found = audit.evidence(audit.triage_filter(table, "rule", "Negative", "High"), sources=["Model"], search="of the")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(validation_source" in plan or "PartitionFilters: [(validation_source" in plan
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(part in pushed for part in ("in_rule", "consumer_sentiment", "confidence"))
    assert "Generate" not in plan
