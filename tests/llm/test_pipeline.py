"""The stages of the pipeline, each against what it may do to its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from llm_rows import docs, texts  # noqa: F401
from test_documents import plain_components, plain_measures, plain_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": rows.collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, FOLDER).collect(), stage_schema(spark, name, rows))
        out[name] = rows.collect()
    return out


def stage_schema(spark, name, rows):
    last = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long, queue string"
    return last if name == corpus_pipeline.STAGES[-1][0] else rows.schema


def test_quality_keeps_what_passes(stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    for r in stages["documents"]:
        words, chars, symbols, _, repeated = plain_measures(r.text)
        if words < 10 or 100 * repeated > 20 * words or 10 * symbols > words:
            assert r.doc_id not in kept
    assert len(kept) > 0.7 * len(stages["documents"])


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages["toxicity"]]
    assert {r.doc_id for r in stages["near_duplicates"]} == {i for i, _, c in plain_components(before) if i == c}


def test_one_row_of_each_group_stays(spark, docs, texts):  # noqa: F811
    """Rows that repeat, copies that share an id and copies without one: one row a group; texts without words all stay."""
    words = texts[0][1].split(" ")
    more = [(1, " ".join([*words[:30], "other", *words[31:]])), (None, texts[0][1]), (20, texts[11][1]), (None, texts[11][1])]
    source = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("label", F.lit("x"))
    every = [*texts, *more]
    blank = Counter((i, t) for i, t in every if not (t or "").split())
    plain = plain_components([(n, t) for n, (_, t) in enumerate(every)])
    label = {n: c for n, _, c in plain}
    stays: dict = {}
    for n, (i, t) in enumerate(every):
        if (t or "").split():
            best = stays.get(label[n])
            stays[label[n]] = min(x for x in (best, (i is not None, i or 0)) if x is not None)
    rows = corpus_pipeline.near_duplicates(spark, source, FOLDER).collect()
    assert Counter((r.doc_id, r.text) for r in rows if not (r.text or "").split()) == blank
    assert Counter((r.doc_id is not None, r.doc_id or 0) for r in rows if (r.text or "").split()) == Counter(stays.values())


def test_repeats_go(stages):
    before = [(r.doc_id, r.text) for r in stages["near_duplicates"]]
    after = Counter({k: n for k, n in plain_repeats(before).items() if k[1]})
    assert Counter((r.doc_id, r.text) for r in stages["repeated_passages"]) == after
    assert all(r.n_chars == len(r.text) for r in stages["repeated_passages"])


def test_all_that_stays_is_packed(stages):
    assert {r.doc_id for r in stages["packing"]} == {r.doc_id for r in stages["repeated_passages"]}
    end = 0
    for r in sorted(stages["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == end
        end += r.length


def test_odd_rows_pass_through_every_stage(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    assert corpus_pipeline.packing(spark, docs, FOLDER).count() >= docs.count()
