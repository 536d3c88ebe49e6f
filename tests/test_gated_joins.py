"""Joins that only some rows ask for, lexicon tables, and places of rows in files."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from registered import fixtures as fx
from voxtally.operators.correction import correct_with_model
from voxtally.operators.lookups import gated_join
from voxtally.plans.analyze import analyze, texts_to_translate
from voxtally.sources.positions import PLACE_BITS, assign_row_key, file_order
from voxtally.sources.readers import load_overrides

PATHS = [(1 << 25, 1 << 25), (0, 1 << 25), (0, 0)]


def exchanges(df) -> list[str]:
    """Rows of the final plan that describe a shuffle, with the columns that cross it."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\n(?:Input \[\d+\]: )(.*)", plan)


@pytest.mark.parametrize("max_bytes, hit_bytes", PATHS)
def test_rows_that_ask_are_answered(spark, max_bytes, hit_bytes):
    left = spark.createDataFrame([(i, i % 3 == 0 if i % 5 else None, f"t{i}") for i in range(60)] + [(None, True, "n")], "k int, asks boolean, text string")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 60, 2)], "k int, v string")
    out = gated_join(left, right, "k", F.col("asks"), max_bytes, hit_bytes)
    assert out.columns == ["k", "asks", "text", "v"]
    found = {r.text: r.v for r in out.collect()}
    assert found == {f"t{i}": (f"v{i}" if i % 3 == 0 and i % 5 and i % 2 == 0 else None) for i in range(60)} | {"n": None}


@pytest.mark.parametrize("max_bytes, hit_bytes", PATHS)
def test_correction_is_the_same_on_every_path(spark, max_bytes, hit_bytes):
    columns = ["doc_id", "consumer_score", "consumer_sentiment", "confidence", "_rule_fired", "Text_For_Analysis"]
    plain = correct_with_model(fx.result(spark, SMALL), fx.predictions(spark, SMALL), "doc_id").select(*columns)
    other = correct_with_model(fx.result(spark, SMALL), fx.predictions(spark, SMALL), "doc_id", max_bytes, hit_bytes).select(*columns)
    assert sorted(plain.collect()) == sorted(other.collect())


def test_no_text_is_shuffled_for_predictions(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    result = analyze(documents, fx.PROFILE, "doc_id", "text", scorer=fx.SCORER)
    corrected = correct_with_model(result, fx.predictions(spark, SMALL), "doc_id", max_bytes=0)
    assert not [x for x in exchanges(corrected) if "text" in x.lower()]


@pytest.mark.parametrize("profile, text", [(fx.PROFILE, "text"), (fx.PIPE_PROFILE, "chat"), (fx.REVIEW_PROFILE, "text")])
@pytest.mark.parametrize("literal, hits", [(1 << 20, 1 << 25), (0, 1 << 25), (0, 0)])
def test_lexicon_tables_score_like_literals(spark, profile, text, literal, hits):
    said = F.concat(F.lit("2024-01-01 Consumer:"), F.replace(F.col("text"), F.lit("|"), F.lit("/")))
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("chat", said)
    common = {"scorer": fx.SCORER, "language_column": "lang", "row_key": "doc_id"}
    plain = analyze(rows, profile, "doc_id", text, **common)
    table = analyze(rows, profile, "doc_id", text, lexicon=fx.lexicon(spark), max_literal_bytes=literal, max_broadcast_bytes=hits, **common)
    assert table.columns == plain.columns
    columns = ["doc_id", "consumer_score", "confidence", "consumer_sentiment", "_rule_fired"]
    assert sorted(table.select(*columns).collect(), key=lambda r: r.doc_id) == sorted(plain.select(*columns).collect(), key=lambda r: r.doc_id)


def test_a_joined_lexicon_needs_a_row_key(spark):
    rows = spark.createDataFrame([("1", "good")], "ID string, Comments string")
    with pytest.raises(ValueError, match="row_key"):
        analyze(rows, "review", lexicon=fx.lexicon(spark), max_literal_bytes=0)


def small_splits(spark, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_splits(spark, size)
    for key, value in held.items():
        spark.conf.set(key, value)


def two_files(spark, tmp_path, kind):
    """A short file that sorts first and a long one; ids repeat across both."""
    def lines(name, rows):
        if kind == "csv":
            (tmp_path / name).write_text("ID,Actual Sentiment\n" + "".join(f"{i},{label}\n" for i, label in rows))
        elif kind == "json":
            (tmp_path / name).write_text("".join(f'{{"ID": {i}, "Actual Sentiment": "{label}"}}\n' for i, label in rows))
        else:
            spark.createDataFrame(rows, "ID int, `Actual Sentiment` string").coalesce(1).write.parquet(str(tmp_path / name))
    rows = [(i % 7, f"a{i}") for i in range(20)], [(i % 5, f"b{i}") for i in range(400)]
    lines("a." + kind, rows[0])
    lines("b." + kind, rows[1])
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    paths = [f"{tmp_path}/a.{kind}", f"{tmp_path}/b.{kind}"]
    df = {"csv": lambda: reader.schema("ID int, `Actual Sentiment` string").csv(paths), "json": lambda: reader.json(paths), "parquet": lambda: reader.parquet(*paths)}[kind]()
    return df, [*rows[0], *rows[1]]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_rows_count_in_the_order_of_their_files(spark, tmp_path, splits, kind):
    splits(200)
    df, rows = two_files(spark, tmp_path, kind)
    if kind != "parquet":
        assert df.rdd.getNumPartitions() > 10
    last = {str(i): label for i, label in rows}
    assert {r._id_norm: r.override_label for r in load_overrides(df).collect()} == last
    ordered = [r["Actual Sentiment"] for r in df.withColumn("o", file_order(df)).orderBy("o").collect()]
    assert ordered == [label for _, label in rows]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_row_keys_are_stable_and_need_no_copy(spark, tmp_path, splits, kind):
    splits(200)
    df, rows = two_files(spark, tmp_path, kind)
    keyed = assign_row_key(df)
    assert keyed.columns == [*df.columns, "row_key"]
    one, two = ({r.row_key: r["Actual Sentiment"] for r in assign_row_key(df).collect()} for _ in range(2))
    assert one == two and len(one) == len(rows)
    assert [one[k] for k in sorted(one)] == [label for _, label in rows]
    assert {k >> PLACE_BITS for k in one} == {0, 1}
    assert "FileScan" in keyed._jdf.queryExecution().executedPlan().toString()  # no copy that is read instead


def test_tables_without_files_are_written_once(spark):
    keyed = assign_row_key(spark.range(50).repartition(5))
    assert len({r.row_key for r in keyed.collect()}) == 50
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "ID int, `Actual Sentiment` string").coalesce(1)
    assert load_overrides(rows).first().override_label == "b"


def test_translations_by_text_and_by_row_are_the_same(spark):
    """Reviews repeat: each routed text is asked for once, and gets its translation in every row."""
    spanish = "el servicio es muy malo y la aplicación no funciona"
    rows = [(i, spanish if i % 3 else f"la comida {i} es buena y el hotel está limpio") for i in range(30)] + [(30, "all is well here"), (31, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    routed = texts_to_translate(df, "t")
    found = {r.text: (r.lang, r.records) for r in routed.collect()}
    assert found[spanish] == ("es", 20) and len(found) == 11 and all(lang == "es" for lang, _ in found.values())
    by_text = routed.select("text", F.concat(F.lit("translated "), "text").alias("translated"))
    by_row = df.where("k < 30").select(F.col("k").alias("row_key"), F.concat(F.lit("translated "), "t").alias("translated"))
    outs = []
    for translations, more in ((by_text, {}), (by_row, {"row_key": "k"})):
        for max_bytes in (1 << 25, 0):
            out = analyze(df, fx.REVIEW_PROFILE, "k", "t", scorer=fx.SCORER, translations=translations, max_broadcast_bytes=max_bytes, **more)
            outs.append({r.k: (r.Translated_Text, r.consumer_score) for r in out.collect()})
    assert all(out == outs[0] for out in outs)
    assert outs[0][1][0] == "translated " + spanish and outs[0][30][0] == "" and outs[0][31][0] == ""


def test_rows_that_ask_are_cleaned_once(spark):
    """A filter over cleaned reviews does not repeat the cleaning for each mention of them."""
    from voxtally.plans.analyze import texts_to_translate

    rows = spark.createDataFrame([(1, "la casa de la niña"), (2, "the house"), (3, None), (4, "la casa de la niña")], "doc_id int, text string")
    routed = texts_to_translate(rows, "text")
    assert routed._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1
    assert [(r.text, r.lang, r.records) for r in routed.collect()] == [("la casa de la niña", "es", 2)]
