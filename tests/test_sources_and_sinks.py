from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxtally import analyze
from voxtally.functions.lexicon import Scorer
from voxtally.operators.polarity import score_polarity
from voxtally.rules import PROFILE_NAMES
from voxtally.sources import readers, sinks
from voxtally.streaming.incremental import append_results


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('ID,Comments\n1,"two\nlines, ""quoted"""\n2,plain\n')
    df = readers.read_conversations(spark, str(path))
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    fixed = readers.read_conversations(spark, str(path), schema="ID string, Comments string")
    assert fixed.dtypes == [("ID", "string"), ("Comments", "string")]


def test_parquet_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "ID int, Comments string")
    for kind in ("parquet", "json"):
        getattr(df.write, kind)(str(tmp_path / f"t.{kind}"))
        assert readers.read_conversations(spark, str(tmp_path / f"t.{kind}")).select("ID", "Comments").collect()[0][1] == "x"
    with pytest.raises(ValueError):
        readers.read_conversations(spark, "book.xlsx")


def test_preview_and_required_columns(spark):
    df = spark.createDataFrame([(i, str(i), 0) for i in range(9)], "ID int, Comments string, z int")
    assert [r["ID"] for r in readers.preview(df, "ID", "Comments").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(df, ["ID", "missing"])


def test_overrides_last_row_wins(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("note,Ticket_ID, Actual Sentiment \na, 1 2 ,Positive\nb,12,Negative\nc,3,\nd,4,  \n")
    loaded = readers.load_overrides(spark.read.option("header", True).csv(str(path)))
    assert [tuple(r) for r in loaded.collect()] == [("12", "Negative")]
    with pytest.raises(ValueError):
        readers.load_overrides(spark.createDataFrame([(1,)], "x int"))


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("good\t1.9\t0.9\t[2, 1]\nbad\t-2.5\t0.6\t[-3]\n:-\"\t0.4\t1\t[1]\nlone\n")
    table = readers.load_lexicon(spark, str(path))
    assert {tuple(r) for r in table.collect()} == {("good", 19), ("bad", -25), (':-"', 4)}
    df = spark.createDataFrame([(1, "bad")], "k int, t string")
    assert score_polarity(df, "k", "t", table, Scorer()).first()["polarity"] == round(-2.5 / (6.25 + 15) ** 0.5, 4)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "the app is slow, not working"), (2, "it is good, good")], "ID int, Comments string")
    result = analyze(df, "pipe_or_plain")
    sinks.write_report(result, str(tmp_path / "report"))
    back = {n: spark.read.option("header", True).csv(str(tmp_path / "report" / n)) for n in ("results", "summary", "keywords")}
    assert back["results"].count() == 2 and back["results"].columns == result.columns
    assert back["summary"].count() == 6
    assert [tuple(r) for r in back["keywords"].collect()] == [("not working", "1")]
    sinks.write_result(result, str(tmp_path / "table"), partition_by="validation_source")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_spread_only_when_needed(spark):
    few = spark.range(100).repartition(1)
    many = spark.range(100).repartition(500)
    assert readers.spread(few).rdd.getNumPartitions() > 1
    assert readers.spread(many) is many


def test_streaming_gives_the_batch_result(spark, tmp_path):
    schema = "ID int, Comments string"
    rows = [(i, t) for i, t in enumerate(["app not working", "how do i pay", "lovely and good", None] * 5)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    labels = spark.createDataFrame([("3", "Positive")], "_id_norm string, override_label string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = append_results(
            stream, str(tmp_path / "out"), str(tmp_path / "state"), "pipe_or_plain", overrides=labels
        )
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = analyze(spark.createDataFrame(rows, schema), "pipe_or_plain", overrides=labels)
    order = [F.col(c) for c in want.columns]
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", PROFILE_NAMES)
def test_no_helper_column_is_left(spark, name):
    """Input columns, then the fixed additions and nothing else."""
    additions = {
        "_id_norm", "Text_For_Analysis", "consumer_score", "consumer_sentiment", "confidence", "validation_source", "_rule_fired", "_raw_vader",
        "Negative_Keywords", *{"pipe_chat": ("ConsumerOnly", "Language"), "review": ("Cleaned_Comments", "Translated_Text")}.get(name, ("CustomerOnly",)),
    }
    df = spark.createDataFrame([("1", "it is good", "x")], "ID string, Comments string, other string")
    out = analyze(df, name, "ID", "Comments")
    assert out.columns[:3] == df.columns and set(out.columns[3:]) == additions and len(out.columns) == 3 + len(additions)
