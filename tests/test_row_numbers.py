"""Row numbers of tables in several files, against the order of the files."""

from __future__ import annotations

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from registered.queries import ORACLES, QUERIES
from voxtally.sources.positions import number_rows


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_numbers_go_on_from_file_to_file(spark, tmp_path, kind):
    for i, n in enumerate((3, 0, 5, 1)):
        spark.range(i * 10, i * 10 + n, 1, 1).write.format(kind).save(f"{tmp_path}/{i}")
    paths = [f"{tmp_path}/{i}" for i in range(4)]
    df = spark.read.schema("id long").format(kind).load(paths)
    rows = [0, 1, 2, 20, 21, 22, 23, 24, 30]
    assert sorted((r.n, r.id) for r in number_rows(df, "n").collect()) == list(enumerate(rows))


def test_numbers_of_tables_without_files_have_no_gaps(spark):
    numbered = number_rows(spark.range(50).repartition(5), "n").collect()
    assert sorted(r.n for r in numbered) == list(range(50)) and len({r.id for r in numbered}) == 50


def test_query_over_several_files_repeated_and_null_ids(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (None,), (2,), (None,)], "doc_id long").coalesce(1)
    for i in range(3):
        rows.withColumn("doc_id", F.col("doc_id") + i).toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/{i}.parquet")
    folder = tmp_path / "tables" / "documents.parquet"
    folder.mkdir(parents=True)
    for i in range(3):
        (tmp_path / f"{i}.parquet").rename(folder / f"{i}.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    assert difference(QUERIES["row_key_stable"](spark, str(tmp_path / "tables")), con, ORACLES["row_key_stable"]) is None
