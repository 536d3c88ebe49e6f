"""Compare a registered query with its oracle: columns sorted by name, rows as a multiset."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (value if value else 0.0)
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    return [names[i] for i in order], rows


def difference(spark_df, con, sql: str) -> str | None:
    spark_names, ours = rows_of_spark(spark_df)
    duck_names, theirs = rows_of_duckdb(con, sql)
    if spark_names != duck_names:
        return f"columns {spark_names} against {duck_names}"
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return (
        f"rows {sum(ours.values())} against {sum(theirs.values())}; "
        f"{sum((ours - theirs).values())} differ; spark {only_ours}; oracle {only_theirs}"
    )
