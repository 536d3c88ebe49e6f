"""Reading conversations, overrides, lexicons and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally import fixed_values as fixed
from voxtally.functions.common import strip
from voxtally.functions.text import normalise_id
from voxtally.operators.lookups import last_wins
from voxtally.sources.positions import file_order


TASKS_PER_CORE = 4
FEW_PIECES = 256


def spread(df: DataFrame, per_core: int = TASKS_PER_CORE) -> DataFrame:
    """Give every core a share of a table that was scanned in too few pieces.

    Scoring costs far more than moving the raw text once, and a small file is
    one piece however many cores there are.  A scan with a piece for every core
    is left alone, unless it is small altogether.  ``per_core`` is 1 where moving the text costs as
    much as the work on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    if pieces >= per_core * cores or pieces >= max(cores, FEW_PIECES):
        return df
    return df.repartition(per_core * cores)


def read_conversations(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    file_format: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A table of conversations from CSV, Parquet or JSON lines.

    CSV fields may hold line breaks inside quotes; a file is then read by one
    task, so large CSV input comes in many files or without such breaks
    (``multi_line=False``).  Give a schema for large CSV or JSON input: without
    one the files are read twice, once to infer it.
    """
    kind = file_format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if kind in ("json", "jsonl"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"cannot read {kind!r}; export spreadsheets as CSV or Parquet")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found; available: {df.columns}")


def preview(df: DataFrame, id_column: str, text_column: str, rows: int = 5) -> DataFrame:
    require_columns(df, [id_column, text_column])
    return df.select(id_column, text_column).orderBy(id_column).limit(rows)


def load_overrides(df: DataFrame, order: str | None = None) -> DataFrame:
    """``(_id_norm, override_label)``, unique by id, the last row of an id winning.

    The id and label columns are found by name, whatever their case.  ``order``
    names the column that says which row is last; without it rows count in the
    order in which their files hold them, files by their path.
    """
    id_column = next((c for c in df.columns if c.strip().upper() in fixed.OVERRIDE_ID_NAMES), None)
    label_column = next((c for c in df.columns if c.strip().lower() == fixed.OVERRIDE_LABEL_NAME), None)
    if id_column is None or label_column is None:
        raise ValueError(f"no id or label column among {df.columns}")
    ranked = df.select(
        normalise_id(F.col(f"`{id_column}`")).alias("_id_norm"),
        strip(F.col(f"`{label_column}`").cast("string")).alias("override_label"),
        (F.col(order) if order else file_order(df)).alias("_order"),
    ).where((F.octet_length("override_label") > 0) & F.col("_id_norm").isNotNull())
    return last_wins(ranked, "_id_norm", "override_label", "_order")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(token, valence_tenths)`` from a tab-separated lexicon: word, mean valence, further columns."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("token string, mean double").csv(path)
    return (
        rows.where(F.col("token").isNotNull() & F.col("mean").isNotNull())
        .groupBy("token")
        .agg(F.max("mean").alias("mean"))
        .select("token", F.round(F.col("mean") * 10).cast("int").alias("valence_tenths"))
    )
