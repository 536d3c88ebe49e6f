"""Where a row stands in its files: the order of rows without an order column, and keys of rows without a key.

Spark tells the file of a row and the block of the file it was read in; Parquet also the row's number in its file.
Both are hidden columns of a scan, so they are asked for on the table as it was read, before
anything is joined or grouped.  No row is copied or moved for them.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.lookups import BROADCAST_BYTES, measured_bytes
from voxtally.session import cut_lineage

#: Bits of a key for the place in a file; the rest is for the number of the file.
PLACE_BITS = 40


def _known(df: DataFrame) -> set[str]:
    """What the scan tells of a row's file; nothing where ``df`` was not read from files."""
    try:
        return set(df.select("_metadata").schema["_metadata"].dataType.names)
    except AnalysisException:
        return set()


def file_order(df: DataFrame) -> Column:
    """A value that ascends as the rows stand in their files, files by their path.

    ``monotonically_increasing_id`` alone follows the tasks of a scan, which take large files first.  A
    table that was not read from files keeps that order, having no other.
    """
    within, known = F.monotonically_increasing_id(), _known(df)
    if "file_path" not in known:
        return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), within.alias("row"))
    if "row_index" in known:
        block, within = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        # rows of a block are read by one task in their order
        block = F.col("_metadata.file_block_start")
    return F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), within.alias("row"))


def assign_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df`` with a key per row, the same whenever the same files are scanned.

    The key is the number of the file among the sorted paths, and the row's place in it: its index for
    Parquet; for text formats the start of its block and its number there, as no row is shorter than a byte.
    Blocks depend on the settings of the scan, so keys of text formats hold for one setting.  A table that
    was not read from files is written once, by a checkpoint.
    """
    known = _known(df)
    if "file_path" not in known:
        return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
    spark = df.sparkSession
    path = F.col("_metadata.file_path")
    if "row_index" in known:
        located = df.select("*", path.alias("_file"), F.col("_metadata.row_index").alias("_place"))
        files = df.select(path.alias("_file")).distinct()
    else:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        located = df.select("*", path.alias("_file"), block.alias("_block"), row.alias("_row"))
        # a row for each block of a file: where its rows begin among those of their task
        starts = df.select(path.alias("_file"), block.alias("_block"), row.alias("_row")).groupBy("_file", "_block").agg(F.min("_row").alias("_first"))
        located = located.join(_sized(starts), ["_file", "_block"])
        located = located.withColumn("_place", F.col("_block") + F.col("_row") - F.col("_first")).drop("_block", "_row", "_first")
        files = starts.select("_file").distinct()
    paths = sorted(row["_file"] for row in files.collect())  # names of files, which the driver listed for the scan
    numbers = spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "_file string, _number bigint")
    keyed = located.join(_sized(numbers), "_file")
    key = F.shiftleft("_number", PLACE_BITS) + F.col("_place")
    return keyed.withColumn(name, key).select(*df.columns, name)


def number_rows(df: DataFrame, name: str = "row_number") -> DataFrame:
    """``df`` with the place of each row in the whole table: 0, 1, 2 and so on, files by their path and rows as they stand in them.

    One narrow job counts the rows of each file, or of each block of a text file, whose sums are where the others
    begin.  A table that was not read from files is numbered in the order of its tasks, from a checkpoint.
    """
    known = _known(df)
    if "file_path" not in known:
        df = cut_lineage(df)
        path, block, row, first = F.lit(""), F.spark_partition_id().cast("long"), F.monotonically_increasing_id(), F.min("_row")
    elif "row_index" in known:
        # the index counts from the beginning of its file, so a file is one block
        path, block, row, first = F.col("_metadata.file_path"), F.lit(0).cast("long"), F.col("_metadata.row_index"), F.lit(0).cast("long")
    else:
        path, block, row, first = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), F.min("_row")
    places = [path.alias("_file"), block.alias("_block"), row.alias("_row")]
    counted = df.select(*places).groupBy("_file", "_block").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = sorted(tuple(r) for r in counted.collect())  # a row for each piece of the scan, which the driver listed
    before = accumulate((n for _, _, _, n in found), initial=0)
    starts = [(file, block, offset - first) for (file, block, first, _), offset in zip(found, before, strict=False)]
    offsets = df.sparkSession.createDataFrame(starts, "_file string, _block bigint, _offset bigint")
    numbered = df.select("*", *places).join(_sized(offsets), ["_file", "_block"])
    return numbered.withColumn(name, F.col("_row") + F.col("_offset")).select(*df.columns, name)


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if measured_bytes(table) <= BROADCAST_BYTES else table
