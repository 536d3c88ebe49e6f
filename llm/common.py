"""Shared folders, intermediate tables and numpy helpers of the operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"llm-{os.getpid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of ``df`` written once as Parquet and read again: lineage ends there."""
    path = f"{folder}/{name}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table or folder that was written by ``stored`` and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # the file system that Spark wrote with
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of ended queries, which stay until the driver happens to collect its garbage."""
    gc.collect()  # data frames that Python still holds hold theirs
    spark._jvm.System.gc()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + length]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return flat[index]


def arrow_strings(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its rows; nulls are empty."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    size = len(array)
    if not size:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, size + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, size: int, column: str | int = "text"):
    """Arrow batches regrouped so that the strings of ``column`` in one hold about ``size`` bytes.

    A row is never split, so a block holds one row at least.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        start, total = 0, 0
        for i, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            length = length or 0
            if total and total + length > size:
                yield pa.Table.from_batches([batch.slice(start, i - start)])
                start, total = i, 0
            total += length
        if start < batch.num_rows:
            yield pa.Table.from_batches([batch.slice(start)])
