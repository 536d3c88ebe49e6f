"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds the ids of consecutive documents as little-endian unsigned integers, cut
into frames of ``FRAME`` ids that decompress alone.  After the frames stands a skippable
frame with the seek table of the public seekable format: compressed size, raw size and
the low half of the XXH64 of the raw bytes, for every frame.  An index table (Parquet)
names file, first id and number of ids of every document; a reader opens the table at the
file's end and decompresses the frames of the documents it wants.

Every task attempt writes files under new names; only names in the index, which Spark
commits, are ever read.  So lost executors and repeated attempts do no harm.

Contract: null text counts as empty, giving the end id alone.  Documents are ordered by
id, null ids first; rows that repeat an id are ordered by a hash of their text.
"""

from __future__ import annotations

import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import blocks, file_system, stored
from llm.pretokens import library_encoder

#: Ids in a frame.
FRAME = 1 << 16
#: Ids in a file, after which a task begins another.
FILE = 1 << 28
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Flag of the seek table: entries hold checksums.
CHECKSUMS = 0x80


class FrameWriter:
    """Writes ids to a file; holds one frame at most."""

    def __init__(self, uri: str, width: int):
        fs, path = file_system(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.width, self.entries, self.waiting, self.count, self.total = width, [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def write(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            part, ids = ids[: FRAME - self.count], ids[FRAME - self.count :]
            self.waiting.append(part)
            self.count += len(part)
            if self.count == FRAME:
                self._frame()

    def _frame(self) -> None:
        raw = np.concatenate(self.waiting).astype(f"<u{self.width}").tobytes()
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.count = [], 0

    def close(self) -> None:
        if self.count:
            self._frame()
        body = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads spans of ids; holds the seek table and the last frames used."""

    def __init__(self, uri: str, width: int, keep: int = 2):
        fs, path = file_system(uri)
        self.file, self.width, self.keep, self.frames = fs.open_input_file(path), width, keep, OrderedDict()
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.checks = table[:, 0], table[:, 2]
        self.places = np.cumsum(self.sizes) - self.sizes
        self.ends = np.cumsum(table[:, 1]) // width

    def read(self, start: int, length: int) -> np.ndarray:
        """The ids from ``start`` on, from the frames that hold them."""
        if not length:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(self.ends, [start, start + length - 1], side="right")
        base = int(self.ends[first - 1]) if first else 0
        parts = [self._frame(i) for i in range(first, last + 1)]
        return np.concatenate(parts)[start - base : start - base + length].astype(np.uint32)

    def _frame(self, number: int) -> np.ndarray:
        if (found := self.frames.get(number)) is None:
            packed = self.file.read_at(int(self.sizes[number]), int(self.places[number]))
            raw = zstandard.ZstdDecompressor().decompress(packed)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[number]:
                raise OSError(f"frame {number} does not match its checksum")
            found = self.frames[number] = np.frombuffer(raw, f"<u{self.width}")
            while len(self.frames) > self.keep:
                self.frames.popitem(last=False)
        return found

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", width: int = 2
) -> DataFrame:
    """Writes the ids of all documents, in ascending order of ``id_column``, and returns the stored index.

    The index has ``id_column, part, number, file, first`` (ids before it in the file) and ``n_tokens``;
    files follow each other by ``part`` and ``number``.  ``width`` is the bytes of an id, 2 or 4; an
    id that does not fit is an error.
    """
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches):
        encoder = library_encoder(tokenizer)
        part, number, writer, name = TaskContext.get().partitionId(), -1, None, ""
        for table in blocks(batches, 8 << 20):
            rows = []
            for _, ids in encoder.encode(table.column("text").to_pylist()):
                if writer is None or writer.total >= FILE:
                    if writer:
                        writer.close()
                    number, name = number + 1, f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(f"{folder}/{name}", width)
                rows.append((part, number, name, writer.total, len(ids) + 1))
                most = max(int(ids.max(initial=0)), end_id)
                if most >= 1 << 8 * width:
                    raise ValueError(f"id {most} does not fit the width of {width} bytes")
                writer.write(ids)
                writer.write(np.array([end_id], np.uint32))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], [id_column, "part", "number", "file", "first", "n_tokens"])
        if writer:
            writer.close()

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = source.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = source.schema["id"].dataType.simpleString()
    index = rows.mapInArrow(run, f"`{id_column}` {kind}, part int, number int, file string, first bigint, n_tokens bigint")
    return stored(index, folder, "index")


def read_token_files(index: DataFrame, folder: str, id_column: str = "doc_id", width: int = 2, with_ids: bool = True) -> DataFrame:
    """Reads documents back: ``id_column, start`` (ids of all documents before it), ``n_tokens, ids_crc32`` and ``ids``.

    The rows of ``index`` are what is read, all of them or a choice.  ``start`` counts over the whole
    stored index, also when only some of its rows are asked for.
    """
    spark = index.sparkSession
    whole = spark.read.schema(_index_schema(index)).parquet(f"{folder}/index.parquet")
    files = whole.groupBy("part", "number", "file").agg(F.sum("n_tokens").alias("total"))
    count = max(1, files.count())
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches):
        reader, name = None, None
        for batch in batches:
            found: dict[str, list] = {"crc": [], "ids": []}
            for file, first, length in zip(*(batch.column(x).to_pylist() for x in ("file", "first", "n_tokens")), strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = FrameReader(f"{folder}/{file}", width), file
                ids = reader.read(first, length)
                found["crc"].append(crc32(ids))
                if with_ids:
                    found["ids"].append(ids.view(np.int32))
            columns = [batch.column(0), batch.column("start"), batch.column("n_tokens"), pa.array(found["crc"], pa.int64())]
            if with_ids:
                columns.append(pa.array(found["ids"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        if reader:
            reader.close()

    wanted = index.join(files, "file").select(F.col(f"`{id_column}`").alias("id"), "file", "first", "n_tokens", (F.col("base") + F.col("first")).alias("start"))
    wanted = wanted.repartition(count, "file").sortWithinPartitions("file", "first")
    kind = index.schema[id_column].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_column}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def _index_schema(index: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in index.dtypes)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
