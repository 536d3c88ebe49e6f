"""Maps of the runs of bytes that a table of strings holds, for tables of many phrases.

A phrase lies in a text only if each of its runs of bytes lies in some text.  The runs of all texts are counted, coarsely,
in a map of at most 64 MB; phrases with a run that no text has are dropped where they are read, before any shuffle.  The others
are filed under their own hash, or, beyond ``LONGEST`` bytes, under that of so many bytes about the run that is rarest in the
texts.  A map of these hashes picks from each text the pieces that are phrases.  Runs may share a slot or a hash: then more is
kept, never less.

Runs are bytes of UTF-8, in which a string lies in another where its bytes do.  A phrase is cut into runs of the largest size in
``SIZES`` that it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

SIZES = (12, 8, 4, 3, 2, 1)
#: Bytes of a phrase that its hash covers.
LONGEST = 32
#: Occurrences from which a slot has level 1, 2 and 3.
LEVELS = (1, 8, 200)
#: 2**LEAST_BITS to 2**MOST_BITS slots of two bits.
LEAST_BITS, MOST_BITS = 16, 28
#: Slots for each byte of text, and for each run filed, where the bounds allow.
SLOTS = 8
#: Buckets of slots (2**6), each put together by one task at a time.
BUCKETS = 64
#: Bytes of strings handled at once.
BLOCK = 1 << 20


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(SLOTS * count).bit_length()))


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(29)) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` bytes (8 at most) as whole numbers, one from each place on."""
    if size == 1:
        return data.astype(np.uint64)
    half, n = size // 2, max(len(data) - size + 1, 0)
    one = _windows(data, half)
    two = one if 2 * half == size else _windows(data, size - half)
    return one[:n] | (two[half : half + n] << np.uint64(8 * half))


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes."""
    if size <= 8:
        return _mixed(_windows(data, size), size)
    n = max(len(data) - size + 1, 0)
    return _mixed(_mixed(_windows(data, 8)[:n], size) ^ _windows(data, size - 8)[8 : 8 + n], size)


FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


@lru_cache(4)
def _powers(factor: int, exponent: int) -> np.ndarray:
    """The first ``2**exponent`` powers modulo 2**64."""
    out = np.full(1 << exponent, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by which the hash of any piece follows from its two ends, and what its place has to be divided by."""
    exponent = max(20, len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(FACTOR, exponent)[: len(data)], out=sums[1:])
    return sums, _powers(INVERSE, exponent)


def _piece_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return _mixed((sums[ends] - sums[starts]) * inverse[starts], LONGEST)


def level(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The level of each slot, four slots in a byte."""
    slots = slots.astype(np.int64)
    return (marks[slots >> 2] >> ((slots & 3) << 1).astype(np.uint8)) & 3


def _strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow column of strings and the offsets of its rows; nulls are empty."""
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.empty(0, np.uint8) if array.buffers()[2] is None else np.frombuffer(array.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(batches, column: str):
    """Slices of Arrow batches with about ``BLOCK`` bytes in ``column``, a row at least."""
    for batch in batches:
        ends = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def _places(lengths: np.ndarray, size: int) -> np.ndarray:
    """Where in their joined bytes runs of ``size`` begin that lie in one row."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(size, size + len(ends)) <= ends)


def counted(df: DataFrame, bits: int, hashes_of: Callable) -> np.ndarray:
    """A map with the level of each slot, over the hashes that ``hashes_of`` yields, an array at a time, for an Arrow batch."""
    width = bits - 6

    def send(batches):
        for batch in batches:
            for found in hashes_of(batch):
                slots, counts = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                counts = np.minimum(counts, LEVELS[-1]).astype(np.uint8)
                bounds = np.searchsorted(slots, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(width))
                rows = []
                for bucket in range(BUCKETS):
                    own = slice(bounds[bucket], bounds[bucket + 1])
                    steps = np.diff(slots[own], prepend=np.uint64(bucket << width))
                    if len(steps):
                        kind = "<u2" if steps.max() < 1 << 16 else "<u4"
                        rows.append((bucket, kind, steps.astype(kind).tobytes(), counts[own].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "kind", "steps", "counts"])

    def put_together(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, kind, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                total = held.setdefault(bucket, np.zeros(1 << width, np.uint8))
                places, more = np.cumsum(np.frombuffer(steps, kind).astype(np.int64)), np.frombuffer(counts, np.uint8)
                total[places] += np.minimum(more, LEVELS[-1] - total[places])
        for bucket, total in held.items():
            four = sum((total >= least).astype(np.uint8) for least in LEVELS).reshape(-1, 4)
            packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([packed.tobytes()])], ["bucket", "marked"])

    sent = df.mapInArrow(send, "bucket bigint, kind string, steps binary, counts binary")
    parts = sent.repartition(BUCKETS, "bucket").mapInArrow(put_together, "bucket bigint, marked binary")
    out, step = np.zeros((1 << bits) // 4, np.uint8), (1 << width) // 4
    for row in parts.toLocalIterator():  # 2**bits / 4 bytes, a bucket at a time
        out[row.bucket * step : (row.bucket + 1) * step] = np.frombuffer(row.marked, np.uint8)
    return out


def runs_of_texts(texts: DataFrame, column: str, bits: int) -> np.ndarray:
    """The map of all runs of the texts, of every size."""

    def all_runs(batch):
        for block in _blocks([batch], column):
            data, offsets = _strings(block.column(column))
            for size in SIZES:
                yield hashes(data, size)[_places(np.diff(offsets), size)]

    return counted(texts.select(column), bits, all_runs)


def filed(phrases: DataFrame, column: str, marks: Broadcast, bits: int) -> DataFrame:
    """``(head, size, phrase)`` of the phrases of which each run is in the map: the hash they are filed under and the bytes it covers."""

    def run(batches):
        for block in _blocks(batches, column):
            lengths = np.diff(_strings(block.column(column))[1])
            most = None
            for size in SIZES:
                rows = (lengths >= size) & (most is None or lengths < most)
                most = size
                if not rows.any():
                    continue
                some = block.column(column).filter(pa.array(rows))
                data, offsets = _strings(some)
                own, places = np.diff(offsets), _places(np.diff(offsets), size)
                found = hashes(data, size)[places]
                levels = level(marks.value, found >> np.uint64(64 - bits))
                starts = np.append(0, np.cumsum(own - size + 1))[:-1]
                keep = np.minimum.reduceat(levels, starts) > 0
                # the place of the least by level, then by hash; the last of equal ones
                order = (levels.astype(np.uint64) << np.uint64(62)) | (found >> np.uint64(2))
                least = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, starts), own - size + 1))
                first = np.zeros(len(own), np.int64)
                first[np.searchsorted(starts, least, "right") - 1] = places[least]
                covered = np.minimum(own, LONGEST)
                first = np.minimum(first, offsets[1:] - covered) if size == SIZES[0] else offsets[:-1]
                first = np.where(own <= LONGEST, offsets[:-1], first)
                heads = _piece_hashes(*_sums(data), first, first + covered)
                yield pa.RecordBatch.from_arrays([pa.array(heads[keep].view(np.int64)), pa.array(covered[keep].astype(np.int32)), some.filter(pa.array(keep))], ["head", "size", "phrase"])

    return phrases.select(column).mapInArrow(run, "head bigint, size int, phrase string")


def heads_of(index: DataFrame, bits: int) -> np.ndarray:
    """The map of what the phrases are filed under, two slots for each."""

    def both(batch):
        heads = batch.column(0).to_numpy().view(np.uint64)
        return [heads, _mixed(heads, LONGEST)]

    return counted(index.select("head"), bits, both)


def marked_pieces(texts: DataFrame, keys: list[str], column: str, sizes: list[int], marks: Broadcast, bits: int) -> DataFrame:
    """``(keys, head)``: the distinct pieces of these sizes of each text, by their hashes, that the map has."""

    def run(batches):
        for block in _blocks(batches, column):
            data, offsets = _strings(block.column(column))
            row_of = np.repeat(np.arange(block.num_rows), np.diff(offsets))
            left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the end of the row
            sums, inverse = _sums(data)
            for size in sizes:
                n = max(len(data) - size + 1, 0)
                found = _piece_hashes(sums, inverse, slice(0, n), slice(size, size + n))
                hit = (left[:n] >= size) & (level(marks.value, found >> np.uint64(64 - bits)) > 0)
                rows, found = row_of[:n][hit], found[hit]
                hit = level(marks.value, _mixed(found, LONGEST) >> np.uint64(64 - bits)) > 0
                rows, found = rows[hit], found[hit]
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                first = np.append(True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1]))[: len(rows)]
                own = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([*[block.column(key).take(own) for key in keys], pa.array(found[first].view(np.int64))], [*keys, "head"])

    schema = ", ".join([*[f"`{key}` {texts.schema[key].dataType.simpleString()}" for key in keys], "head bigint"])
    return texts.select(*keys, column).mapInArrow(run, schema)
