"""How often 64-bit hashes occur in a corpus, as bit maps of a bounded size.

Hashes are counted in ``2**bits`` slots, the leading bits of each.  The maps tell which
slots hold two occurrences or more, and ``FREQUENT`` or more.  Two hashes in a slot only make
the answer coarser: a slot not marked as repeated holds a single occurrence for certain.

Maps of more than ``2**MOST_BITS`` slots would not fit a broadcast; ``filed_maps`` keeps them in pieces in the shared folder,
and a task reads the pieces one by one for millions of hashes at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_strings, blocks, file_system

#: 2**LEAST_BITS to 2**MOST_BITS slots: each map has 32 MB at most.
LEAST_BITS, MOST_BITS = 16, 28
#: Occurrences from which a slot counts as frequent.
FREQUENT = 32
#: Buckets of slots (2**6), each counted by one task at a time.
BUCKETS = 64
BLOCK = 1 << 20
#: Maps in pieces: 2**FILED_BITS slots at most, 2**PIECE_BITS in a piece, and hashes that are handled at once.
FILED_BITS, PIECE_BITS, AT_ONCE = 32, 24, 1 << 22


def slot_bits(texts: DataFrame, most: int = MOST_BITS) -> int:
    """Bits for about as many slots as the texts have bytes, within the bounds."""
    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(LEAST_BITS, int(length).bit_length()))


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """1 where a slot is marked, else 0."""
    slots = slots.astype(np.int64)
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1


def slot_maps(texts: DataFrame, bits: int, hashes_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maps of the repeated and of the frequent slots over the hashes of all ``texts``.

    ``hashes_of`` gets the UTF-8 bytes and offsets of a block of texts.  Tasks send sorted slot numbers
    as differences, a row for each bucket and block.
    """
    width = bits - 6

    def send(batches):
        for table in blocks(batches, BLOCK):
            slots = np.sort(slots_of(hashes_of(*arrow_strings(table.column("text"))), bits))
            bounds = np.searchsorted(slots, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(width))
            rows = []
            for bucket in range(BUCKETS):
                steps = np.diff(slots[bounds[bucket] : bounds[bucket + 1]], prepend=np.uint64(bucket << width))
                if len(steps):
                    kind = "<u2" if steps.max() < 1 << 16 else "<u4"
                    rows.append((bucket, kind, steps.astype(kind).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "kind", "steps"])

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, kind, steps in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = np.cumsum(np.frombuffer(steps, kind).astype(np.int64))
                total = held.setdefault(bucket, np.zeros(1 << width, np.uint8))
                places, more = np.unique(found, return_counts=True)
                total[places] = np.minimum(total[places] + more, FREQUENT)
        for bucket, total in held.items():
            packed = [np.packbits(total >= least).tobytes() for least in (2, FREQUENT)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), *[pa.array([x]) for x in packed]], ["bucket", "repeated", "frequent"])

    sent = texts.select("text").mapInArrow(send, "bucket bigint, kind string, steps binary")
    maps = sent.repartition(BUCKETS, "bucket").mapInArrow(count, "bucket bigint, repeated binary, frequent binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    step = (1 << width) // 8
    for row in maps.toLocalIterator():  # 2**bits / 4 bytes, a bucket at a time
        for bitmap, part in zip(out, (row.repeated, row.frequent), strict=True):
            bitmap[row.bucket * step : (row.bucket + 1) * step] = np.frombuffer(part, np.uint8)
    return out[0], out[1]


class FiledMaps:
    """Maps in pieces below ``folder``: the repeated slots of a piece, then the frequent ones."""

    def __init__(self, folder: str, bits: int, width: int):
        self.folder, self.bits, self.width = folder, bits, width

    def kinds(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a single occurrence, 1 for a repeated slot, 2 for a frequent one."""
        slots = slots_of(hashes, self.bits)
        pieces = (slots >> np.uint64(self.width)).astype(np.uint16)
        order = np.argsort(pieces, kind="stable")
        bounds = np.searchsorted(pieces[order], np.arange((1 << (self.bits - self.width)) + 1))
        files, root = file_system(self.folder)
        out, mask = np.zeros(len(hashes), np.uint8), np.uint64((1 << self.width) - 1)
        for piece, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if start < end:
                with files.open_input_stream(f"{root}/piece-{piece}") as stream:
                    maps = np.frombuffer(stream.read(), np.uint8).reshape(2, -1)
                own = order[start:end]
                local = slots[own] & mask
                out[own] = has(maps[0], local) + has(maps[1], local)
        return out


def filed_maps(texts: DataFrame, bits: int, hashes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], folder: str) -> FiledMaps:
    """``slot_maps`` of any number of slots, written to ``folder`` in pieces by the tasks that count them."""
    width = min(PIECE_BITS, bits - 6)
    pieces = 1 << (bits - width)

    def steps_of(hashes: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(slots_of(np.concatenate(hashes), bits))
        bounds = np.searchsorted(slots, np.arange(pieces + 1, dtype=np.uint64) << np.uint64(width))
        rows = []
        for piece in np.flatnonzero(np.diff(bounds)).tolist():
            steps = np.diff(slots[bounds[piece] : bounds[piece + 1]], prepend=np.uint64(piece << width))
            kind = "<u2" if steps.max() < 1 << 16 else "<u4"
            rows.append((piece, kind, steps.astype(kind).tobytes()))
        kinds = (pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["piece", "kind", "steps"])

    def send(batches):
        waiting: list[np.ndarray] = []
        for table in blocks(batches, BLOCK):
            waiting.append(hashes_of(*arrow_strings(table.column("text"))))
            if sum(map(len, waiting)) >= AT_ONCE:
                yield steps_of(waiting)
                waiting = []
        if sum(map(len, waiting)):
            yield steps_of(waiting)

    def write(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, kind, steps in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                places, more = np.unique(np.cumsum(np.frombuffer(steps, kind).astype(np.int64)), return_counts=True)
                total = held.setdefault(piece, np.zeros(1 << width, np.uint8))
                total[places] = np.minimum(total[places] + more, FREQUENT)
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        for piece, total in held.items():  # a task that is run again writes the same
            with files.open_output_stream(f"{root}/piece-{piece}") as stream:
                for least in (2, FREQUENT):
                    stream.write(np.packbits(total >= least).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([piece])], ["piece"])

    sent = texts.select("text").mapInArrow(send, "piece bigint, kind string, steps binary")
    sent.repartition(pieces, "piece").mapInArrow(write, "piece bigint").agg(F.count(F.lit(1))).first()
    return FiledMaps(folder, bits, width)
