"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  A window is a round: each queue gets a quantum
proportional to its target share, and its deficit counter lets it send the whole tokens
it may; the fraction is carried to the next window.  When a queue runs dry the others
share its part from the next window on.  Since documents may be cut anywhere, what a
queue has sent by the end of window w has a closed form, so every task places its own
documents: only the number of tokens that each queue holds before each block of documents
is passed between partitions.  Windows follow each other without gaps, and sequences are
cut from that one stream, so at most the last sequence is padded.

The ids are stored once, per block of documents, in the shared folder; tokens before each
block come from a window over one row per block and queue.

Sources below ``MIN_SHARE`` of the text, null ones and, with explicit targets, those not
named share one queue, which sends whole documents: each stands where its place among the
tokens of its own source puts it in the queue, so that every stretch of the queue holds
every source by its share, but for about a document.  That order is a table: documents fall
into ``BINS`` ranges of their place, ranges are added up, and each is ordered by itself.

Contract: null text counts as empty and gives its end id alone.  Null sources count as one
source.  Rows that repeat are packed each.  The order within a source is that of the blocks
as they are read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import blocks, shared_folder, stored
from llm.op7_token_files import crc32
from llm.pretokens import library_encoder

#: Sources with a smaller share of the text share a queue, so there are fewer than 1 / MIN_SHARE + 1 queues.
MIN_SHARE = 1 / 512
#: Sequences of a window.
WINDOW = 64
#: A quantum is kept in 2**-20 tokens.
SCALE = 20
#: Ranges of places in the shared queue.
BINS = 1 << 12
#: Rows of block offsets that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Schedule:
    """What each queue has sent by each window, in closed form."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        """``totals``: tokens of each queue; ``weights``: target shares, any positive scale."""
        self.totals = np.array(totals, np.int64)
        weights = np.array(weights, float)
        self.first, self.sent, self.quanta = [], [], []
        sent, start = np.zeros(len(totals), np.int64), 0
        while True:
            open_ = sent < self.totals
            share = np.where(open_, weights, 0)
            if not share.sum():
                break
            quanta = np.where(open_, np.maximum(1, np.floor(window * share / share.sum() * (1 << SCALE))), 0).astype(np.int64)
            self.first.append(start)
            self.sent.append(sent)
            self.quanta.append(quanta)
            # whole numbers of any size: tokens are shifted beyond 64 bits
            left, own = (self.totals - sent)[open_].tolist(), quanta[open_].tolist()
            start += max(1, min(-((-rest << SCALE) // quantum) for rest, quantum in zip(left, own, strict=True)))
            sent = self.by(start)
        self.windows = start

    def by(self, window: int) -> np.ndarray:
        """Tokens that each queue has sent before ``window``: its credit so far, fractions carried."""
        if not self.first:
            return np.zeros_like(self.totals)
        phase = max(0, int(np.searchsorted(self.first, window, side="right")) - 1)
        if self.first[phase] == window and phase:
            return self.sent[phase]
        rounds = window - self.first[phase]
        # whole tokens of a quantum and its fraction apart, so that no product leaves 64 bits
        whole, part = self.quanta[phase] >> SCALE, self.quanta[phase] & ((1 << SCALE) - 1)
        return np.minimum(self.totals, self.sent[phase] + whole * rounds + (part * rounds >> SCALE))

    def window_of(self, queue: int, place: int) -> int:
        """The window that sends token number ``place`` of a queue."""
        phase = max(i for i, sent in enumerate(self.sent) if i == 0 or sent[queue] <= place)
        low = self.first[phase]
        high = self.windows
        while high - low > 1:  # the last window before which no more than ``place`` tokens were sent
            middle = (low + high) // 2
            if self.by(middle)[queue] <= place:
                low = middle
            else:
                high = middle
        return low


class Places:
    """Cuts spans of a queue into pieces of sequences; remembers the last window of each queue."""

    def __init__(self, schedule: Schedule, sequence: int):
        self.schedule, self.sequence, self.last = schedule, sequence, {}

    def _window(self, queue: int, place: int) -> tuple[int, int, int]:
        """First token, end and place in the stream of the queue's part of the window that holds ``place``."""
        found = self.last.get(queue)
        if found is None or not found[0] <= place < found[1]:
            number = found[3] + 1 if found and found[1] == place else None
            if number is None or self.schedule.by(number + 1)[queue] <= place:
                number = self.schedule.window_of(queue, place)
            sent, then = self.schedule.by(number), self.schedule.by(number + 1)
            stream = int(sent.sum() + (then - sent)[:queue].sum())
            found = self.last[queue] = (int(sent[queue]), int(then[queue]), stream, number)
        return found[:3]

    def pieces(self, queue: int, start: int, length: int):
        """``(offset in the span, length, sequence, offset in it, window)`` of each piece."""
        done = 0
        while done < length:
            first, end, stream = self._window(queue, start + done)
            place = stream + start + done - first
            size = min(length - done, end - start - done, self.sequence - place % self.sequence)
            yield done, size, place // self.sequence, place % self.sequence, self.last[queue][3]
            done += size


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    targets: Mapping[str, float] | None = None,
    sequence: int = 2048,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: ``id_column, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, queue``.

    ``targets`` maps sources to shares of the tokens; without it every source keeps its own share
    of the corpus.  Sources that ``targets`` does not name share what remains below 1, or run last.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "packing")
    source = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{source_column}`").cast("string").alias("source")
    )
    if targets is None:
        sizes = source.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        named = sorted(r[0] for r in sizes.where(F.col("source").isNotNull() & (F.col("size") >= total * MIN_SHARE)).select("source").collect())
    else:
        named = sorted(targets)
    numbers = {name: i for i, name in enumerate(named)}
    encoded = stored(_encoded(source, tokenizer, end_id, numbers), folder, "ids")
    held = encoded.groupBy("block", "queue", "source").agg(F.sum("doc_tokens").alias("tokens"))
    held = stored(held, folder, "blocks")
    totals = dict(held.groupBy("queue").agg(F.sum("tokens")).collect())
    counts = [totals.get(i, 0) for i in range(len(named) + 1)]
    if targets is None:
        weights = [float(x) for x in counts]
    else:
        weights = [float(targets[x]) for x in named] + [max(1e-6, 1 - sum(targets.values()))]
    places = Schedule(counts, weights, window * sequence)
    of_source = Window.partitionBy("queue", "source")
    earlier = of_source.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("block", "queue", "source", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"), F.sum("tokens").over(of_source).alias("total"))
    if held.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    shared = F.col("queue") == len(named)
    placed = encoded.where(~shared).join(offsets, ["block", "queue", "source"])
    placed = placed.select("id", "queue", (F.col("base") + F.col("before")).alias("first"), "doc_tokens", "ids")
    if counts[-1]:
        key = ["block", "source", "before"]
        order = stored(_interleaved(encoded.where(shared).select(*key, "queue", "doc_tokens").join(offsets, ["block", "queue", "source"])), folder, "order")
        placed = placed.union(encoded.where(shared).join(order, key).select("id", "queue", "first", "doc_tokens", "ids"))
    names = [*named, None]

    def run(batches):
        cutter = Places(places, sequence)
        for batch in batches:
            rows = []
            for number, queue, first, length, packed in zip(range(batch.num_rows), *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * length else "<u4")
                for start, size, where, offset, round_ in cutter.pieces(queue, first, length):
                    rows.append((number, start, size, crc32(ids[start : start + size]), length, where, offset, round_, names[queue]))
            if rows:
                number, *columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(number)), *map(pa.array, columns, kinds)],
                    [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", "queue"],
                )

    kind = source.schema["id"].dataType.simpleString()
    numbers_of = "start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id".replace(",", " bigint,")
    return placed.mapInArrow(run, f"`{id_column}` {kind}, {numbers_of} bigint, queue string")


def _interleaved(docs: DataFrame) -> DataFrame:
    """``block, source, before, first``: the tokens of the shared queue before each of its documents."""
    spark = docs.sparkSession
    # a point of the document, the same for all of a source, so that sources of one document are spread too
    point = F.xxhash64("source").bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    own = F.col("base") + F.col("before")
    docs = docs.select("block", "source", "before", "doc_tokens", ((own + point * F.col("doc_tokens")) / F.col("total")).alias("place"))
    docs = docs.withColumn("bin", F.least(F.floor(F.col("place") * BINS), F.lit(BINS - 1)).cast("int"))
    sums = np.zeros(BINS + 1, np.int64)
    for row in docs.groupBy("bin").agg(F.sum("doc_tokens").alias("tokens")).collect():  # BINS at most
        sums[row.bin + 1] = row.tokens
    starts = spark.createDataFrame(list(enumerate(np.cumsum(sums)[:BINS].tolist())), "bin int, start bigint")
    earlier = Window.partitionBy("bin").orderBy("place", "source", "block", "before").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("doc_tokens").over(earlier), F.lit(0))
    return docs.withColumn("within", within).join(F.broadcast(starts), "bin").select("block", "source", "before", (F.col("start") + F.col("within")).alias("first"))


def _encoded(source: DataFrame, tokenizer: str, end_id: int, numbers: dict[str, int]) -> DataFrame:
    """Ids of each document, its queue and source, and the tokens of that source before it in its block.

    Sources are written with a leading ``=``, null as an empty string, so that they can be joined on.
    """

    def run(batches):
        encoder, block, before = library_encoder(tokenizer), TaskContext.get().partitionId(), {}
        for table in blocks(batches, 8 << 20):
            rows = []
            names = table.column("source").to_pylist()
            for i, ids in encoder.encode(table.column("text").to_pylist()):
                queue = numbers.get(names[i], len(numbers))
                ids = np.append(ids, np.uint32(end_id))
                packed = ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4").tobytes()
                name = "" if names[i] is None else "=" + names[i]
                rows.append((block, queue, name, before.get(name, 0), len(ids), packed))
                before[name] = before.get(name, 0) + len(ids)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], ["id", "block", "queue", "source", "before", "doc_tokens", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, block int, queue int, source string, before bigint, doc_tokens bigint, ids binary")
