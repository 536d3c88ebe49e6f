"""Substring dedup by sliding sentence spans.

A unit is a run of words up to a sentence or clause mark or a line end.  A span is a run of
at least ``SPAN`` units and ``WORDS`` words from which the last or the first unit cannot be
left out: three units, or more where units are short.  Spans are hashed; equal hashes are
joined over the whole corpus, and units covered by any span that is not the first of its
kind, by document id and place, are removed.  Clause marks end units too, so that a passage
set in the middle of another sentence loses no more than its first clause.

A unit of more than ``LONG`` words is cut into pieces, each a unit: before the word pair with
the least hash of every ``WINDOW`` consecutive ones (winnowing), so that cuts depend on the
words nearby and not on where the unit began.  Any 50 words that two texts share then hold
a whole span.  A pair that comes again fewer than ``WINDOW`` pairs off cuts nothing, so runs
that repeat fewer than ``WINDOW`` words over and over stay one unit.

Most spans occur once.  Their hashes are counted in slots first (see the n-gram join), and
only spans of repeated slots become rows, so what is shuffled besides the texts themselves is
about as large as what repeats.

Contract: null text stays null, texts without units stay as they are.  A text with fewer
units than a span is one span.  Rows that repeat an id and its text count as one
occurrence; null ids come first.  Columns besides the text keep names and values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_strings, blocks, discard, ragged, shared_folder, stored
from llm.pretokens import hashed, mixed
from llm.slots import has, slot_maps, slot_bits, slots_of
from llm.words import word_hashes, word_spans

#: Consecutive units of a span, and the words it needs.
SPAN, WORDS = 3, 12
#: Words from which on a unit stays no longer whole, and the pairs one of which is a cut.  With these,
#: 3 * LONG + 2 * WINDOW + 1 and 6 * WINDOW - 1 words, the longest runs without a whole span, are below 50.
LONG, WINDOW = 10, 8
#: Bytes that end a unit when they end a word.
MARKS = b".!?,;:"
BLOCK = 1 << 20


def cuts_of(plain: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The words before which long units are cut: ``plain`` are hashes, ``heads`` the first words of units and the end."""
    long = np.flatnonzero(np.diff(heads) > LONG)
    sizes = np.diff(heads)[long]
    if not len(long):
        return np.empty(0, np.int64)
    words = ragged(np.arange(len(plain)), heads[long], sizes)
    limits = np.cumsum(sizes)
    begins, ends = np.repeat(limits - sizes, sizes), np.repeat(limits, sizes)
    place = np.arange(len(words))
    with np.errstate(over="ignore"):
        pairs = mixed(plain[words] * np.uint64(3) + np.append(plain[words[1:]], np.uint64(0)))
    none = np.zeros(WINDOW - 1, np.uint64)
    least = sliding_window_view(np.concatenate((pairs, none)), WINDOW).min(axis=1)
    least[place + WINDOW >= ends] = 0  # windows lie within a unit
    most = sliding_window_view(np.concatenate((none, least)), WINDOW).max(axis=1)
    cut = np.flatnonzero((most == pairs) & (place > begins))
    again = np.zeros(len(cut), bool)
    for step in range(1, WINDOW):
        for other, inside in ((cut + step, cut + step < ends[cut] - 1), (cut - step, cut - step >= begins[cut])):
            again[inside] |= pairs[other[inside]] == pairs[cut[inside]]
    return words[cut[~again]]


def units_of(data: np.ndarray, offsets: np.ndarray):
    """Word starts and hashes, the first word of each unit (and the number of words), and the units before each text."""
    starts, ends, firsts = word_spans(data, offsets)
    closes = np.isin(data[ends - 1], np.frombuffer(MARKS, np.uint8)) if len(ends) else np.empty(0, bool)
    lines = np.flatnonzero(data == 10)
    if len(starts):
        before = np.searchsorted(lines, starts)
        closes[:-1] |= before[1:] > before[:-1]
    last = firsts[1:][np.diff(firsts) > 0] - 1
    closes[last] = True
    plain = word_hashes(data, starts, ends, lower=False)
    heads = np.concatenate(([0], np.flatnonzero(closes) + 1))
    heads = np.union1d(heads, cuts_of(plain, heads))
    return starts, plain, heads, np.searchsorted(heads[:-1], firsts)


def spans_of(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, words: int = WORDS):
    """Text number, first unit within the text, number of units, and hash of every span."""
    _, plain, heads, units = units_of(data, offsets)
    own = hashed(np.arange(len(plain)), heads[:-1], heads[1:], plain)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(units))
    low, high = units[text], units[text + 1]
    number = np.arange(len(text))
    # a text of fewer units than a span is one, as a whole
    least = np.minimum(span, high - low)
    last = np.maximum(number + least, np.searchsorted(heads, heads[:-1] + words))
    ahead = last <= high
    # the same from the other end: the largest first unit of a span that ends with each unit
    first = np.minimum(number + 1 - least, np.searchsorted(heads, heads[1:] - words, side="right") - 1)
    back = first >= low
    # where both are the same span it is taken once
    back[back] = last[first[back]] != number[back] + 1
    begin = np.concatenate((number[ahead], first[back]))
    end = np.concatenate((last[ahead], number[back] + 1))
    found = hashed(np.arange(len(own)), begin, end, own)
    return text[begin], begin - units[text[begin]], end - begin, found


def removed(text: bytes, drop: list[int]) -> bytes:
    """The text without the units of these numbers."""
    data = np.frombuffer(text, np.uint8)
    starts, _, heads, _ = units_of(data, np.array([0, len(data)]))
    bounds = np.append(starts, len(data))[heads]
    gone = np.zeros(len(bounds), bool)
    gone[drop] = True
    kept = [text[: bounds[0]]] + [text[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~gone[:-1]).tolist()]
    out = b"".join(kept)
    return out.rstrip(b" \t\n\x0b\x0c\r") if gone[len(bounds) - 2] else out


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated units removed from ``text_column``, and ``n_units_removed``."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "spans")
    text = F.col(f"`{text_column}`").cast("string")
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    bits = slot_bits(source)
    repeated, _ = slot_maps(source, bits, lambda data, offsets: spans_of(data, offsets, span, words)[3])
    known = spark.sparkContext.broadcast(repeated)

    def send(batches):
        for table in blocks(batches, BLOCK):
            texts, place, size, found = spans_of(*arrow_strings(table.column("text")), span, words)
            keep = has(known.value, slots_of(found, bits)) > 0
            texts, place, size, found = pa.array(texts[keep]), place[keep], size[keep], found[keep]
            columns = [table.column(c).combine_chunks().take(texts) for c in ("id", "tie")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(found.view(np.int64))], ["id", "tie", "place", "size", "h"])

    kind = source.schema["id"].dataType.simpleString()
    spans = stored(source.mapInArrow(send, f"id {kind}, tie bigint, place int, size int, h bigint"), f"{folder}/work", "spans")
    known.destroy()
    at = F.struct(F.col("id").isNotNull().alias("named"), "id", "tie", "place")
    first = spans.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("NOT (first <=> last)").select("h", "first")
    # stored, so that the rows of one frequent hash are not bound to one task of the join
    first = stored(first, f"{folder}/work", "first")
    later = spans.join(first, "h").where(~at.eqNullSafe(F.col("first"))).select("id", "tie", F.explode(F.sequence("place", F.col("place") + F.col("size") - 1)).alias("unit"))
    # a document's own units at most
    drop = later.groupBy("id", "tie").agg(F.collect_set("unit").alias("units"))
    drop = stored(drop.withColumnsRenamed({"id": "drop_id", "tie": "drop_tie"}), folder, "drop")
    discard(spark, f"{folder}/work")
    names = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    which, what = names.index(id_column), names.index(text_column)
    tie = F.xxhash64(F.col(f"c{what}").cast("string"))
    joined = held.join(drop, F.col(f"c{which}").eqNullSafe(F.col("drop_id")) & (tie == F.col("drop_tie")), "left").drop("drop_id", "drop_tie")

    def cut(batches):
        for batch in batches:
            texts, units = batch.column(what).cast(pa.string()), batch.column(batch.num_columns - 1)
            new, counts = [], []
            for value, numbers in zip(texts, units, strict=True):
                numbers = numbers.as_py() if numbers.is_valid else None
                if numbers is None or not value.is_valid:
                    new.append(value.as_py())
                    counts.append(0)
                    continue
                data = value.as_buffer().to_pybytes()
                total = len(units_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2]) - 1
                numbers = [n for n in numbers if n < total]
                new.append(removed(data, numbers).decode())
                counts.append(len(numbers))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64())]
            columns[what] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "removed"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    fields = [StructField(f.name, StringType() if i == what else f.dataType) for i, f in enumerate(held.schema.fields)]
    out = joined.mapInArrow(cut, StructType([*fields, StructField("removed", LongType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("removed").alias("n_units_removed"))
