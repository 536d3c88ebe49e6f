"""Quality scores by naive Bayes support vectors.

A text is the set of its n-grams: runs of one and two tokens, and of one to four token
shapes (lower case, capitalised, capitals, digits, the marks themselves, and whether a blank
precedes), hashed into ``BUCKETS``.  Each indicator is scaled by the log-count ratio of the two
classes, counted over all labelled texts that are learnt from, and rows are brought to unit
length.  A linear model with hinge loss is fitted to them by dual coordinate descent: the sample
lies in shards, each shard descends in its own dual variables on a copy of the weights,
and the steps of all shards are added (each shard reckons with the others by taking its own
step that much more seriously, so the sum is safe).  A logistic function turns margins into
scores; it is fitted on labelled texts that neither ratios nor weights have seen.

The weights are learnt from a sample of labelled texts: all of a class, or about ``SAMPLE`` of
them chosen by a hash of the id; a logistic row counts for the rows it stands for.  Ratios are
counted over all labelled rows, labels, language, source and id never enter a score, and all texts
are scored whole.

Contract: null text counts as empty; a text without n-grams gets the score of the bias alone.
Null labels are unlabelled, of repeated labels the largest holds.  With labels of one class
only, the score is that class; without labels it is 0.  Rows that repeat are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_strings, blocks, ragged, shared_folder, stored
from llm.pretokens import hashed, mixed

#: Labelled texts of each class that the weights are learnt from, about.
SAMPLE = 20_000
#: 2**BITS buckets of n-grams.
BITS = 18
BUCKETS = 1 << BITS
#: Added to the counts of both classes.
SMOOTH = 1.0
#: Sizes of n-grams of tokens and of shapes.
TOKENS, SHAPES = (1, 2), (1, 2, 3, 4)
#: Shards of the sample, rounds of adding up their steps, passes of a shard in a round, and the bound of a dual variable.
SHARDS, ROUNDS, PASSES, BOUND = 16, 8, 2, 1.0
#: One of so many labelled texts is kept for the logistic function.
FOLDS = 5
#: Value of the constant feature.
BIAS = 0.3
#: Bytes of labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BLOCK = 1 << 20

SPACE, LETTER, DIGIT, MARK, LINE = range(5)


@dataclass(frozen=True)
class Model:
    """Log-count ratios and weights by bucket, the weight of the constant, and the logistic function of a margin."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    base: float


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[list(b" \t\r\x0b\x0c")] = SPACE
    kinds[10] = LINE
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[128:] = LETTER
    return kinds


KINDS = _kinds()


def _grams(codes: np.ndarray, firsts: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each run of ``size`` codes within a text."""
    made = np.maximum(0, np.diff(firsts) - size + 1)
    texts = np.repeat(np.arange(len(made)), made)
    place = ragged(np.arange(len(codes)), firsts[:-1], made)
    total = np.full(len(place), seed, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[place + j])
    return texts, total


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, ascending and distinct, and the bounds of the texts."""
    data, offsets = arrow_strings(column)
    kinds = KINDS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = first[:-1].copy()
    begin[1:] |= kinds[1:] != kinds[:-1]
    begin[kinds == LINE] = True
    marks = np.flatnonzero(begin)
    ends = np.append(marks[1:], len(data))
    kept = kinds[marks] != SPACE
    starts, ends = marks[kept], ends[kept]
    firsts = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        tokens = hashed(data, starts, ends, mixed(np.arange(1, 257, dtype=np.uint64)))
        upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
        capitals = upper[ends] - upper[starts]
        shape = np.where(capitals == 0, 1, np.where((capitals == ends - starts) & (capitals > 1), 2, np.where((capitals == 1) & (data[starts] >= 65) & (data[starts] <= 90), 3, 4)))
        kind = kinds[starts]
        shape = np.where(kind == LETTER, shape, np.where(kind == DIGIT, 5, 6)).astype(np.uint64)
        shape = np.where(kind == MARK, tokens, shape)
        joined = np.zeros(len(starts), np.uint64)
        joined[1:] = starts[1:] == ends[:-1]
        joined[firsts[:-1][np.diff(firsts) > 0]] = 0
        shape = mixed(shape * np.uint64(2) + joined)
    found = [_grams(codes, firsts, size, 16 * stream + size) for stream, (codes, sizes) in enumerate(((tokens, TOKENS), (shape, SHAPES))) for size in sizes]
    keys = np.concatenate([(texts.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)) for texts, hashes in found])
    keys = np.unique(keys)
    bounds = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int32), bounds


def scaled_rows(buckets: np.ndarray, bounds: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The values of these indicators: their ratios, each text of unit length."""
    values = ratios[buckets]
    squares = np.concatenate(([0.0], np.cumsum(values * values)))
    lengths = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 1e-12))
    return values / np.repeat(lengths, np.diff(bounds))


def margins(model: Model, column) -> np.ndarray:
    """The value of the linear model for each text."""
    buckets, bounds = features(column)
    products = np.concatenate(([0.0], np.cumsum(scaled_rows(buckets, bounds, model.ratios) * model.weights[buckets])))
    return products[bounds[1:]] - products[bounds[:-1]] + model.bias


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """``id, text, y, fold`` of all labelled rows that are not held out; fold 0 is kept for the logistic function."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    if labels.count() * 16 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(known, "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(FOLDS), "id"), F.lit(FOLDS)).cast("int"))


def _ratios(train: DataFrame) -> np.ndarray:
    """Log-count ratio of each bucket: texts of either class that have it, smoothed, over all such counts of the class."""

    def count(batches):
        held = np.zeros((2, BUCKETS), np.int64)
        for table in blocks(batches, BLOCK):
            buckets, bounds = features(table.column("text"))
            good = np.repeat(table.column("y").to_numpy() == 1, np.diff(bounds))
            for row, which in enumerate((~good, good)):
                held[row] += np.bincount(buckets[which], minlength=BUCKETS)
        used = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[0, used]), pa.array(held[1, used])], ["bucket", "bad", "good"])

    counts = train.select("text", "y").mapInArrow(count, "bucket int, bad bigint, good bigint")
    total = np.full((2, BUCKETS), SMOOTH)
    for row in counts.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toLocalIterator():  # a row a bucket
        total[:, row.bucket] += row.bad, row.good
    shares = np.log(total / total.sum(1, keepdims=True))
    return shares[1] - shares[0]


def _shards(train: DataFrame, ratios: np.ndarray, folder: str) -> DataFrame:
    """``shard, y, bounds, buckets, data``: the sample's rows of each shard in one row, about ``2 * SAMPLE / SHARDS`` of them."""
    known = train.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        held: dict[int, list] = {}
        for table in blocks(batches, BLOCK):
            buckets, bounds = features(table.column("text"))
            values = scaled_rows(buckets, bounds, known.value).astype(np.float32)
            y = table.column("y").to_numpy()
            for i, shard in enumerate(table.column("shard").to_pylist()):
                held.setdefault(shard, []).append((y[i], buckets[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]]))
        for shard, rows in held.items():
            sizes = np.array([len(b) for _, b, _ in rows])
            parts = [np.array([y for y, _, _ in rows], np.int8), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.concatenate([b for _, b, _ in rows]), np.concatenate([v for _, _, v in rows])]
            columns = [pa.array([shard], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "y", "bounds", "buckets", "data"])

    shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int").alias("shard")
    rows = train.select("text", "y", shard, F.xxhash64(F.lit(1), "id", "text").alias("at")).repartition(SHARDS, "shard").sortWithinPartitions("shard", "at")
    return stored(rows.drop("at").mapInArrow(run, "shard int, y binary, bounds binary, buckets binary, data binary"), folder, "shards")


def descended(y: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray, duals: np.ndarray, weights: np.ndarray, bias: float, shards: int, seed: int):
    """A shard's new dual variables and its step of weights and bias; ``shards`` is how many take steps at once."""
    moved, moved_bias = weights.copy(), bias
    duals = duals.copy()
    signs = np.where(y == 1, 1.0, -1.0)
    rows = [(buckets[a:b], values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    squares = [float(v @ v) + BIAS * BIAS for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)).tolist():
            own, value = rows[i]
            gap = 1 - signs[i] * (float(moved[own] @ value) + moved_bias * BIAS)
            new = min(max(duals[i] + gap / (shards * squares[i]), 0.0), BOUND)
            step = new - duals[i]
            if step:
                duals[i] = new
                # within the shard a step counts for all shards
                moved[own] += shards * step * signs[i] * value
                moved_bias += shards * step * signs[i] * BIAS
    return duals, (moved - weights) / shards, (moved_bias - bias) / shards


def _weights(shards: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss model, the shards' steps added in ``ROUNDS`` jobs."""
    spark = shards.sparkSession
    weights, bias, duals = np.zeros(BUCKETS), 0.0, {}
    count = shards.count()
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((weights, bias, duals))  # BUCKETS weights, 2 * SAMPLE dual variables

        def run(batches, state=state, turn=turn):
            weights, bias, duals = state.value
            for batch in batches:
                for shard, *packed in zip(*(batch.column(c) for c in ("shard", "y", "bounds", "buckets", "data")), strict=True):
                    y, bounds, buckets, values = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int8, np.int64, np.int32, np.float32), strict=True))
                    own = duals.get(shard.as_py(), np.zeros(len(y)))
                    new, step, step_bias = descended(y, bounds, buckets, values.astype(np.float64), own, weights, bias, count, turn)
                    columns = [pa.array([shard.as_py()], pa.int32()), pa.array([new.tobytes()]), pa.array([step.astype(np.float32).tobytes()]), pa.array([step_bias])]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "duals", "step", "bias"])

        for row in sorted(shards.mapInArrow(run, "shard int, duals binary, step binary, bias double").collect()):  # SHARDS rows
            duals[row.shard] = np.frombuffer(row.duals, np.float64)
            weights = weights + np.frombuffer(row.step, np.float32)
            bias += row.bias
        state.destroy()
    return weights, bias * BIAS


def logistic(values: np.ndarray, y: np.ndarray, stands: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic function of the margins, by Newton steps; the slope is never negative."""
    # targets just inside 0 and 1, as with few rows of a class both would run away
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    stands = stands / stands.mean()
    for slopes in (2, 1):
        own = np.column_stack((np.ones(len(values)), values))[:, :slopes]
        w = np.zeros(slopes)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            bend = (own * (stands * p * (1 - p))[:, None]).T @ own + 1e-6 * np.eye(slopes)
            step = np.linalg.solve(bend, own.T @ (stands * (target - p)))
            w += step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if slopes == 1 or w[1] >= 0:
            return (float(w[1]) if slopes == 2 else 0.0), float(w[0])
    raise AssertionError


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns ratios, weights and the logistic function from the labelled rows that are not held out."""
    folder = shared_folder(docs.sparkSession, "quality")
    rows = _labelled(docs, labels, id_column, text_column, label_column)
    counts = {(r.y, r.kept): r["count"] for r in rows.groupBy("y", (F.col("fold") == 0).alias("kept")).count().collect()}
    of = [sum(n for (label, _), n in counts.items() if label == y) for y in (0, 1)]
    plain = np.zeros(BUCKETS)
    if not of[0] or not of[1]:
        return Model(plain, plain, 0.0, 0.0, 36.0 if of[1] else -36.0)
    # where a class has too few rows to keep some for the logistic function, all rows serve both
    apart = all(counts.get((y, kept), 0) >= 5 for y in (0, 1) for kept in (True, False))
    learnt, kept = (F.col("fold") != 0, F.col("fold") == 0) if apart else (F.lit(True), F.lit(True))
    ratios = _ratios(rows.where(learnt))
    # of each class all rows, or about ``sample``
    part = F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1))
    shares = [int(min(1.0, sample / n) * (1 << 32)) for n in of]
    chosen = rows.where(part < F.when(F.col("y") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0])))
    weights, bias = _weights(_shards(chosen.where(learnt), ratios, folder))
    rough = Model(ratios, weights, bias, 1.0, 0.0)
    held = docs.sparkSession.sparkContext.broadcast(rough)

    def measure(batches):
        for table in blocks(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(margins(held.value, table.column("text"))), table.column("y").combine_chunks()], ["margin", "y"])

    found = np.array(chosen.where(kept).select("text", "y").mapInArrow(measure, "margin double, y int").collect(), float).reshape(-1, 2)  # 2 * sample rows
    stands = np.where(found[:, 1] == 1, (1 << 32) / max(1, shares[1]), (1 << 32) / max(1, shares[0]))
    slope, base = logistic(found[:, 0], found[:, 1], stands)
    held.destroy()
    return Model(ratios, weights, bias, slope, base)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_column, score, predicted, margin`` of each text; ``predicted`` is 1 from ``threshold`` on."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a bucket

    def run(batches):
        for table in blocks(batches, BLOCK):
            found = margins(held.value, table.column("text"))
            values = 1 / (1 + np.exp(-np.clip(held.value.base + held.value.slope * found, -36, 36)))
            columns = [pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array(found)]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], [id_column, "score", "predicted", "margin"])

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int, margin double")
