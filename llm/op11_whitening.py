"""Embedding whitening by a covariance over distinct vectors.

Entries become whole numbers, ``x = floor(64 * c) + 1000000``, so that equal vectors can be
grouped and sums are exact.  Identical x vectors are one row with their multiplicity; a fit
weighs each by one or by that count.  The covariance is a weighted product of centred
blocks: each task multiplies its blocks into one small matrix, entries of these matrices are
added up by a grouped sum.  The driver sees nothing but that matrix (components squared) and
decomposes it.  Each distinct vector is whitened once and joined back to its rows.

Deviations from the mean are computed as ``n * x - S`` in whole numbers before anything is
rounded, so the offset of a million costs no precision.  Where 64 bits would not hold them,
Python's whole numbers take over.

Rows find their distinct vector by a 128-bit key, which is proved to be unique over the
distinct vectors before it is used; a hot vector is a skewed join, which adaptive execution
splits, and is combined map-side when vectors are grouped.

Contract: rows whose vector is null, empty or holds null or non-finite entries are dropped;
null and repeated ids stay, each row for itself.  Vectors of each number of entries are
fitted and whitened among themselves.  Components whose eigenvalue is nothing but rounding
(below ``entries * 2**-52`` of the largest, as with a single distinct vector) have no whitened
value and are not returned.  Scaled entries beyond the range of a long stay at its ends; a deviation of more than 38 digits is null.  Other
columns of the table take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import shared_folder, stored

#: Scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: The largest whole number that a sum of products may reach in 64 bits, with room for one more addition.
SAFE = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What is known of the vectors of one number of entries: their number, sums and components."""

    n: int
    sums: tuple[int, ...]
    #: unit eigenvectors in columns, their eigenvalues, and the trace of the covariance
    axes: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Entries as ``floor(scale * c) + offset``, or null where the vector takes no part."""
    entries = vector.cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    end = (1 << 63) - 1
    whole = F.transform(entries, lambda c: F.least(F.floor(F.lit(float(scale)) * c).cast("long"), F.lit(end - offset)) + F.lit(offset))
    return F.when(entries.isNotNull() & (F.size(entries) > 0) & ~odd, whole)


def _blocks(batches):
    """Matrices of the vectors of a batch, by number of entries: ``dim, rows of the batch, matrix``."""
    for batch in batches:
        lists = batch.column("x")
        sizes = np.array(lists.value_lengths())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            yield batch, dim, rows, flat[starts[rows][:, None] + np.arange(dim)]


def centred(matrix: np.ndarray, fit: Fit) -> np.ndarray:
    """``n * x - S`` in whole numbers, 64-bit ones where they hold them."""
    sums = np.array(fit.sums, object)
    most = max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0)))) * fit.n + max(map(abs, fit.sums))
    if most < SAFE:
        return matrix * np.int64(fit.n) - sums.astype(np.int64)
    return matrix.astype(object) * fit.n - sums


def squares(deviation: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact; null above 38 digits."""
    most = max(abs(int(deviation.max(initial=0))), abs(int(deviation.min(initial=0))))
    kind = pa.decimal128(38, 0)
    if deviation.dtype != object and most * most * deviation.shape[1] < SAFE:
        return pa.array((deviation * deviation).sum(1)).cast(kind)
    sums = [sum(int(d) * int(d) for d in row) for row in deviation]
    return pa.array([value if value < 10**38 else None for value in sums], kind)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``x, copies, k1, k2``: every distinct vector once, with its multiplicity and its key."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x", "copies", *_key())


def _key() -> list[Column]:
    return [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(OFFSET), "x").alias("k2")]


def _sums(distinct: DataFrame, weight: Column) -> dict[int, tuple[int, list[int]]]:
    """For each number of entries, the weights and the weighted sums of the entries, exact."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch, dim, rows, matrix in _blocks(batches):
            weights = batch.column("weight").to_numpy()[rows]
            most = max(abs(int(matrix.max())), abs(int(matrix.min()))) * int(weights.sum())
            total = (matrix * weights[:, None]).sum(0) if most < SAFE else (matrix.astype(object) * weights[:, None]).sum(0)
            held[dim] = held.get(dim, 0) + total.astype(object)
            counts[dim] = counts.get(dim, 0) + int(weights.sum())
        for dim, total in held.items():
            values = [counts[dim], *map(int, total)]
            columns = [pa.array([dim] * len(values), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array(values, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "place", "total"])

    parts = distinct.select("x", weight.alias("weight")).mapInArrow(add, "dim int, place int, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(parts.groupBy("dim", "place").agg(F.sum("total").alias("total")).collect()):  # a number for each entry
        if row.place < 0:
            out[row.dim] = (int(row.total), [])
        else:
            out[row.dim][1].append(int(row.total))
    return out


def _covariances(rows: DataFrame, values_of: Callable, totals: dict[int, float]) -> dict[int, np.ndarray]:
    """Weighted products of centred blocks, added up over all tasks and divided by the weights.

    ``values_of`` gives the centred values of ``dim, matrix``.  The upper triangle of each task's
    matrix goes into one grouped sum.
    """

    def multiply(batches):
        held: dict[int, np.ndarray] = {}
        for batch, dim, chosen, matrix in _blocks(batches):
            values = values_of(dim, matrix)
            weights = batch.column("weight").to_numpy()[chosen].astype(np.float64)
            held[dim] = held.get(dim, 0) + values.T @ (values * weights[:, None])
        for dim, product in held.items():
            i, j = np.triu_indices(product.shape[0])
            columns = [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(product[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", "v"])

    parts = rows.mapInArrow(multiply, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    found = parts.collect()  # half a matrix for each number of entries
    sizes = {dim: 1 + max(r.j for r in found if r.dim == dim) for dim in {r.dim for r in found}}
    for row in found:
        matrix = out.setdefault(row.dim, np.zeros((sizes[row.dim],) * 2))
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.v / totals[row.dim]
    return out


def fit(distinct: DataFrame, weights: str = "one", components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each number of entries over the stored ``distinct`` vectors.

    ``weights``: ``one`` weighs each distinct vector alike, ``counts`` by its multiplicity, which is
    the covariance of all rows.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights are 'one' or 'counts', not {weights!r}")
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    held = {dim: Fit(n, tuple(sums), np.empty(0), np.empty(0), 0.0) for dim, (n, sums) in _sums(distinct, weight).items()}
    known = distinct.sparkSession.sparkContext.broadcast(held)  # a number for each entry

    def values_of(dim: int, matrix: np.ndarray) -> np.ndarray:
        own = known.value[dim]
        return centred(matrix, own).astype(np.float64) / own.n

    covariances = _covariances(distinct.select("x", weight.alias("weight")), values_of, {dim: float(own.n) for dim, own in held.items()})
    out = {}
    for dim, covariance in covariances.items():
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        keep = values > max(values[0], 0) * dim * 2.0**-52
        keep[components:] = False
        axes = axes[:, keep]
        if axes.shape[1]:  # the largest entry of a component is positive
            axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        out[dim] = Fit(held[dim].n, held[dim].sums, axes, values[keep], float(np.trace(covariance)))
    known.destroy()
    return out


def whitened_vectors(distinct: DataFrame, fits: dict[int, Fit], weights: str = "one") -> DataFrame:
    """``k1, k2, dim, weight, deviation, x`` of each distinct vector, ``x`` being its whitened values."""
    known = distinct.sparkSession.sparkContext.broadcast(fits)  # components times entries
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")

    def whiten(batches):
        for batch, dim, rows, matrix in _blocks(batches):
            own = known.value[dim]
            deviation = centred(matrix, own)
            values = (deviation.astype(np.float64) / own.n) @ own.axes / np.sqrt(own.values)
            bounds = np.arange(len(rows) + 1) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.ravel()))
            taken = [batch.column(c).take(pa.array(rows)) for c in ("k1", "k2", "weight")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(rows), dim, np.int32)), squares(deviation), lists], ["k1", "k2", "weight", "dim", "deviation", "x"])

    source = distinct.select("x", "k1", "k2", weight.alias("weight"))
    return source.mapInArrow(whiten, "k1 bigint, k2 bigint, weight bigint, dim int, deviation decimal(38,0), x array<double>")


def identity_errors(whitened: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened values' covariance minus the identity, by number of entries.

    Measured on the stored values: their means first, then products of what is centred.
    """
    at = F.posexplode("x").alias("place", "v")
    mean = F.sum(F.col("v") * F.col("weight")) / F.sum("weight")
    means: dict[int, dict[int, float]] = {}
    for row in whitened.select("dim", "weight", at).groupBy("dim", "place").agg(mean.alias("mean")).collect():  # a number for each component
        means.setdefault(row.dim, {})[row.place] = row["mean"]
    if not means:
        return {}
    # vectors of different widths can have as many components
    out = {}
    for dim, own in means.items():
        centre = np.array([own[i] for i in range(len(own))])
        totals = {len(centre): float(fits[dim].n)}
        covariance = _covariances(whitened.where(F.col("dim") == dim).select("x", "weight"), lambda _, m, c=centre: m - c, totals)
        out[dim] = float(np.abs(covariance[len(centre)] - np.eye(len(centre))).max())
    return out


def whiten(
    vectors: DataFrame, weights: str = "one", components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """One row per row and component: ``id_column, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is a decimal, exact at any size.
    """
    folder = shared_folder(vectors.sparkSession, "whitening")
    rows = vectors.select(F.col(f"`{id_column}`").alias("row_id"), whole_numbers(F.col(f"`{vector_column}`"), scale, offset).alias("x")).where("x IS NOT NULL")
    distinct = stored(distinct_vectors(rows), folder, "distinct")
    if distinct.groupBy("k1", "k2").count().where("count > 1").limit(1).collect():
        raise ValueError("two distinct vectors share a 128-bit key")
    fits = fit(distinct, weights, components)
    whitened = stored(whitened_vectors(distinct, fits, weights), folder, "whitened")
    errors = identity_errors(whitened, fits)
    facts = [(dim, own.n, [float(e / own.trace) for e in own.values], errors[dim]) for dim, own in fits.items() if dim in errors]
    facts = vectors.sparkSession.createDataFrame(facts, "dim int, n bigint, shares array<double>, identity_error double")
    keyed = rows.select("row_id", *_key())
    joined = keyed.join(whitened.select("k1", "k2", "dim", "deviation", "x"), ["k1", "k2"]).join(F.broadcast(facts), "dim")  # a row for each number of entries
    out = joined.select("row_id", "n", "deviation", "shares", "identity_error", F.posexplode("x").alias("place", "whitened"))
    return out.select(
        F.col("row_id").alias(id_column),
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at("shares", F.col("place") + 1).alias("explained"),
        "identity_error",
    )
