"""Keyed look-ups: overrides, predictions and translations are joins.

A side is broadcast only after its size in bytes was measured.  Beyond the limit
the join is shuffled; where only some rows ask, only their keys are sent to the large side, and
rows that do not ask are never shuffled.  Where the key of the large side may be hot (business
ids repeat) its heavy keys are counted and only these are salted, each by its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.session import cut_lineage

BROADCAST_BYTES = 32 * 1024 * 1024
#: A key with more than one in so many rows is heavy; there are fewer heavy keys than that.
HEAVY = 256
#: Tasks that the rows of all heavy keys together are dealt to, about.
SPREAD = 1024


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a narrow table: strings by their length, 32 an entry of a map, 8 for anything else."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        size = F.octet_length(name) if kind == "string" else F.size(name) * 32 if kind.startswith("map") else F.lit(8)
        total = total + F.coalesce(size, F.lit(0)) + 8
    return int(df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot_keys: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of a narrow table that is unique by ``key``; rows of ``left`` stay as they are."""
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    if measured_bytes(right) <= max_bytes:
        return left.join(F.broadcast(right), key, "left").select(*columns)
    if not hot_keys:
        return left.join(right, key, "left").select(*columns)

    salts = _salts(left, key)

    def dealt(name: str) -> Column:
        if not salts:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
        # a null key matches nothing, so its rows may go anywhere
        return F.coalesce(F.when(F.col(name).isNull(), F.lit(SPREAD)), F.try_element_at(table, F.col(name).cast("string")), F.lit(1))

    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), dealt(key) - 1)))
    turn = F.pmod(F.monotonically_increasing_id(), dealt(key)).cast("int")
    return left.withColumn("_salt", turn).join(salted.hint("merge"), [key, "_salt"], "left").select(*columns)


def gated_join(
    left: DataFrame, right: DataFrame, key: str, gate: Column, max_bytes: int = BROADCAST_BYTES, hit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``lookup_join`` for the rows of ``left`` that pass ``gate``; the others get nulls.

    A right side above ``max_bytes`` meets nothing but the keys of the rows that ask, both sides being as
    narrow as the right one; where these keys are few they are broadcast and the right side stays where
    it is.  See ``attached`` for the way back.
    """
    gate = F.coalesce(gate, F.lit(False))
    if measured_bytes(right) <= max_bytes:
        joined = left.join(F.broadcast(right), key, "left")
        return _gated(joined, left, right, key, gate)
    asked = cut_lineage(left.where(gate & F.col(key).isNotNull()).select(key).distinct())
    few = measured_bytes(asked) <= min(max_bytes, BROADCAST_BYTES)
    hits = right.join(F.broadcast(asked) if few else asked, key, "left_semi")
    return attached(left, cut_lineage(hits), key, gate, hit_bytes)


def attached(left: DataFrame, hits: DataFrame, key: str, gate: Column, hit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """What was found for the rows that pass ``gate`` joined back to them.

    Up to ``hit_bytes`` it is broadcast, so no row of ``left`` is shuffled; beyond, only the rows that asked are.
    """
    gate = F.coalesce(gate, F.lit(False))
    if measured_bytes(hits) <= hit_bytes:
        return _gated(left.join(F.broadcast(hits), key, "left"), left, hits, key, gate)
    names = [*left.columns, *[c for c in hits.columns if c != key]]
    asking = left.where(gate).join(hits.hint("merge"), key, "left").select(*names)
    nulls = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in names[len(left.columns) :]]
    return left.where(~gate).select(*left.columns, *nulls).unionByName(asking)


def _gated(joined: DataFrame, left: DataFrame, right: DataFrame, key: str, gate: Column) -> DataFrame:
    added = [F.when(gate, F.col(c)).alias(c) for c in right.columns if c != key]
    return joined.select(*left.columns, *added)


def _salts(left: DataFrame, key: str) -> dict[str, int]:
    """Heavy keys and the number of parts that each is split into."""
    counts = left.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where((F.col("n") * HEAVY > total) & F.col("k").isNotNull()).collect()
    return {r.k: 1 + r.n * SPREAD // total for r in heavy}


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value that comes last.  Combined map-side, so a hot key is cheap."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
