"""What kind of table is this: text column, id column, format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxtally import fixed_values as fixed
from voxtally.session import shared_path

APPROXIMATION = 0.02
BUCKETS = 4096
SMALL_BUCKET = 50_000


def mean_lengths(df: DataFrame) -> DataFrame:
    """``(column, ordinal, mean_length)`` of all string columns, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, ordinal int, mean_length double")
    one = df.agg(*[F.avg(F.length(F.col(f"`{n}`"))).alias(f"_{i}") for i, n in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.lit(i).alias("ordinal"), F.col(f"_{i}").alias("mean_length"))
            for i, n in enumerate(names)
        ]
    )
    return one.select(F.inline(rows))


def infer_text_column(df: DataFrame, least: float = 15.0) -> str | None:
    """The string column with the longest texts on average; none below 15 characters."""
    best = (
        mean_lengths(df)
        .where(F.col("mean_length") >= least)
        .orderBy(F.desc("mean_length"), "ordinal")
        .limit(1)
        .collect()
    )
    return best[0]["column"] if best else None


def infer_id_column(df: DataFrame, text_column: str, names: Sequence[str] = fixed.ID_COLUMN_NAMES) -> str | None:
    """A column with a usual name, else the first with distinct values on half of the rows.

    Distinct counts are approximate; only a column too close to one half to tell
    is counted exactly.
    """
    for name in names:
        if name in df.columns:
            return name
    countable = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    others = [c for c in countable if c != text_column]
    if not others:
        return None
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.approx_count_distinct(F.col(f"`{c}`"), APPROXIMATION).alias(f"_{i}") for i, c in enumerate(others)],
    ).first()
    rows = max(counts["_rows"], 1)
    for i, name in enumerate(others):
        ratio = counts[f"_{i}"] / rows
        if abs(ratio - 0.5) < 5 * APPROXIMATION * max(ratio, 0.5):
            exact = df.agg(F.countDistinct(F.col(f"`{name}`")).alias("n")).first()["n"]
            ratio = exact / rows
        if ratio >= 0.5:
            return name
    return None


def evenly_spaced(df: DataFrame, order: str, size: int = 8, among: Column | None = None) -> DataFrame:
    """At most ``size`` rows at even distances in the order of a whole-number key, of those ``among`` holds for.

    The keys are stored once, so that ``among`` is not computed for each count.
    Wanted keys are found by counting them in buckets and looking closer only into
    the buckets that hold a wanted position: no global sort and no single-task
    window over the table.  One more scan fetches their rows, by key
    before anything else is computed of them.  Adds ``sample_position`` from 0.
    """
    path = shared_path(df.sparkSession, "sample-keys")
    among = F.lit(True) if among is None else among
    df.where(among).select(F.col(order).cast("long").alias("_k")).where(F.col("_k").isNotNull()).write.parquet(path)
    keys = df.sparkSession.read.schema("_k long").parquet(path)
    bounds = keys.agg(F.count("*").alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).first()
    if not bounds["n"]:
        return df.withColumn("sample_position", F.lit(None).cast("int")).limit(0)
    k = min(size, bounds["n"])
    wanted = [i * (bounds["n"] - 1) // max(k - 1, 1) for i in range(k)]

    # (lowest key, highest key, rows before, rows inside, wanted positions)
    ranges = [(bounds["lo"], bounds["hi"], 0, bounds["n"], wanted)]
    while any(n > SMALL_BUCKET and lo < hi for lo, hi, _, n, _ in ranges):
        ranges = _closer(keys, ranges)

    # rows of one key are alike in order: any of them will do, and no task needs to see them all
    hot = [r for r in ranges if r[3] > SMALL_BUCKET]
    parts = [_any_rows(df, order, lo, among, [wanted.index(t) for t in targets]) for lo, _, _, _, targets in hot]
    narrow = [r for r in ranges if r[3] <= SMALL_BUCKET]
    if narrow:
        parts.append(_rows_of_keys(df, order, among, _ranked_keys(keys, narrow, wanted)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _any_rows(df: DataFrame, order: str, key: int, among: Column, positions: list[int]) -> DataFrame:
    """As many rows of this key as there are positions."""
    few = df.where(F.col(order) == key).where(among).limit(len(positions))
    place = F.row_number().over(Window.partitionBy().orderBy(order))
    return few.withColumn("sample_position", F.element_at(F.array(*[F.lit(p) for p in positions]), place))


def _ranked_keys(keys: DataFrame, ranges: list, wanted: list[int]) -> dict[int, list[int]]:
    """The keys at the wanted positions of ranges of at most ``SMALL_BUCKET`` rows, ranked within each range, with their positions."""
    bucket, start = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (lo, hi, before, _, _) in enumerate(ranges):
        within = F.col("_k").between(lo, hi)
        bucket, start = F.when(within, F.lit(i)).otherwise(bucket), F.when(within, F.lit(before)).otherwise(start)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_k")) - 1 + F.col("_start")
    ranked = keys.withColumns({"_bucket": bucket, "_start": start}).where(F.col("_bucket").isNotNull()).withColumn("_rank", rank)
    found: dict[int, list[int]] = {}
    for row in ranked.where(F.col("_rank").isin(wanted)).orderBy("_rank").collect():  # a row for each wanted position
        found.setdefault(row["_k"], []).append(wanted.index(row["_rank"]))
    return found


def _rows_of_keys(df: DataFrame, order: str, among: Column, found: dict[int, list[int]]) -> DataFrame:
    """As many rows of each key as it has positions."""
    key = F.col(order).cast("long")
    place = F.row_number().over(Window.partitionBy(order).orderBy(order))
    position = F.lit(None).cast("int")
    for k, positions in found.items():
        position = F.when(key == k, F.get(F.array(*[F.lit(p) for p in positions]), F.col("_place") - 1)).otherwise(position)
    few = df.where(key.isin(list(found))).where(among).withColumn("_place", place).where(F.col("_place") <= max(map(len, found.values())))
    return few.withColumn("sample_position", position).where(F.col("sample_position").isNotNull()).drop("_place")


def _closer(keys: DataFrame, ranges: list) -> list:
    """The parts of the ranges that hold a wanted position; all large ranges are counted in one job."""
    number, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    widths = {}
    for i, (lo, hi, _, rows, _) in enumerate(ranges):
        if rows > SMALL_BUCKET and lo < hi:
            widths[i] = (hi - lo) // BUCKETS + 1
            within = F.col("_k").between(lo, hi)
            place = F.expr(f"(CAST(_k AS DECIMAL(20, 0)) - ({lo})) DIV {widths[i]}")
            number, bucket = F.when(within, F.lit(i)).otherwise(number), F.when(within, place).otherwise(bucket)
    counted = keys.select(number.alias("i"), bucket.alias("b")).where("i IS NOT NULL").groupBy("i", "b").count()
    counts: dict[int, list[tuple[int, int]]] = {}
    for row in counted.collect():  # BUCKETS for each wanted position at most
        counts.setdefault(row["i"], []).append((row["b"], row["count"]))
    out = []
    for i, (lo, hi, before, rows, targets) in enumerate(ranges):
        if i not in widths:
            out.append((lo, hi, before, rows, targets))
            continue
        seen = before
        for place, count in sorted(counts[i]):
            inside = [t for t in targets if seen <= t < seen + count]
            if inside:
                first = lo + place * widths[i]
                out.append((first, min(first + widths[i] - 1, hi), seen, count, inside))
            seen += count
    return out


def format_of(sample: Column) -> Column:
    """Profile name for a text sampled from the table."""
    bracket = sample.rlike("(?iU)" + fixed.FORMAT_BRACKET)
    pipe = sample.rlike("(?isU)" + fixed.FORMAT_PIPE_DATED) | (
        F.contains(sample, F.lit("|")) & sample.rlike("(?iU)" + fixed.FORMAT_PIPE)
    )
    tagged = sample.rlike("(?iU)" + fixed.FORMAT_TAGGED) | sample.rlike("(?U)" + fixed.FORMAT_SMS)
    return (
        F.when(bracket, F.lit("bracket_chat"))
        .when(pipe, F.lit("pipe_chat"))
        .when(tagged, F.lit("tagged_chat"))
        .otherwise(F.lit("review"))
    )


def detect_format(df: DataFrame, text_column: str, order: str) -> DataFrame:
    """One row ``(profile)`` from at most eight evenly spaced texts."""
    texts = df.select(order, F.col(text_column).alias("_t"))
    sample = evenly_spaced(texts, order, among=F.col("_t").isNotNull()).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("sample_position", "_t"))), lambda s: s["_t"]
            ),
            " ",
        ).alias("_sample")
    )
    return sample.select(format_of(F.col("_sample")).alias("profile"))


def detect(df: DataFrame, order: str) -> tuple[str, str, str] | None:
    """``(profile, id column, text column)`` or nothing if a role cannot be filled."""
    text_column = infer_text_column(df)
    if text_column is None:
        return None
    id_column = infer_id_column(df, text_column)
    if id_column is None:
        return None
    return detect_format(df, text_column, order).first()["profile"], id_column, text_column
