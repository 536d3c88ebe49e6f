"""Reports over complaint keywords and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.functions.common import or_all, text_or_empty
from voxtally.functions.keywords import categories_in, keywords_in, split_joined
from voxtally.functions.text import highlight
from voxtally.operators.audit import sample_text
from voxtally.operators.reports import NEGATIVE, POSITIVE, percent
from voxtally.rules import Dictionary


def keyword_frequency(df: DataFrame, keywords: Column | None = None) -> DataFrame:
    """``(keyword, records)``; spelling in capitals or not makes no difference.

    The groups are the dictionary's phrases, so partial counts leave each task
    as a few hundred rows.
    """
    listed = split_joined(F.col("Negative_Keywords")) if keywords is None else keywords
    return (
        df.select(F.explode_outer(listed).alias("keyword"))
        .where(F.col("keyword").isNotNull())
        .groupBy(F.lower("keyword").alias("keyword"))
        .agg(F.count("*").alias("records"))
    )


def top_keywords(df: DataFrame, size: int = 7, keywords: Column | None = None) -> DataFrame:
    return keyword_frequency(df, keywords).orderBy(F.desc("records"), "keyword").limit(size)


def category_summary(df: DataFrame, dictionary: Dictionary, text: str = "Text_For_Analysis") -> DataFrame:
    """Rows with a phrase of each category, in one pass; categories without any are left out."""
    used = [c for c, phrases in dictionary.categories.items() if phrases]
    one = df.select(categories_in(F.col(text), dictionary).alias("_categories")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.array_contains("_categories", c)).alias(f"_{i}") for i, c in enumerate(used)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(category).alias("category"),
                F.lit(category.replace("_", " ").title()).alias("label"),
                F.col(f"_{i}").alias("records"),
                percent(F.col(f"_{i}"), F.col("total")).alias("pct"),
            )
            for i, category in enumerate(used)
        ]
    )
    return one.select(F.inline(rows)).where(F.col("records") > 0).orderBy(F.desc("records"), "ordinal")


def by_category(df: DataFrame, dictionary: Dictionary, text: str, *keep: Column | str) -> DataFrame:
    """One narrow row per record and matched category.

    What is kept is computed before the records are multiplied.  The outer explode
    keeps the optimizer from deriving a filter on the array, which would search
    the text a second and third time.
    """
    matched = df.select(categories_in(F.col(text), dictionary).alias("_categories"), *keep)
    others = [c for c in matched.columns if c != "_categories"]
    exploded = matched.select(F.explode_outer("_categories").alias("category"), *others)
    return exploded.where(F.col("category").isNotNull())


def category_mix(
    df: DataFrame, dictionary: Dictionary, text: str = "Text_For_Analysis", label: str = "consumer_sentiment"
) -> DataFrame:
    """Positive, neutral and negative rows of every category."""
    return (
        by_category(df, dictionary, text, F.col(label).alias("_label"))
        .groupBy("category")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("_label").isin(POSITIVE)).alias("positive"),
            F.count_if(F.col("_label") == "Neutral").alias("neutral"),
            F.count_if(F.col("_label").isin(NEGATIVE)).alias("negative"),
        )
        .select(
            "*",
            percent(F.col("positive"), F.col("records")).alias("positive_pct"),
            percent(F.col("negative"), F.col("records")).alias("negative_pct"),
        )
    )


def category_keywords(
    df: DataFrame, dictionary: Dictionary, text: str = "Text_For_Analysis", size: int = 15
) -> DataFrame:
    """The most frequent keywords of every category.

    Only phrases of the category itself count; where none of them was extracted
    (longer phrases of other categories took their place), all keywords of its
    records do.  Ranking happens on counts, which the dictionary bounds.
    """
    own = or_all(
        [
            (F.col("category") == category) & F.col("keyword").isin([p.lower() for p in phrases])
            for category, phrases in dictionary.categories.items()
        ]
    )
    counts = (
        by_category(df, dictionary, text, keywords_in(F.col(text), dictionary).alias("_k"))
        .select("category", F.explode_outer("_k").alias("keyword"))
        .where(F.col("keyword").isNotNull())
        .groupBy("category", F.lower("keyword").alias("keyword"))
        .agg(F.count("*").alias("records"))
    )
    has_own = F.max("own").over(Window.partitionBy("category"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("records"), "keyword"))
    return (
        counts.withColumn("own", own)
        .withColumn("_any", has_own)
        .where(F.col("own") | ~F.col("_any"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= size)
        .select("category", "rank", "keyword", "records")
    )


def category_samples(
    df: DataFrame,
    dictionary: Dictionary,
    row_key: str,
    text: str = "Text_For_Analysis",
    size: int = 3,
    redacted: bool = False,
    mark: str = "",
) -> DataFrame:
    """The first texts of every category, shortened and, with a ``mark``, highlighted.

    One scan: keys carry their shortened text, and a group limit keeps ``size`` per task and
    category before anything is shuffled.  Redaction looks at whole texts, so redacted samples are ranked
    by key alone and the chosen ones, at most ``size`` times the number of categories, joined back.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(row_key))
    if redacted:
        chosen = by_category(df, dictionary, text, F.col(row_key)).withColumn("rank", rank).where(F.col("rank") <= size)
        shown = sample_text(text_or_empty(F.col(text)), redacted)
        joined = df.select(row_key, text).join(F.broadcast(chosen), row_key)
    else:
        short = sample_text(text_or_empty(F.col(text))).alias("_short")
        joined = by_category(df, dictionary, text, F.col(row_key), short).withColumn("rank", rank).where(F.col("rank") <= size)
        shown = F.col("_short")
    if mark:
        marked = F.lit(None).cast("string")
        for category, phrases in dictionary.categories.items():
            marked = F.when(F.col("category") == category, highlight(shown, phrases, mark)).otherwise(marked)
        shown = marked
    return joined.select("category", "rank", row_key, shown.alias("sample"))
