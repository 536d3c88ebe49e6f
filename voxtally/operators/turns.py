"""Turn tables: one row per message, ``(conversation, position, speaker, message)``.

A conversation may hold any share of all rows.  Counts and picks are combined
map-side; messages are gathered in segments of a bounded number of positions
first, then a conversation's segments are joined into its one text.

Speakers are compared without regard to case and outer white space, as in the
one-cell form, and results carry them in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.common import squeeze, strip
from voxtally.functions.transcripts import looks_like_agent

#: Positions gathered at once; any value gives the same texts.
SEGMENT = 1000


def _named(turns: DataFrame, speaker: str) -> DataFrame:
    return turns.withColumn(speaker, F.lower(strip(F.col(speaker))))


def speaker_counts(turns: DataFrame, conversation: str, speaker: str, position: str) -> DataFrame:
    """Messages per speaker and the position of the first one."""
    return _named(turns, speaker).groupBy(conversation, speaker).agg(
        F.count("*").alias("messages"), F.min(position).alias("first_position")
    )


def _picked(turns: DataFrame, conversation: str, speaker: str, position: str, digits_first: bool) -> DataFrame:
    """One row per conversation: the customer, with the number of their messages and the first position."""
    name = F.col(speaker)
    people = (
        _named(turns, speaker)
        .where(name != "system")
        .groupBy(conversation, speaker)
        .agg(F.count("*").alias("messages"), F.min(position).alias("first_position"))
    )
    number = F.coalesce(name.rlike(r"(?U)^\d+$"), F.lit(False)) if digits_first else F.lit(False)
    # among numbers the earliest wins, whatever their counts
    rank = F.struct(
        F.when(number, 0).otherwise(1).alias("no_number"),
        F.when(number, 0).otherwise(looks_like_agent(name).cast("int")).alias("agent"),
        F.when(number, 0).otherwise(F.col("messages")).alias("rank_messages"),
        F.col("first_position"),
        F.col("messages"),
        name.alias("speaker"),
    )
    return (
        people.groupBy(conversation)
        .agg(F.min(rank).alias("_pick"))
        .select(
            conversation,
            F.col("_pick.speaker").alias(speaker),
            F.col("_pick.messages").alias("messages"),
            F.col("_pick.first_position").alias("first_position"),
        )
    )


def pick_customer(
    turns: DataFrame, conversation: str, speaker: str, position: str, digits_first: bool = False, message: str | None = None
) -> DataFrame:
    """The customer of each conversation: ``system`` never, then the rank of the one-cell form.

    With ``digits_first`` and a ``message`` column, empty messages do not count.
    """
    return _picked(_spoken(turns, message, digits_first), conversation, speaker, position, digits_first)


def _spoken(turns: DataFrame, message: str | None, digits_first: bool) -> DataFrame:
    return turns.where(squeeze(F.col(message)) != "") if digits_first and message else turns


def customer_text(
    turns: DataFrame, conversation: str, speaker: str, position: str, message: str, digits_first: bool = False
) -> DataFrame:
    """The customer's messages in order, one text per conversation.

    Messages are gathered per speaker and segment before the join with the pick, which
    then moves one row per segment.  (An inner join, because a semi join would be pushed
    below the gathering and meet the single turns.)
    """

    def in_order(key, text) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(key.alias("p"), text.alias("m"))))
        return F.array_join(F.filter(F.transform(rows, lambda t: t["m"]), lambda m: m != ""), " ")

    spoken = _named(_spoken(turns, message, digits_first), speaker)
    pieces = (
        spoken.where(F.col(speaker) != "system")
        .groupBy(conversation, speaker, F.floor(F.col(position) / SEGMENT).alias("_segment"))
        .agg(in_order(F.col(position), squeeze(F.col(message))).alias("_piece"))
    )
    chosen = _picked(spoken, conversation, speaker, position, digits_first).select(conversation, speaker)
    return (
        pieces.join(chosen, [conversation, speaker])
        .groupBy(conversation, speaker)
        .agg(in_order(F.col("_segment"), F.col("_piece")).alias("customer_text"))
    )
