"""Lexicon polarity as a DataFrame step, for lexicons of any size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.common import let, text_or_empty
from voxtally.functions.lexicon import Scorer, polarity, word_lookup, words_of
from voxtally.operators.lookups import BROADCAST_BYTES, attached, measured_bytes
from voxtally.session import cut_lineage

#: Bytes of a lexicon that goes into the plan as a literal; a larger one is joined.
LITERAL_BYTES = 1 << 20


def _unique(lexicon: DataFrame) -> DataFrame:
    """One row a token: of several valences the largest holds, whichever path is taken."""
    return lexicon.where("token IS NOT NULL").groupBy("token").agg(F.max("valence_tenths").alias("valence_tenths"))


def _known_words(df: DataFrame, row_key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``(row_key, _hits)``: the valences of a text's own words, a map never larger than the text.

    Each text sends its distinct words once, and where the tokens fit into the plan only those that the lexicon
    holds.  Frequent words are hot keys of that join, which adaptive execution splits.
    """
    own, unique = F.array_distinct(F.transform(words_of(text_or_empty(F.col(text))), F.lower)), _unique(lexicon)
    size = measured_bytes(unique)
    if size <= LITERAL_BYTES:
        tokens = dict.fromkeys((r.token for r in unique.select("token").collect()), 0)  # LITERAL_BYTES
        known = word_lookup(Scorer(tokens, (), (), ()))
        own = F.filter(own, lambda word: known(word).isNotNull())
    words = df.select(row_key, F.explode(own).alias("token"))
    found = words.join(F.broadcast(unique) if size <= BROADCAST_BYTES // 4 else unique, "token").groupBy(row_key)
    return found.agg(F.map_from_entries(F.collect_set(F.struct("token", "valence_tenths"))).alias("_hits"))


def _joined_lookup(scorer: Scorer) -> Callable[[Column], Column]:
    """What is known of a word: the valence from ``_hits``, the few modifiers from the plan."""
    modifiers = word_lookup(replace(scorer, lexicon={}))
    hits = F.coalesce(F.col("_hits"), F.create_map().cast("map<string,int>"))

    def lookup(word: Column) -> Column:
        return let(
            modifiers(word),
            lambda m: F.struct(
                F.try_element_at(hits, word).alias("tenths"), m["boost"].alias("boost"), m["negates"].alias("negates")
            ),
        )

    return lookup


class LexiconTable:
    """A lexicon ``(token, valence_tenths)`` of any size, for the scorers of an analysis.

    Below ``literal_bytes``, as measured, it becomes part of the scorer.  A larger one is joined to the
    words of those rows that are scored at all; ``row_key`` names the column that tells rows apart.
    """

    def __init__(
        self, lexicon: DataFrame, scorer: Scorer, row_key: str | None, literal_bytes: int = LITERAL_BYTES, hit_bytes: int = BROADCAST_BYTES
    ):
        self.lexicon, self.row_key, self.hit_bytes = lexicon, row_key, hit_bytes
        self.joins = measured_bytes(lexicon.select("token", "valence_tenths")) > literal_bytes
        if self.joins and row_key is None:
            raise ValueError("a lexicon of this size is joined and needs row_key")
        if not self.joins:
            rows = _unique(lexicon).collect()  # literal_bytes
            scorer = replace(scorer, lexicon={r.token: r.valence_tenths for r in rows})
        self.scorer = scorer

    def attach(self, df: DataFrame, text: str, gate: Column):
        """``df``, with the known words of the rows that pass ``gate`` if they come from a join, and the look-up of a word."""
        if not self.joins:
            return df, word_lookup(self.scorer)
        hits = _known_words(df.where(gate), self.row_key, text, self.lexicon)
        return attached(df, cut_lineage(hits), self.row_key, gate, self.hit_bytes), _joined_lookup(self.scorer)


class PlainLexicon:
    """The lexicon of the scorer itself."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def attach(self, df: DataFrame, text: str, gate: Column):
        return df, word_lookup(self.scorer)


def polarity_by_join(
    df: DataFrame, row_key: str, text: str, lexicon: DataFrame, scorer: Scorer, name: str = "polarity"
) -> DataFrame:
    """Polarity with a lexicon ``(token, valence_tenths)`` too large for the plan."""
    hits = _known_words(df, row_key, text, lexicon)
    value = polarity(F.col(text), scorer, _joined_lookup(scorer))
    return df.join(hits, row_key, "left").withColumn(name, value).drop("_hits")


def score_polarity(
    df: DataFrame,
    row_key: str,
    text: str,
    lexicon: DataFrame,
    scorer: Scorer,
    name: str = "polarity",
    literal_bytes: int = LITERAL_BYTES,
) -> DataFrame:
    """Polarity with a lexicon table: inside the row where the lexicon is small, by join beyond."""
    table = LexiconTable(lexicon, scorer, row_key, literal_bytes)
    if table.joins:
        return polarity_by_join(df, row_key, text, lexicon, scorer, name)
    return df.withColumn(name, polarity(F.col(text), table.scorer))
