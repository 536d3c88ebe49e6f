"""Rule bitmask ledger: every quality rule is evaluated once, policies are masks over the stored bits.

The ledger keeps a row per document with the measurements and one long whose bit i tells
that rule i failed.  A policy is a named, versioned set of rules: a document is kept when
``failures & mask = 0``.  Ablations are answered from the distinct failure masks alone.
Everything is a DataFrame expression; nothing runs in Python and nothing is shuffled but
the counts of the distinct masks.

Contract: null text counts as empty; an empty text has no words and fails ``few_words``.
Rows that repeat give rows that repeat.  Two windows of words count as equal when 64-bit
hashes of their words agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words, and the symbols that are counted.
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window.
WINDOW = 5

#: Rules by bit, each true when a document fails it.  The order is part of the ledger: new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "2 * n_capitals > word_chars AND word_chars > 0",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; more rules may join the ledger without changing it."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(RULES))


def measured(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the measurements of each text, as long."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{name}`").alias(alias) for name, alias in zip(keep, names, strict=True)],
        F.array_remove(F.split(text, WORD_BREAK), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    rows = rows.select(
        *names,
        "n_symbols",
        "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("words"),
    )
    rows = rows.withColumn("windows", _windows(F.col("words"))).drop("words")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    places = F.when(repeats, _repeated(F.col("windows"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("places", places).drop("windows").withColumn("n_repeat_words", _covered(F.col("places"))).drop("places")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
    return rows.select(*[F.col(alias).alias(name) for name, alias in zip(keep, names, strict=True)], *measures)


def _windows(words: Column) -> Column:
    """A hash of each run of words that are given as hashes."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))


def _repeated(windows: Column) -> Column:
    """Places of the windows that occur twice or more, ascending: equal ones are neighbours once sorted."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # sorted once, then compared with itself shifted by one to either side
    both = F.transform(
        F.array(ordered),
        lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)),
    )
    return F.sort_array(F.transform(F.get(both, F.lit(0)), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words within the windows that begin at ``places``."""
    own = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda total, size: total + size)


def ledger(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``failures``: one bit for each rule a document fails."""
    bits = [f"IF({rule}, {1 << bit}L, 0L)" for bit, rule in enumerate(RULES.values())]
    return measured(docs, text_column, keep).withColumn("failures", F.expr(" | ".join(bits)))


def passes(policy: Policy, failures: str = "failures") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failures).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and rule of it: documents kept, rejected, failing the rule, and rejected by that rule alone.

    Counts documents by distinct failure mask first, so at most 2**rules rows go on.
    """
    masks = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    choices = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit"))
            for p in policies
            for rule in p.rules
        ]
    )
    rejected = F.col("failures").bitwiseAND(F.col("c.mask"))
    return (
        masks.select("failures", "n", F.explode(choices).alias("c"))
        .groupBy("c.policy", "c.version", "c.rule")
        .agg(
            F.sum(F.when(rejected == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(rejected != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("failures").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(rejected == F.col("c.bit"), F.col("n")).otherwise(0)).alias("only_by_rule"),
            F.bit_or(rejected).alias("rules_seen"),
        )
    )


def passing(docs: DataFrame, policy: Policy, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, that pass a policy.

    The verdict goes through a generator: a filter over the ledger's own columns would be
    pushed below them, each measurement written out again wherever the filter names it.
    """
    names = [f"column_{i}" for i in range(len(docs.columns))]
    which = names[docs.columns.index(text_column)]
    rows = ledger(docs.toDF(*names), which, tuple(names))
    rows = rows.withColumn("passes", F.explode_outer(F.array(passes(policy)))).where("passes")
    return rows.select(*names).toDF(*docs.columns)
