"""Review scoring: keyword groups, the weighted mix and its confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed
from voxtally.functions.common import WHITE_SPACE_RUN, and_all, let, or_all, string_array, strip, text_or_empty
from voxtally.rules import phrase_regex


#: Fixed value: more words than these make a long text.
LONG_TEXT = 20


def in_one_line(steps: Sequence[Sequence[str]]) -> str:
    """A pattern for a word of each step, one after the other, in one line.

    The first word of a step is always the best one to go on from, so nothing is
    tried twice: one scan per line, where ``a.*b.*c`` costs one per ``a``.
    """
    return "(?md)^" + "".join(f"(?>.*?(?:{phrase_regex(words)}))" for words in steps)


def _hits(lowered: Column, phrases: Sequence[str]) -> Column:
    return F.size(F.filter(string_array([p.lower() for p in phrases]), lambda p: F.contains(lowered, p)))


def keyword_group_score(
    column: Column,
    groups: Mapping[str, Sequence[str]] = fixed.REVIEW_GROUPS,
    weights: Mapping[str, float] = fixed.REVIEW_GROUP_WEIGHTS,
    overrides: Sequence[Sequence[Sequence[str]]] = fixed.POSITIVE_OVERRIDES,
) -> Column:
    """``struct<kw_score, kw_total>``: mean weight of the phrases found and their number.

    A phrase counts once however often it occurs.
    """
    lowered = F.lower(strip(text_or_empty(column)))
    return let(lowered, lambda t: group_mean(t, [_hits(t, groups.get(name, ())) for name in weights], weights, overrides))


def group_mean(
    lowered: Column, hits: Sequence[Column], weights: Mapping[str, float], overrides: Sequence[Sequence[Sequence[str]]]
) -> Column:
    """``struct<kw_score, kw_total>`` from the number of phrases found of each weighted group and the overrides of the text."""
    override = F.lit(False)
    for steps in overrides:
        # plain searches for a word of each step, in any order, rule most texts out before the pattern runs
        held = and_all([or_all([F.contains(lowered, F.lit(w.lower())) for w in words]) for words in steps])
        override = override | (held & lowered.rlike(in_one_line(steps)))
    values = [*weights.values(), fixed.POSITIVE_OVERRIDE_WEIGHT]

    def mean(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, b: a + b)
        weighted = F.aggregate(
            F.zip_with(c, F.array(*[F.lit(v) for v in values]), lambda n, w: n * w),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        return F.struct(
            F.when(total > 0, weighted / total).otherwise(F.lit(0.0)).alias("kw_score"),
            total.alias("kw_total"),
        )

    return let(F.array(*hits, override.cast("int")), mean)


def hybrid_score(text: Column, parts: Column, keyword: Column) -> Column:
    """``struct<score, conf>`` on the scale from -10 to 10.

    ``parts`` comes from ``lexicon.polarity_parts`` and ``keyword`` from
    ``keyword_group_score``.  Two of the four scorers are half the lexicon score,
    which is what they are when no further scorer is at hand.
    """
    # only as many words as tell a short text from a long one, the first and the last piece being empty perhaps
    words = F.size(F.filter(F.split(text, WHITE_SPACE_RUN, LONG_TEXT + 3), lambda w: w != ""))

    # Base weights and their adjustments, (lexicon, second, third, keywords)
    base = (0.40, 0.20, 0.20, 0.20)
    emphatic = (0.15, -0.05, -0.05, -0.05)
    many_keywords = (-0.05, -0.05, -0.05, 0.15)
    some_keywords = (-0.05, -0.025, -0.025, 0.10)
    short_text = (-0.10, 0.05, -0.05, 0.10)
    long_text = (0.10, -0.05, 0.05, -0.10)

    def mix(f: Column) -> Column:
        def weight(i: int) -> Column:
            def part(condition: Column, values: tuple) -> Column:
                return F.when(condition, F.lit(values[i])).otherwise(F.lit(0.0))

            return (
                F.lit(base[i])
                + part(f["loud"], emphatic)
                + F.when(f["kw_total"] >= 3, F.lit(many_keywords[i]))
                .when(f["kw_total"] >= 1, F.lit(some_keywords[i]))
                .otherwise(F.lit(0.0))
                + part(f["words"] <= 5, short_text)
                + part(f["words"] > LONG_TEXT, long_text)
            )

        lexicon = f["compound"] * 10.0
        scores = F.array(lexicon, lexicon * 0.5, lexicon * 0.5, f["kw_score"])

        def combine(w: Column) -> Column:
            weighted = F.aggregate(
                F.zip_with(scores, w, lambda s, x: s * x), F.lit(0.0), lambda a, b: a + b
            )
            return weighted / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)

        combined = let(F.array(weight(0), weight(1), weight(2), weight(3)), combine)
        agreement = let(F.filter(scores, lambda s: F.abs(s) > 0.1), _agreement)
        conf = f["strongest"] * 0.6 + agreement * 0.4
        conf = F.when(f["kw_total"] >= 2, F.least(F.lit(1.0), conf + 0.15)).otherwise(conf)
        return F.struct(
            F.greatest(F.lit(-10.0), F.least(F.lit(10.0), combined)).alias("score"),
            F.greatest(F.lit(0.3), F.least(F.lit(0.95), conf)).alias("conf"),
        )

    facts = F.struct(
        parts["compound"].alias("compound"),
        parts["strongest"].alias("strongest"),
        keyword["kw_score"].alias("kw_score"),
        keyword["kw_total"].alias("kw_total"),
        words.alias("words"),
        (text.rlike(r"\p{Lu}") | F.contains(text, F.lit("!")) | text.rlike(fixed.EMOJI)).alias("loud"),
    )
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("conf"))
    return F.when(strip(text_or_empty(text)) == "", nothing).otherwise(let(facts, mix))


def _agreement(scores: Column) -> Column:
    """One minus a tenth of the population deviation; one half for fewer than two scores."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / n

    def spread(m: Column) -> Column:
        squares = F.aggregate(scores, F.lit(0.0), lambda a, s: a + (s - m) * (s - m))
        return F.greatest(F.lit(0.0), 1.0 - F.sqrt(squares / n) / 10.0)

    return F.when(n >= 2, let(mean, spread)).otherwise(F.lit(0.5))
