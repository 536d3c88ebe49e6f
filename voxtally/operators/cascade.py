"""The phrase cascade and what follows from it: gate, blend, label, correction.

Everything here is a column expression or a map-only step, so it also runs on a
streaming DataFrame.  The cascade is one ``CASE`` that returns one struct; a
refinement sits inside the branch of its tier, so each expression is evaluated
at most once per row and none after the deciding tier.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.common import is_blank, strip
from voxtally.functions.labels import dead_zone, score_of
from voxtally.rules import Cascade, Tier

VERDICT = "struct<score:double,confidence:double,rule:string>"


def verdict_of(rule: str, score: float | Column | None, confidence: float) -> Column:
    value = score if isinstance(score, Column) else F.lit(score)
    return F.struct(
        value.cast("double").alias("score"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(rule).alias("rule"),
    )


def tier_masks(text: Column, cascade: Cascade) -> dict[str, Column]:
    """One Boolean per tier and per phrase refinement, one count per counted refinement."""
    masks: dict[str, Column] = {}
    for tier in cascade.tiers:
        masks[tier.name] = tier.phrases.found_in(text)
        for r in tier.refinements:
            name = r.rule.split(":")[-1]
            if r.at_least > 1:
                masks[name + "_count"] = r.phrases.count_in(text)
            else:
                masks[name] = r.phrases.found_in(text)
    return masks


def _within(tier: Tier, text: Column) -> Column:
    plain = verdict_of(tier.rule, tier.score, tier.confidence)
    if not tier.refinements:
        return plain
    first, *others = tier.refinements
    chain = F.when(first.holds(text), verdict_of(first.rule, first.score, first.confidence))
    for r in others:
        chain = chain.when(r.holds(text), verdict_of(r.rule, r.score, r.confidence))
    return chain.otherwise(plain)


def cascade_verdict(
    text: Column,
    cascade: Cascade,
    override: Column | None = None,
    english: Column | None = None,
) -> Column:
    """Score, confidence and rule of a text; the score is null where no tier matches.

    With an ``english`` gate, blank texts and texts in other languages are
    skipped: they get no score either.
    """
    blank_score = None if english is not None else 0.0
    chain = F.when(F.lit(False), verdict_of("", None, 0.0))
    if override is not None:
        chain = F.when(override.isNotNull(), verdict_of("validation", score_of(override), 1.0))
    chain = chain.when(is_blank(text), verdict_of("blank", blank_score, 0.0))
    if english is not None:
        chain = chain.when(~english, verdict_of("non_english", None, 0.0))
    for tier in cascade.tiers:
        chain = chain.when(tier.phrases.found_in(text), _within(tier, text))
    return chain.otherwise(verdict_of(cascade.open_rule, None, cascade.open_confidence))


def needs_lexicon(verdict: Column, threshold: float = 0.7) -> Column:
    """Rows without a rule score, and rows whose rule is not trusted enough."""
    decided = verdict["rule"].isin("validation", "blank", "non_english")
    return ~decided & (verdict["score"].isNull() | (verdict["confidence"] <= threshold))


def blended_score(verdict: Column, lexicon: Column, threshold: float = 0.7) -> Column:
    """Trusted rule scores stand; weak ones are mixed with the lexicon; the rest is lexicon."""
    clamped = dead_zone(lexicon)
    fixed_rule = verdict["rule"].isin("validation", "blank")
    return F.round(
        F.when(fixed_rule | (verdict["confidence"] > threshold), F.coalesce(verdict["score"], clamped))
        .when(
            verdict["score"].isNotNull(),
            verdict["score"] * verdict["confidence"] + clamped * (1.0 - verdict["confidence"]),
        )
        .otherwise(clamped),
        3,
    )


def blended_confidence(verdict: Column, threshold: float = 0.7) -> Column:
    trusted = verdict["score"].isNotNull() & (verdict["confidence"] > threshold)
    return F.when(verdict["rule"].isin("validation", "blank") | trusted, verdict["confidence"]).otherwise(F.lit(0.5))


def correction_gate(confidence: Column, source: Column, text: Column) -> Column:
    return (confidence < 0.6) & (source == "Model") & (strip(F.coalesce(text, F.lit(""))) != "")


def signed_correction_gate(score: Column, source: Column, language: Column) -> Column:
    return F.coalesce(score.between(-0.1, 0.1), F.lit(False)) & (language == "en") & (source == "Model")
