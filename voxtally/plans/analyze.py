"""One lazy plan from raw conversations to the result table.

Without overrides, predictions or translations the plan is map-only: it scans,
extracts, classifies, scores and writes without a shuffle.  Each of the three
look-ups adds one join, broadcast where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions import text as txt
from voxtally.functions.common import once
from voxtally.functions.hybrid import hybrid_score, keyword_group_score
from voxtally.functions.keywords import joined, keywords_in
from voxtally.functions.labels import dead_zone, label_of, score_of, wide_label_of
from voxtally.functions.language import english_gate, language_tag, needs_translation
from voxtally.functions.lexicon import Scorer, polarity, polarity_parts
from voxtally.functions.transcripts import (
    extract_bracket,
    extract_pipe,
    extract_pipe_or_plain,
    extract_tagged,
)
from voxtally.operators.cascade import (
    blended_confidence,
    blended_score,
    cascade_verdict,
    needs_lexicon,
)
from voxtally.operators.correction import (
    correct_with_model,
    correct_with_signed_model,
    reenforce_triggers,
)
from voxtally.operators.lookups import BROADCAST_BYTES, gated_join, lookup_join
from voxtally.operators.polarity import LITERAL_BYTES, LexiconTable, PlainLexicon
from voxtally.rules import Profile, default_profile
from voxtally.sources.readers import require_columns


def _source(override: Column) -> Column:
    return F.when(override.isNotNull(), F.lit("Validation")).otherwise(F.lit("Model"))


def _with_override(df: DataFrame, overrides: DataFrame | None, max_bytes: int) -> DataFrame:
    if overrides is None:
        return df.withColumn("_override", F.lit(None).cast("string"))
    unique = overrides.select("_id_norm", F.col("override_label").alias("_override"))
    return lookup_join(df, unique, "_id_norm", hot_keys=True, max_bytes=max_bytes)


def _chat(df: DataFrame, profile: Profile, text: str, overrides, threshold: float, lexicon, max_bytes: int):
    """Profiles whose open rows take the lexicon score and whose weak rules are blended."""
    extract, clean = {
        "tagged_chat": (extract_tagged, txt.clean_boilerplate),
        "bracket_chat": (extract_bracket, txt.clean_boilerplate),
        "pipe_or_plain": (extract_pipe_or_plain, txt.clean_boilerplate),
    }[profile.name]
    spoken = df.withColumn("CustomerOnly", extract(F.col(text)))
    cleaned = clean(F.col("CustomerOnly"), profile.boilerplate)
    if profile.strip_names:
        cleaned = txt.strip_names(cleaned, profile.strip_names)
    ready = _with_override(spoken.withColumn("Text_For_Analysis", cleaned), overrides, max_bytes)

    body, verdict, raw = F.col("Text_For_Analysis"), F.col("_verdict"), F.col("_raw_vader")
    decided = ready.withColumn("_verdict", cascade_verdict(body, profile.cascade, F.col("_override")))
    open_row = needs_lexicon(verdict, threshold)
    decided, lookup = lexicon.attach(decided, "Text_For_Analysis", open_row)
    scored = decided.withColumn("_raw_vader", F.when(open_row, polarity(body, lexicon.scorer, lookup))).withColumn(
        "consumer_score", blended_score(verdict, raw, threshold)
    )
    return scored.withColumns(
        {
            "confidence": blended_confidence(verdict, threshold),
            "consumer_sentiment": label_of(F.col("consumer_score")),
            "validation_source": _source(F.col("_override")),
            "_rule_fired": verdict["rule"],
            "Negative_Keywords": joined(keywords_in(body, profile.dictionary)),
        }
    ).drop("_verdict", "_override", "_hits")


def _pipe(df: DataFrame, profile: Profile, text: str, overrides, language: str | None, lexicon, max_bytes: int):
    """English rows only; triggers decide, the lexicon fills in, the rest stays without a score."""
    spoken = df.withColumn("ConsumerOnly", extract_pipe(F.col(text)))
    tagged = spoken.withColumns(
        {
            "Language": english_gate(F.col("ConsumerOnly"), F.col(language) if language else None),
            "Text_For_Analysis": F.col("ConsumerOnly"),
        }
    )
    ready = _with_override(tagged, overrides, max_bytes)
    body, verdict, raw = F.col("Text_For_Analysis"), F.col("_verdict"), F.col("_raw_vader")
    english = F.col("Language") == "en"
    open_row = verdict["rule"] == profile.cascade.open_rule
    decided = ready.withColumn("_verdict", cascade_verdict(body, profile.cascade, F.col("_override"), english))
    decided, lookup = lexicon.attach(decided, "Text_For_Analysis", open_row)
    scored = decided.withColumn("_raw_vader", F.when(open_row, F.round(dead_zone(polarity(body, lexicon.scorer, lookup)), 3)))
    score = F.round(F.coalesce(verdict["score"], raw), 3)
    return scored.withColumn("consumer_score", score).withColumns(
        {
            "confidence": verdict["confidence"],
            "consumer_sentiment": F.when(F.col("consumer_score").isNull(), F.lit("")).otherwise(
                label_of(F.col("consumer_score"))
            ),
            "validation_source": _source(F.col("_override")),
            "_rule_fired": verdict["rule"],
            "Negative_Keywords": joined(keywords_in(body, profile.dictionary)),
        }
    ).drop("_verdict", "_override", "_hits")


def text_key(text: Column) -> Column:
    """What a text is known by where translations are kept by text: reviews repeat, so do their translations."""
    return F.sha2(text, 256)


def texts_to_translate(df: DataFrame, text_column: str, full_unicode: bool = True) -> DataFrame:
    """``(text, lang, records)``: each distinct cleaned review that is routed to a translation, once.

    With a column ``translated`` these rows are what ``analyze`` takes as ``translations``.
    """
    cleaned = df.select(once(txt.clean_review(F.col(f"`{text_column}`"), full_unicode)).alias("text"))
    tagged = cleaned.where(~txt.is_meaningless(F.col("text"))).withColumn("_tag", once(language_tag(F.col("text"))))
    routed = tagged.where(needs_translation(F.col("text"), F.col("_tag.lang"), F.col("_tag.lang_confidence")))
    # texts that are counted together are equal
    found = routed.groupBy(text_key(F.col("text")).alias("_key")).agg(F.first("text").alias("text"), F.first("_tag.lang").alias("lang"), F.count(F.lit(1)).alias("records"))
    return found.drop("_key")


def _review(
    df: DataFrame, profile: Profile, text: str, overrides, translations, row_key, lexicon,
    full_unicode: bool, max_bytes: int,
):
    """Every meaningful comment gets the weighted mix of lexicon and keyword groups, from -10 to 10."""
    # rows that ask for a translation are filtered out of these columns
    kept = once if translations is not None else lambda value: value
    cleaned = df.withColumn("Cleaned_Comments", kept(txt.clean_review(F.col(text), full_unicode)))
    ready = _with_override(cleaned, overrides, max_bytes)
    comment, override = F.col("Cleaned_Comments"), F.col("_override")
    ready = ready.withColumn("_scored", kept(override.isNull() & ~txt.is_meaningless(comment)))
    if translations is None:
        ready = ready.withColumn("Translated_Text", F.lit(""))
    else:
        # rows that are not routed to a translation never travel for one
        tagged = ready.withColumn("_tag", once(language_tag(comment)))
        wanted = F.col("_scored") & needs_translation(comment, F.col("_tag.lang"), F.col("_tag.lang_confidence"))
        if "text" in translations.columns:
            key = "_text_key"
            tagged = tagged.withColumn(key, once(F.when(wanted, text_key(comment))))
            known = translations.select(text_key(F.col("text")).alias(key), "translated").groupBy(key).agg(F.max("translated").alias("_translated"))
        else:
            key = row_key
            known = translations.select(F.col("row_key").alias(row_key), F.col("translated").alias("_translated"))
        ready = (
            gated_join(tagged, known, key, wanted, max_bytes, max_bytes)
            .withColumn("Translated_Text", F.coalesce("_translated", F.lit("")))
            .drop("_tag", "_translated", "_text_key")
        )
    body = F.col("Text_For_Analysis")
    ready = ready.withColumn("Text_For_Analysis", txt.prefer_translation(F.col("Translated_Text"), comment))
    ready, lookup = lexicon.attach(ready, "Text_For_Analysis", F.col("_scored"))
    parts, keyword = polarity_parts(body, lexicon.scorer, lookup), keyword_group_score(body, profile.groups)
    mixed = (
        ready.withColumn("_parts", F.when(F.col("_scored"), parts))
        .withColumn("_keyword", F.when(F.col("_scored"), keyword))
        .withColumn("_mix", F.when(F.col("_scored"), hybrid_score(body, F.col("_parts"), F.col("_keyword"))))
    )
    scored, mix = F.col("_scored"), F.col("_mix")
    return mixed.withColumns(
        {
            "consumer_score": F.when(override.isNotNull(), score_of(override, 10.0))
            .when(scored, F.round(mix["score"], 3))
            .otherwise(F.lit(0.0)),
            "confidence": F.when(override.isNotNull(), F.lit(1.0))
            .when(scored, F.round(mix["conf"], 3))
            .otherwise(F.lit(0.0)),
            "consumer_sentiment": F.when(override.isNotNull(), override)
            .when(scored, wide_label_of(mix["score"]))
            .otherwise(F.lit("Neutral")),
            "validation_source": _source(override),
            "_rule_fired": F.when(override.isNotNull(), F.lit("validation"))
            .when(scored, F.lit("hybrid"))
            .otherwise(F.lit("blank")),
            "_raw_vader": F.lit(None).cast("double"),
            "Negative_Keywords": joined(keywords_in(body, profile.dictionary)),
        }
    ).drop("_scored", "_parts", "_keyword", "_mix", "_override", "_hits")


def analyze(
    df: DataFrame,
    profile: Profile | str,
    id_column: str | None = None,
    text_column: str | None = None,
    *,
    overrides: DataFrame | None = None,
    rule_threshold: float = 0.7,
    scorer: Scorer | None = None,
    predictions: DataFrame | None = None,
    translations: DataFrame | None = None,
    language_column: str | None = None,
    row_key: str | None = None,
    full_unicode: bool = True,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    lexicon: DataFrame | None = None,
    max_literal_bytes: int = LITERAL_BYTES,
) -> DataFrame:
    """Input rows with score, label, confidence, deciding rule, extracted text and keywords.

    ``overrides`` is the output of ``load_overrides``.  ``predictions`` is
    ``(row_key, label, score)`` and ``translations`` is ``(row_key, translated)``;
    both need ``row_key``, the column of ``df`` that identifies a row.  Translations may be kept by text
    instead, as ``(text, translated)``; see ``texts_to_translate``.  ``lexicon`` is
    ``(token, valence_tenths)`` and takes the place of the scorer's own; above ``max_literal_bytes``
    it is joined, which needs ``row_key`` too.  The
    threshold plays no part in ``pipe_chat`` and ``review``.
    """
    chosen = default_profile(profile) if isinstance(profile, str) else profile
    identifier, text = id_column or chosen.default_id, text_column or chosen.default_text
    require_columns(df, [identifier, text])
    by_row = predictions is not None or (translations is not None and "text" not in translations.columns)
    if by_row and row_key is None:
        raise ValueError("predictions, and translations without a text, are matched by row_key")
    scorer = scorer or Scorer()
    if lexicon is None:
        words = PlainLexicon(scorer)
    else:
        words = LexiconTable(lexicon, scorer, row_key, max_literal_bytes, max_broadcast_bytes)
    keyed = df.withColumn("_id_norm", txt.normalise_id(F.col(f"`{identifier}`")))
    if "." in text or "`" in text:
        raise ValueError(f"rename column {text!r} first")

    if chosen.name == "review":
        return _review(keyed, chosen, text, overrides, translations, row_key, words, full_unicode, max_broadcast_bytes)
    if chosen.name == "pipe_chat":
        out = _pipe(keyed, chosen, text, overrides, language_column, words, max_broadcast_bytes)
        if predictions is not None:
            out = correct_with_signed_model(out, predictions, row_key, max_broadcast_bytes)
            out = reenforce_triggers(out, chosen.cascade)
        return out
    out = _chat(keyed, chosen, text, overrides, rule_threshold, words, max_broadcast_bytes)
    if predictions is not None:
        out = correct_with_model(out, predictions, row_key, max_broadcast_bytes)
    return out
