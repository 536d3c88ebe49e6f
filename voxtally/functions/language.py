"""Language tag, English gate and translation routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed
from voxtally.functions.common import let, string_array, strip, text_or_empty


def language_tag(column: Column) -> Column:
    """``struct<lang, lang_confidence>`` from accents and small indicator words."""
    text = text_or_empty(column)

    def tag(lang: str, confidence: float) -> Column:
        return F.struct(F.lit(lang).alias("lang"), F.lit(confidence).alias("lang_confidence"))

    def by_words(words: Column) -> Column:
        spanish = F.size(F.array_intersect(words, string_array(fixed.SPANISH_WORDS)))
        english = F.size(F.array_intersect(words, string_array(fixed.ENGLISH_WORDS)))
        return (
            F.when(spanish >= 2, tag("es", 0.95))
            .when(english >= 3, tag("en", 0.99))
            .otherwise(tag("en", 0.80))
        )

    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return (
        F.when(F.length(text) < 3, tag("en", 1.0))
        .when(text.rlike(f"[{fixed.SPANISH_CHARACTERS}]"), tag("es", 0.95))
        .otherwise(let(words, by_words))
    )


def english_gate(column: Column, detected: Column | None = None) -> Column:
    """``en`` or ``non-en``; a text without a detected language counts as English."""
    language = F.lit("en") if detected is None else F.when(detected == "en", "en").otherwise("non-en")
    return F.when(strip(text_or_empty(column)) == "", F.lit("non-en")).otherwise(language)


def needs_translation(text: Column, lang: Column, confidence: Column) -> Column:
    enough = F.when(lang.isin(fixed.EASY_TRANSLATION_LANGUAGES), F.lit(0.5)).otherwise(F.lit(0.7))
    return (lang != "en") & (confidence >= enough) & (F.length(text) >= 3)
