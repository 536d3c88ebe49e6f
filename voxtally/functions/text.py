"""Cleaning, redaction and presentation of text, as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally import fixed_values as fixed
from voxtally.functions.common import let, squeeze, strip, text_or_empty
from voxtally.functions.unicode import native_form, needs_python
from voxtally.rules import any_case


def normalise_id(column: Column) -> Column:
    """Ids as text without surrounding white space and without spaces; case is kept."""
    return F.replace(strip(column.cast("string")), F.lit(" "), F.lit(""))


def clean_boilerplate(column: Column, phrases: Sequence[str] = fixed.AGENT_REQUEST_PHRASES) -> Column:
    """Remove requests for an agent; what is left counts from 5 characters and 2 words."""
    text = text_or_empty(column)
    if phrases:
        text = F.regexp_replace(text, "(?iU)" + any_case(phrases), "")


    def long_enough(squeezed: Column) -> Column:
        return (F.length(squeezed) >= 5) & F.contains(squeezed, F.lit(" "))

    return let(squeeze(text), lambda t: F.when(long_enough(t), t).otherwise(F.lit("")))


def strip_names(column: Column, names: Sequence[str]) -> Column:
    """Delete names wherever they occur, the longest first."""
    text = text_or_empty(column)
    if names:
        text = F.regexp_replace(text, "(?iU)" + any_case(names), "")
    return squeeze(text)


# ---------------------------------------------------------------------------
# Reviews
# ---------------------------------------------------------------------------
# The entities that are replaced without leaving the JVM
_COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape_common(column: Column) -> Column:
    text = column
    for entity, char in _COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _unescape_and_compose():
    # a nested function travels to the executors by value, so they need no copy of this package
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")

    return F.pandas_udf(compose, T.StringType())


def unescape_full(column: Column) -> Column:
    """All entities and compatibility forms.

    Only texts with combining characters or unusual entities travel to Python;
    the others are sent as null and keep what the JVM made of them.
    """
    whole = _unescape_and_compose()(F.when(needs_python(column), column))
    return F.coalesce(whole, native_form(column))


def _from_run_start(pattern: str, characters: str) -> str:
    """The same matches, tried only where a run of ``characters`` begins or the last match ended.

    ``pattern`` starts with such a run, so a match from inside a run always has a
    longer one from its start.  Without this, a long run without a match (a hash,
    an encoded file) costs the square of its length.
    """
    return rf"(?:\G|(?<![{characters}])){pattern}"


def _without_tags(column: Column) -> Column:
    """Tags become spaces; what follows the last ``>`` holds none and is not searched."""

    def split_off(text: Column) -> Column:
        return let(
            F.substring_index(text, ">", -1),
            lambda tail: F.concat(
                F.regexp_replace(F.left(text, F.length(text) - F.length(tail)), fixed.HTML_TAG, " "), tail
            ),
        )

    return let(column, split_off)


def strip_markup(column: Column) -> Column:
    """Links, mail addresses, tags, control characters and repeated marks go; ends are trimmed."""
    # links and addresses end at any white space, also outside ASCII
    text = F.regexp_replace(column, "(?U)" + fixed.URL, " ")
    text = F.regexp_replace(text, "(?U)" + _from_run_start(fixed.EMAIL_IN_REVIEW, r"\S"), " ")
    text = _without_tags(text)
    text = F.regexp_replace(text, fixed.CONTROL_CHARACTERS, " ")
    text = F.regexp_replace(text, fixed.REPEATED_PUNCTUATION, "$1")
    text = squeeze(text)
    text = F.regexp_replace(text, r"(?U)^[^\w']+|(?<![^\w'])[^\w']+$", "")
    return strip(text)


def clean_review(column: Column, full_unicode: bool = True) -> Column:
    text = strip(text_or_empty(column))
    for broken, right in fixed.MOJIBAKE:
        text = F.replace(text, F.lit(broken), F.lit(right))
    text = unescape_full(text) if full_unicode else unescape_common(text)
    return strip_markup(text)


def _spaced(token: str) -> str:
    """``token`` with any separators around and between its characters."""
    gap = f"(?:{fixed.MEANINGLESS_SEPARATORS})*+"
    return gap + "".join(re.escape(char) + gap for char in token)


# What holds a word in Latin letters, and two such words that differ, the first being the text's first
_WORD = r"\b[a-zA-Z]+\b"
_OTHER_WORD = r"(?Us)\A(?>.*?\b([a-zA-Z]+)\b).*?\b(?!\1\b)[a-zA-Z]+\b"


def meaningless_reason(column: Column) -> Column:
    """Why a text says nothing: the first of eight checks, or ``ok``.

    A text that says something is found to after a few characters, not by parts of all of it: it differs from the
    tokens at its beginning, and its second word from its first.
    """
    tokens = r"\A(?:" + "|".join(_spaced(token) for token in fixed.MEANINGLESS_TOKENS) + r")\z"

    def reason_of(text: Column, lowered: Column) -> Column:
        bare = F.regexp_replace(lowered, fixed.MEANINGLESS_SEPARATORS, "")
        chars = F.length(text)
        digits = chars - F.length(F.regexp_replace(text, r"\p{Nd}", ""))
        words = F.regexp_extract_all(text, F.lit("(?U)" + _WORD), F.lit(0))

        reason = F.when(lowered == "", F.lit("empty"))
        reason = reason.when(lowered.rlike(tokens), F.concat(F.lit("normalised="), bare))
        for pattern in fixed.MEANINGLESS_PATTERNS:
            reason = reason.when(lowered.rlike("(?iUd)" + pattern), F.lit("pattern=" + pattern))
        return (
            reason.when((chars == 1) & ~F.lower(text).isin("i", "a"), F.lit("single_char"))
            .when(~text.rlike(r"[\p{L}\p{N}]"), F.lit("no_alnum"))
            .when(~text.rlike("(?U)" + _WORD), F.lit("no_words"))
            .when(~text.rlike(_OTHER_WORD) & (F.size(words) > 1), F.lit("repeated_word"))
            .when(digits / chars > 0.5, F.lit("mostly_numbers"))
            .otherwise(F.lit("ok"))
        )

    return let(text_or_empty(column), lambda text: let(F.lower(strip(text)), lambda lowered: reason_of(text, lowered)))


def is_meaningless(column: Column) -> Column:
    return meaningless_reason(column) != "ok"


def prefer_translation(translated: Column, cleaned: Column) -> Column:
    return F.when(F.length(translated) > 0, translated).otherwise(cleaned)


# ---------------------------------------------------------------------------
# Presentation
# ---------------------------------------------------------------------------
_PII = {
    "EMAIL": _from_run_start(fixed.PII_EMAIL, r"A-Za-z0-9._%+\-"),
    "PHONE": "(?U)" + fixed.PII_PHONE,
    "SSN": "(?U)" + fixed.PII_SSN,
    "CARD": "(?U)" + fixed.PII_CARD,
}
PII_ORDER = ("EMAIL", "CARD", "PHONE", "SSN")
PII_LEGACY_ORDER = ("EMAIL", "PHONE", "SSN", "CARD")


def redact(column: Column, legacy_order: bool = False) -> Column:
    """Replace mail addresses, cards, phone and social security numbers by their kind.

    Cards are looked for before phones; ``legacy_order`` looks for phones first
    and then leaves the last digits of a card in place.
    """
    text = column
    for kind in PII_LEGACY_ORDER if legacy_order else PII_ORDER:
        text = F.regexp_replace(text, _PII[kind], f"[{kind}]")
    return text


def shorten(column: Column, limit: int) -> Column:
    return F.when(
        F.length(column) > limit, F.concat(F.substring(column, 1, limit), F.lit("…"))
    ).otherwise(column)


def highlight(column: Column, phrases: Sequence[str], mark: str = "**") -> Column:
    if not phrases:
        return column
    return F.regexp_replace(column, "(?iU)" + any_case(phrases), f"{mark}$0{mark}")
