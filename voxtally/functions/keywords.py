"""Complaint keywords, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.common import let, text_or_empty
from voxtally.rules import Dictionary, any_case


#: Letters that a pattern without case takes for an ASCII letter: dotted capital i, dotless i, long s, Kelvin sign.
LETTERS_LIKE_ASCII = ("\u0130\u0131\u017f\u212a", "iisk")


def keywords_in(text: Column, dictionary: Dictionary) -> Column:
    """Distinct phrases in order of appearance, each in its first spelling.

    Matches are the longest at their place and do not overlap.  There are at
    most as many distinct ones as the dictionary has phrases.
    """
    hits = F.regexp_extract_all(text_or_empty(text), F.lit(dictionary.regex), F.lit(0))
    return let(hits, distinct_spellings)


def distinct_spellings(found: Column) -> Column:
    """Distinct matches whatever their case, in order, each in its first spelling."""
    return let(
        F.transform(found, F.lower),
        lambda lowered: F.transform(
            F.array_distinct(lowered),
            lambda k: F.element_at(found, F.array_position(lowered, k).cast("int")),
        ),
    )


def joined(keywords: Column) -> Column:
    return F.array_join(keywords, "; ")


def split_joined(keywords: Column) -> Column:
    """The stored text ``a; b`` as an array; blanks dropped."""
    parts = F.transform(F.split(keywords, "; "), F.trim)
    return F.filter(parts, lambda k: k != "")


def any_of(phrases: Column) -> Column:
    """The pattern of an array of phrases, the longest first, whatever their case."""
    ordered = F.array_sort(F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("size"), p.alias("phrase"))))
    quoted = F.transform(ordered, lambda p: F.concat(F.lit(r"\Q"), F.replace(p["phrase"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit("(?iU)"), F.array_join(quoted, "|"))


def _folded(phrase: str) -> str:
    return phrase.translate(str.maketrans(*LETTERS_LIKE_ASCII)).lower()


def _starts(text: Column, phrases: Sequence[str]) -> Column:
    """The longest phrase that starts at each position, overlapping or not: each once, folded."""
    pattern = "(?iU)(?=(" + any_case(phrases) + "))"
    starts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    # characters that match an ASCII letter in any case, but are not lowered to it
    return F.array_distinct(F.transform(starts, lambda p: F.lower(F.translate(p, *LETTERS_LIKE_ASCII))))


def keywords_in_each(text: Column, dictionaries: Mapping[str, Dictionary]) -> Column:
    """A struct of ``keywords_in`` by several dictionaries, from one pass for the phrases of all.

    That pass tells which phrases a text contains; those of a dictionary are then the pattern of this row.
    """
    union = sorted({p for dictionary in dictionaries.values() for p in dictionary.phrases})
    none = F.array().cast("array<string>")
    if not any(union):
        return F.struct(*[none.alias(name) for name in dictionaries])
    whole = sorted({_folded(p) for p in union})
    known = F.from_json(F.lit(json.dumps(dict.fromkeys(whole, True))), "map<string,boolean>")

    def of_one(body: Column, starts: Column, strange: Column, dictionary: Dictionary) -> Column:
        own = sorted({p.lower() for p in dictionary.phrases if p})
        if not own:
            return none
        implied = {w: [p for p in own if w.startswith(_folded(p))] for w in whole}
        table = F.from_json(F.lit(json.dumps({w: p for w, p in implied.items() if p})), "map<string,array<string>>")
        held = F.array_distinct(F.flatten(F.transform(starts, lambda w: F.coalesce(F.try_element_at(table, w), none))))

        def hits(present: Column) -> Column:
            # a phrase that is folded in another way than its text is: all of the dictionary are looked for
            pattern = F.when(strange, F.lit(dictionary.regex)).otherwise(any_of(present))
            found = F.regexp_extract_all(body, pattern, F.lit(0))
            return F.when(strange | (F.size(present) > 0), let(found, distinct_spellings)).otherwise(none)

        return let(held, hits)

    def of_all(body: Column, starts: Column) -> Column:
        strange = F.exists(starts, lambda w: F.try_element_at(known, w).isNull())
        return F.struct(*[of_one(body, starts, strange, d).alias(name) for name, d in dictionaries.items()])

    return let(text_or_empty(text), lambda body: let(_starts(body, union), lambda starts: of_all(body, starts)))


def categories_in_each(text: Column, dictionaries: Mapping[str, Dictionary]) -> Column:
    """``array<struct<profile, category>>``: ``categories_in`` by several dictionaries, from one pass for the phrases of all.

    A look-ahead reports the longest phrase that starts at each position, overlapping or not.  Any
    other phrase that starts there is a beginning of that one, so its category is known from the phrase.
    """
    pairs = [(name, category) for name, dictionary in dictionaries.items() for category in dictionary.categories]
    category_of = [
        (_folded(p), pairs.index((name, c))) for name, d in dictionaries.items() for c, phrases in d.categories.items() for p in phrases
    ]
    implied = {whole: sorted({i for part, i in category_of if whole.startswith(part)}) for whole, _ in category_of}
    if not implied:
        return F.array().cast("array<struct<profile:string,category:string>>")
    table = F.from_json(F.lit(json.dumps(implied)), "map<string,array<int>>")
    starts = _starts(text_or_empty(text), sorted({p for d in dictionaries.values() for p in d.phrases}))
    found = F.flatten(F.filter(F.transform(starts, lambda p: table[p]), lambda c: c.isNotNull()))
    rows = [{"place": i, "of": {"profile": name, "category": category}} for i, (name, category) in enumerate(pairs)]
    all_pairs = F.from_json(F.lit(json.dumps(rows)), "array<struct<place:int,of:struct<profile:string,category:string>>>")
    return let(found, lambda present: F.transform(F.filter(all_pairs, lambda c: F.array_contains(present, c["place"])), lambda c: c["of"]))


def categories_in(text: Column, dictionary: Dictionary) -> Column:
    """Names of the categories with at least one phrase in the text, in dictionary order; one pass for all."""
    return F.transform(categories_in_each(text, {"": dictionary}), lambda c: c["category"])
