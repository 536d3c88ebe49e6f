"""HTML entities and Unicode compatibility forms (NFKC) inside the JVM.

A text whose characters are all normal forms that never combine is its own NFKC form, and a
character whose form consists of such characters can be replaced by it.  So entities and compatibility
characters are look-ups in literal tables, built from Python's own tables when a plan is made.  Only texts
with combining characters, characters that join with the one before, or unusual entities need
the whole algorithm; see ``needs_python``.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.common import let
from voxtally.rules import phrase_regex

#: Fixed value: what may be an entity.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Characters that one short class tells from all others, if they are harmless.
FAMILIAR = range(0x2070)
#: Characters whose numbers are looked up.
NUMBERED = [*range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2070), *range(0x20A0, 0x20D0)]


def _class(points: Iterable[int]) -> str:
    """The inside of a character class."""
    out, first, last = [], None, None
    for point in [*sorted(points), None]:
        if first is not None and point != last + 1:
            out.append(f"\\x{{{first:x}}}-\\x{{{last:x}}}")
            first = None
        first, last = point if first is None else first, point
    return "".join(out)


@lru_cache(1)
def _combining() -> frozenset[str]:
    """Characters that combine or join with others, and those whose form holds such."""
    # later parts of canonical decompositions, vowels and finals of Hangul
    joins = {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for point in _points():
        parts = unicodedata.decomposition(chr(point))
        if parts and not parts.startswith("<"):
            joins |= {chr(int(x, 16)) for x in parts.split()[1:]}
    joins |= {chr(p) for p in _points() if unicodedata.combining(chr(p))}
    return frozenset(joins | {chr(p) for p in _points() if joins & set(unicodedata.normalize("NFKC", chr(p)))})


def _points() -> Iterable[int]:
    yield from range(0xD800)
    yield from range(0xE000, 0x110000)


@lru_cache(1)
def _forms() -> dict[str, str]:
    """Characters that are replaced, with their forms."""
    pairs = ((chr(p), unicodedata.normalize("NFKC", chr(p))) for p in _points())
    return {char: form for char, form in pairs if form != char and char not in _combining()}


@lru_cache(1)
def _odd() -> str:
    """The class of characters that may have a form or combine: all but familiar ones that do neither."""
    harmless = {p for p in FAMILIAR if chr(p) not in _combining() and chr(p) not in _forms()}
    return _above(next(p for p in FAMILIAR if p not in harmless), f"^{_class(harmless)}")


def _above(least: int, inside: str) -> str:
    """A class of characters from ``least`` on: the many ranges are tried only for characters that pass this one comparison."""
    return f"[\\x{{{least:x}}}-\\x{{10ffff}}&&[{inside}]]"


@lru_cache(1)
def _entities() -> dict[str, str]:
    """Entities that are looked up, with their characters: names and usual numbers, unless these combine."""
    known = {"&" + name: value for name, value in html5.items() if name.endswith(";")}
    for n in NUMBERED:
        known |= {spelled: chr(n) for spelled in (f"&#{n};", f"&#x{n:x};", f"&#X{n:x};", f"&#x{n:X};", f"&#X{n:X};")}
    return {name: value for name, value in known.items() if not _combining() & set(value)}


def _literal_map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _unescaped(text: Column) -> Column:
    """The text with its known entities replaced, each once; others stay."""

    def replaced(hits: Column) -> Column:
        known = _literal_map(_entities())
        chars = F.transform(hits, lambda hit: F.coalesce(F.try_element_at(known, hit), hit))
        whole = F.zip_with(F.split(text, ENTITY, -1), chars, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit(""))))
        return F.array_join(whole, "")

    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), let(found, replaced)).otherwise(text)


def native_form(column: Column) -> Column:
    """The text with known entities and compatibility forms replaced: all there is to do unless ``needs_python``."""

    def with_forms(text: Column) -> Column:
        known = _literal_map(_forms())
        odd = F.array_distinct(F.regexp_extract_all(text, F.lit(_odd()), F.lit(0)))
        # a form holds no character that has a form, so the order of replacements does not matter
        replaced = F.aggregate(odd, text, lambda t, c: F.replace(t, c, F.coalesce(F.try_element_at(known, c), c)))
        return F.when(text.rlike(_odd()), replaced).otherwise(text)

    return let(column, lambda text: let(_unescaped(text), with_forms))


def needs_python(column: Column) -> Column:
    """Whether a text holds what only the whole algorithm resolves: combining characters, or entities that are not known."""
    known = phrase_regex((name[1:] for name in _entities()), exact=True)
    combining = _above(min(map(ord, _combining())), _class(map(ord, _combining())))

    def asks(text: Column) -> Column:
        unknown = F.contains(text, F.lit("&")) & text.rlike(f"&(?!{known})" + ENTITY[1:])
        return unknown | (text.rlike(_odd()) & text.rlike(combining))

    return let(column, asks)
