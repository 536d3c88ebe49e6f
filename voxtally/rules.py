"""Rules as data: phrase tiers, dictionaries and profiles.

A rule set is small by nature (tens to hundreds of phrases) and travels inside
the plan as literals, so no rule ever needs a join.  Rules kept in a table are
read through the loaders at the end of this module, which refuse tables above a
fixed size instead of pulling an unknown number of rows to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed

MAX_RULE_ROWS = 20_000
#: Branches of a pattern that stand behind one look-ahead; six were fastest, as measured.
GROUP = 6
#: Characters of a phrase that are looked at before its pattern is tried.
GUARDED = 2
#: Characters outside ASCII that match an ASCII letter in any case: dotted capital i, dotless i, long s, Kelvin sign.
LETTERS_OF_ASCII = {"\u0130", "\u0131", "\u017f", "\u212a"}
_SPECIAL = set("\\.^$|?*+()[]{}-/#&~ ")


def _escape(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def phrase_regex(phrases: Iterable[str], exact: bool = False) -> str:
    """One regular expression for many phrases, the longest phrase winning; in lower case unless ``exact``.

    Phrases that start alike share their prefix, so the engine looks at each
    position of the text once per distinct start and not once per phrase.  All
    phrases that can match at one position lie on one path of the tree, and the
    greedy optional tail takes the longest of them.  Where many starts part, they
    stand in groups behind a look-ahead for their first characters, so that a position
    is not held against each of them.
    """
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for char in phrase if exact else phrase.lower():
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        chars = sorted(c for c in node if c)
        branches = [_escape(c) + render(node[c]) for c in chars]
        if not branches:
            return ""
        if len(branches) >= 2 * GROUP:
            firsts = ["".join(_escape(c) for c in chars[i : i + GROUP]) for i in range(0, len(chars), GROUP)]
            branches = [f"(?=[{first}])(?:{'|'.join(branches[i * GROUP : (i + 1) * GROUP])})" for i, first in enumerate(firsts)]
        body = branches[0]
        if len(branches) > 1 or "" in node:
            body = "(?:" + "|".join(branches) + ")"
        return body + ("?" if "" in node else "")

    return render(tree)


def _guard(phrases: Iterable[str]) -> str:
    """A look-ahead that lets pass every place where a phrase can begin, whatever the case, and few others.

    It holds the first characters against plain classes, a look into a table each, where letters of any
    case are folded one by one.  A character outside ASCII always passes: some are ASCII letters in another case.
    """
    lowered = [p.lower() for p in phrases]
    if len({p[:1] for p in lowered}) >= 2 * GROUP:
        return ""  # nearly every place would pass, and the tree has look-aheads of its own
    classes = []
    for place in range(min((len(p) for p in lowered), default=0)):
        held = {p[place] for p in lowered}
        if place == GUARDED or held & LETTERS_OF_ASCII:
            break
        both = sorted({v for c in held if c.isascii() for v in (c, c.upper())})
        classes.append("[" + "".join(_escape(c) for c in both) + r"\x{80}-\x{10FFFF}]")
    return f"(?-i:(?={''.join(classes)}))" if classes else ""


def any_case(phrases: Iterable[str]) -> str:
    """``phrase_regex`` behind a look-ahead for its first characters, for a pattern under ``(?iU)``."""
    listed = list(phrases)
    return _guard(listed) + phrase_regex(listed)


@dataclass(frozen=True)
class Phrases:
    """A set of phrases searched as substrings, and of words searched whole."""

    phrases: tuple[str, ...] = ()
    words: tuple[str, ...] = ()

    @staticmethod
    def of(phrases: Sequence[str] = (), words: Sequence[str] = (), word_boundary: bool = False) -> "Phrases":
        if word_boundary:
            return Phrases((), tuple(phrases) + tuple(words))
        return Phrases(tuple(phrases), tuple(words))

    def __bool__(self) -> bool:
        return bool(self.phrases or self.words)

    @property
    def regex(self) -> str:
        parts = []
        if self.phrases:
            parts.append(any_case(self.phrases))
        if self.words:
            parts.append(r"\b" + f"(?:{phrase_regex(self.words)})" + r"\b")
        return "(?iU)" + "|".join(parts)

    def found_in(self, text: Column) -> Column:
        return text.rlike(self.regex) if self else F.lit(False)

    def count_in(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.regex)) if self else F.lit(0)


@dataclass(frozen=True)
class Refinement:
    """A stronger or weaker reading of a tier that already matched."""

    phrases: Phrases
    rule: str
    score: float
    confidence: float
    at_least: int = 1

    def holds(self, text: Column) -> Column:
        if self.at_least > 1:
            return self.phrases.count_in(text) >= self.at_least
        return self.phrases.found_in(text)


@dataclass(frozen=True)
class Tier:
    name: str
    phrases: Phrases
    rule: str
    score: float
    confidence: float
    refinements: tuple[Refinement, ...] = ()


@dataclass(frozen=True)
class Cascade:
    """Ordered tiers; the first that matches decides."""

    tiers: tuple[Tier, ...]
    open_rule: str = "vader"
    open_confidence: float = 0.5

    def with_phrases(self, by_tier: Mapping[str, Sequence[str]], word_boundary: Iterable[str] = ()) -> "Cascade":
        """The same tiers with other phrases, e.g. the rows of a rule table.

        A refinement is addressed by the name of its rule (``strong_negative``).
        """
        whole = set(word_boundary)

        def pick(name: str, old: Phrases) -> Phrases:
            if name not in by_tier:
                return old
            return Phrases.of(by_tier[name], word_boundary=name in whole)

        tiers = tuple(
            replace(
                tier,
                phrases=pick(tier.name, tier.phrases),
                refinements=tuple(
                    replace(r, phrases=pick(r.rule.split(":")[-1], r.phrases)) for r in tier.refinements
                ),
            )
            for tier in self.tiers
        )
        return replace(self, tiers=tiers)


@dataclass(frozen=True)
class Dictionary:
    """Complaint categories in a fixed order, each with its phrases."""

    categories: Mapping[str, tuple[str, ...]]

    @staticmethod
    def of(categories: Mapping[str, Sequence[str]]) -> "Dictionary":
        return Dictionary({c: tuple(p) for c, p in categories.items()})

    def replaced_by(self, other: Mapping[str, Sequence[str]]) -> "Dictionary":
        """Merge by category; a category of ``other`` takes the place of ours."""
        return Dictionary.of({**self.categories, **other})

    def extended_by(self, other: Mapping[str, Sequence[str]]) -> "Dictionary":
        """Merge by category; phrases of ``other`` are added to ours."""
        merged = {c: list(p) for c, p in self.categories.items()}
        for category, phrases in other.items():
            mine = merged.setdefault(category, [])
            mine.extend(p for p in phrases if p not in mine)
        return Dictionary.of(merged)

    @property
    def phrases(self) -> tuple[str, ...]:
        return tuple(p for phrases in self.categories.values() for p in phrases)

    @property
    def regex(self) -> str:
        return "(?iU)" + any_case(self.phrases)


@dataclass(frozen=True)
class Profile:
    """Everything that tells one kind of conversation from another."""

    name: str
    dictionary: Dictionary
    cascade: Cascade | None = None
    strip_names: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    default_id: str = "ID"
    default_text: str = "Comments"
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Cascades of the built-in profiles
# ---------------------------------------------------------------------------
def five_tier_cascade(
    very_negative: Phrases, very_positive: Phrases, positive: Phrases, counted: Phrases,
    negative: Phrases, strong: Phrases, resolution: Phrases, neutral: Phrases,
) -> Cascade:
    return Cascade((
        Tier("very_negative", very_negative, "rule:very_negative", -0.85, 0.95),
        Tier("very_positive", very_positive, "rule:very_positive", 0.85, 0.95),
        Tier("positive", positive, "rule:positive", 0.35, 0.80,
             (Refinement(counted, "rule:positive_strong", 0.75, 0.90, at_least=2),)),
        Tier("negative", negative, "rule:negative", -0.55, 0.80,
             (Refinement(strong, "rule:strong_negative", -0.70, 0.95),
              Refinement(resolution, "rule:neutral_resolved", 0.0, 0.75))),
        Tier("neutral", neutral, "rule:neutral", 0.0, 0.80),
    ))


def four_tier_cascade(
    very_positive: Phrases, positive: Phrases, counted: Phrases,
    negative: Phrases, strong: Phrases, resolution: Phrases, neutral: Phrases,
) -> Cascade:
    return Cascade((
        Tier("very_positive", very_positive, "rule:very_positive", 0.85, 0.90),
        Tier("positive", positive, "rule:positive", 0.40, 0.80,
             (Refinement(counted, "rule:very_positive", 0.85, 0.90, at_least=2),)),
        Tier("negative", negative, "rule:negative", -0.60, 0.80,
             (Refinement(strong, "rule:strong_negative", -0.65, 0.95),
              Refinement(resolution, "rule:neutral_resolved", 0.0, 0.75))),
        Tier("neutral", neutral, "rule:neutral", 0.0, 0.80),
    ))


def no_positive_cascade(negative: Phrases, strong: Phrases, resolution: Phrases, neutral: Phrases) -> Cascade:
    return Cascade((
        Tier("negative", negative, "rule:negative", -0.55, 0.80,
             (Refinement(strong, "rule:strong_negative", -0.70, 0.95),
              Refinement(resolution, "rule:neutral_resolved", 0.0, 0.75))),
        Tier("neutral", neutral, "rule:neutral", 0.0, 0.80),
    ))


def trigger_cascade(negative: Phrases, neutral: Phrases) -> Cascade:
    return Cascade(
        (
            Tier("negative", negative, "trigger:negative", -0.6, 0.7),
            Tier("neutral", neutral, "trigger:neutral", 0.0, 0.7),
        ),
        open_confidence=0.7,
    )


def _branded(phrases: Sequence[str], brands: Sequence[str]) -> list[str]:
    out: list[str] = []
    for phrase in phrases:
        if "{brand}" in phrase:
            out.extend(phrase.replace("{brand}", b) for b in brands)
        else:
            out.append(phrase)
    return out


def _branded_dictionary(categories: Mapping[str, Sequence[str]], brands: Sequence[str]) -> dict[str, list[str]]:
    return {c: _branded(p, brands) for c, p in categories.items()}


PROFILE_NAMES = ("tagged_chat", "bracket_chat", "pipe_chat", "pipe_or_plain", "review")


def default_profile(name: str, brands: Sequence[str] = ()) -> Profile:
    """A built-in profile; an unknown name gives ``tagged_chat``."""
    shared = Dictionary.of(fixed.SHARED_DICTIONARY)

    if name == "bracket_chat":
        return Profile(
            name="bracket_chat",
            dictionary=shared.extended_by(fixed.BRACKET_DICTIONARY),
            cascade=four_tier_cascade(
                very_positive=Phrases.of(fixed.BRACKET_VERY_POSITIVE),
                positive=Phrases.of(fixed.BRACKET_POSITIVE),
                counted=Phrases.of(words=fixed.BRACKET_POSITIVE_WORDS),
                negative=Phrases.of(fixed.BRACKET_NEGATIVE),
                strong=Phrases.of(fixed.BRACKET_STRONG),
                resolution=Phrases.of(fixed.RESOLUTION_PHRASES, fixed.RESOLUTION_WORDS),
                neutral=Phrases.of(fixed.BRACKET_NEUTRAL),
            ),
            strip_names=tuple(fixed.BRACKET_STRIP_NAMES),
            boilerplate=tuple(fixed.AGENT_REQUEST_PHRASES),
            default_id="Conversation Id",
            default_text="transcripts",
        )
    if name == "pipe_chat":
        return Profile(
            name="pipe_chat",
            dictionary=Dictionary.of(_branded_dictionary(fixed.PIPE_DICTIONARY, brands)),
            cascade=trigger_cascade(
                negative=Phrases.of(fixed.PIPE_NEGATIVE),
                neutral=Phrases.of(_branded(fixed.PIPE_NEUTRAL, brands)),
            ),
            default_id="Conversation Id",
            default_text="Message Text (Translate/Original)",
        )
    if name == "pipe_or_plain":
        return Profile(
            name="pipe_or_plain",
            dictionary=shared.replaced_by(fixed.PLAIN_DICTIONARY),
            cascade=no_positive_cascade(
                negative=Phrases.of(fixed.PLAIN_NEGATIVE),
                strong=Phrases.of(fixed.PLAIN_STRONG),
                resolution=Phrases.of(fixed.RESOLUTION_PHRASES, fixed.RESOLUTION_WORDS),
                neutral=Phrases.of(fixed.PLAIN_NEUTRAL),
            ),
        )
    if name == "review":
        return Profile(
            name="review",
            dictionary=Dictionary.of(_branded_dictionary(fixed.REVIEW_DICTIONARY, brands)),
            groups=fixed.REVIEW_GROUPS,
        )
    return Profile(
        name="tagged_chat",
        dictionary=shared.replaced_by(fixed.TAGGED_DICTIONARY),
        cascade=five_tier_cascade(
            very_negative=Phrases.of(fixed.TAGGED_VERY_NEGATIVE),
            very_positive=Phrases.of(fixed.TAGGED_VERY_POSITIVE),
            positive=Phrases.of(fixed.TAGGED_POSITIVE),
            counted=Phrases.of(words=fixed.TAGGED_POSITIVE_WORDS),
            negative=Phrases.of(fixed.TAGGED_NEGATIVE),
            strong=Phrases.of(fixed.TAGGED_STRONG),
            resolution=Phrases.of(fixed.TAGGED_RESOLUTION_PHRASES, fixed.RESOLUTION_WORDS),
            neutral=Phrases.of(fixed.TAGGED_NEUTRAL),
        ),
        strip_names=tuple(_branded(fixed.TAGGED_STRIP_NAMES, brands)),
        boilerplate=tuple(fixed.AGENT_REQUEST_PHRASES),
    )


# ---------------------------------------------------------------------------
# Rule tables
# ---------------------------------------------------------------------------
def bounded_rows(table: DataFrame, limit: int = MAX_RULE_ROWS) -> list:
    """The rows of a table that is small by contract; a larger one is an error."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows; rules are parameters, not data")
    return rows


def phrases_from_table(rules: DataFrame) -> dict[str, list[str]]:
    """``(tier, phrase)`` rows as the mapping that ``Cascade.with_phrases`` takes."""
    out: dict[str, list[str]] = {}
    for row in sorted(bounded_rows(rules.select("tier", "phrase"))):
        out.setdefault(row.tier, []).append(row.phrase)
    return out


def dictionary_from_table(rules: DataFrame) -> Dictionary:
    """``(category, ordinal, phrase)`` rows as a dictionary.

    Categories keep the order of their lowest ordinal.
    """
    rows = sorted(bounded_rows(rules.select("ordinal", "category", "phrase")))
    out: dict[str, list[str]] = {}
    for row in rows:
        phrases = out.setdefault(row.category, [])
        if row.phrase not in phrases:
            phrases.append(row.phrase)
    return Dictionary.of(out)


def merge_dictionaries_by_replacing(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Dictionary tables ``(category, phrase)``: a category of ``extra`` replaces ours."""
    kept = base.join(extra.select("category").distinct(), "category", "left_anti")
    return kept.select("category", "phrase").unionByName(extra.select("category", "phrase"))


def merge_dictionaries_by_appending(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Dictionary tables ``(category, phrase)``: phrases of ``extra`` join ours."""
    both = base.select("category", "phrase").unionByName(extra.select("category", "phrase"))
    return both.dropDuplicates(["category", "phrase"])
