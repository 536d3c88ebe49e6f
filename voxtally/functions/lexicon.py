"""Lexicon polarity, as column expressions.

The rule is the published one for lexicon scoring of social text (Hutto and
Gilbert, ICWSM 2014): word valences, boosters and negations among the three
words before, emphasis by capitals and marks, a turn at "but", and the sum ``x``
brought to [-1, 1] by ``x / sqrt(x^2 + 15)``.  The lexicon is a parameter.

A text is scored inside its row.  The lexicon is a literal of the plan, an
array of small maps addressed by a checksum of the word, so a look-up reads a
handful of entries and no word of any text is ever shuffled.  A lexicon above
``MAX_LITERAL_LEXICON`` is not put into the plan; see
``operators.polarity.polarity_by_join`` for that case.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.common import WHITE_SPACE_RUN, let, strip, text_or_empty

MAX_LITERAL_LEXICON = 50_000

# Fixed values of the published rule
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)
NORMALISER = 15.0
EXCLAMATION = 0.292
QUESTION = 0.18
MANY_QUESTIONS = 0.96
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
CHUNK_SIZE = 300
CHUNK_SLAB = 32
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BOOSTERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fully", "greatly",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly",
    "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally",
    "tremendously", "unbelievably", "unusually", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "mightnt", "mustnt", "neither", "never", "none", "nope", "nor", "not",
    "nothing", "nowhere", "rarely", "seldom", "shouldnt", "uhuh", "wasnt", "werent", "without",
    "wont", "wouldnt", "despite",
]
# A small lexicon of our own in tenths, so that an analysis runs before a full one is loaded
STARTER_LEXICON = {
    "amazing": 28, "appreciate": 17, "awesome": 31, "best": 32, "better": 19, "easy": 19,
    "enjoy": 22, "enjoyed": 23, "excellent": 27, "fantastic": 26, "fast": 10, "friendly": 22,
    "glad": 20, "good": 19, "grateful": 20, "great": 31, "happy": 27, "helpful": 18, "kind": 24,
    "like": 15, "love": 32, "nice": 18, "perfect": 27, "pleasant": 23, "pleased": 19,
    "polite": 17, "recommend": 15, "satisfied": 18, "smooth": 10, "solved": 15, "thank": 15,
    "thanks": 19, "welcome": 20, "wonderful": 27,
    "angry": -23, "annoyed": -16, "annoying": -17, "awful": -20, "bad": -25, "boring": -13,
    "broken": -21, "complaint": -15, "confusing": -9, "difficult": -15, "disappointed": -21,
    "error": -17, "fail": -25, "failed": -23, "fraud": -28, "frustrated": -24,
    "frustrating": -19, "hate": -27, "horrible": -25, "ignored": -13, "issue": -8, "lost": -13,
    "mistake": -14, "pain": -23, "poor": -21, "problem": -17, "rude": -20, "sad": -21,
    "scam": -27, "slow": -9, "stuck": -10, "terrible": -21, "trouble": -17, "unhappy": -18,
    "upset": -16, "useless": -18, "waste": -18, "worse": -21, "worst": -31, "wrong": -21,
}


@dataclass(frozen=True)
class Scorer:
    """A lexicon in tenths of a valence point with the words that modify it."""

    lexicon: Mapping[str, int] = field(default_factory=lambda: STARTER_LEXICON)
    boosters: Sequence[str] = tuple(BOOSTERS)
    dampeners: Sequence[str] = tuple(DAMPENERS)
    negations: Sequence[str] = tuple(NEGATIONS)
    contrast: str = "but"

    def __post_init__(self) -> None:
        if len(self.lexicon) > MAX_LITERAL_LEXICON:
            raise ValueError(
                f"a lexicon above {MAX_LITERAL_LEXICON} words is scored by join, see polarity_by_join"
            )


def word_lookup(scorer: Scorer) -> Callable[[Column], Column]:
    """A function from a lower-case word to ``struct<tenths, boost, negates>``, null for other words.

    Valences and modifiers share one table, so a word is looked up once.
    """
    entries: dict[str, dict] = {w: {"tenths": int(t)} for w, t in scorer.lexicon.items()}
    for word in scorer.boosters:
        entries.setdefault(word, {})["boost"] = BOOST
    for word in scorer.dampeners:
        entries.setdefault(word, {})["boost"] = -BOOST
    for word in scorer.negations:
        entries.setdefault(word, {})["negates"] = True
    size = 1
    while size * 4 < len(entries):
        size *= 2
    buckets: list[dict[str, dict]] = [{} for _ in range(size)]
    for word, entry in entries.items():
        buckets[zlib.crc32(word.encode()) % size][word] = entry
    table = F.from_json(
        F.lit(json.dumps(buckets)), "array<map<string,struct<tenths:int,boost:double,negates:boolean>>>"
    )
    return lambda word: F.get(table, F.pmod(F.crc32(word.cast("binary")), F.lit(size)).cast("int"))[word]


def sentence_chunks(column: Column, size: int = CHUNK_SIZE) -> Column:
    """Sentences packed into chunks of about ``size`` characters; a longer sentence stands alone.

    A fold copies its state at every step, so the sentences are folded in slabs
    of about the square root of their number: the closed chunks of a slab join
    the result once per slab.
    """
    none = F.array().cast("array<string>")

    def state(done: Column, current: Column) -> Column:
        return F.struct(done.alias("done"), current.alias("open"))

    def closed(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(strip(s["open"]))))

    def pack(s: Column, sentence: Column) -> Column:
        fits = F.length(s["open"]) + F.length(sentence) <= size
        longer = F.concat(s["open"], F.lit(" "), sentence)
        return F.when(fits, state(s["done"], longer)).otherwise(state(closed(s), sentence))

    def pack_slab(s: Column, slab: Column) -> Column:
        return let(
            F.aggregate(slab, state(none, s["open"]), pack),
            lambda inner: state(F.concat(s["done"], inner["done"]), inner["open"]),
        )

    def folded(sentences: Column) -> Column:
        def in_slabs(width: Column) -> Column:
            last = ((F.size(sentences) - 1) / width).cast("int")
            slabs = F.transform(
                F.sequence(F.lit(0), last), lambda i: F.slice(sentences, i * width + 1, width)
            )
            return F.aggregate(slabs, state(none, F.lit("")), pack_slab, closed)

        return let(F.greatest(F.lit(CHUNK_SLAB), F.ceil(F.sqrt(F.size(sentences))).cast("int")), in_slabs)

    return let(F.split(text_or_empty(column), r"(?<=[.!?]) +"), folded)


def words_of(chunk: Column) -> Column:
    """Words split at white space; marks around a word of more than two characters go."""
    raw = F.array_remove(F.split(chunk, WHITE_SPACE_RUN), "")

    def bare(word: Column) -> Column:
        trimmed = F.btrim(word, F.lit(PUNCTUATION))
        # trimming costs more than everything else about a word, so the ends are looked at first
        marked = _starts_with_mark(word) | _starts_with_mark(F.substring(word, -1, 1))
        return F.when(marked & (F.length(trimmed) > 2), trimmed).otherwise(word)

    return F.transform(raw, bare)


def _starts_with_mark(word: Column) -> Column:
    return F.ascii(word).isin([ord(mark) for mark in PUNCTUATION])


def _emphasis(chunk: Column) -> Column:
    def count(mark: str) -> Column:
        return F.octet_length(chunk) - F.octet_length(F.replace(chunk, F.lit(mark), F.lit("")))

    def for_questions(n: Column) -> Column:
        return F.when(n <= 1, F.lit(0.0)).when(n <= 3, n * QUESTION).otherwise(F.lit(MANY_QUESTIONS))

    return F.least(count("!"), F.lit(4)) * EXCLAMATION + let(count("?"), for_questions)


def _is_capital(word: Column) -> Column:
    small = F.ascii(word).between(ord("a"), ord("z"))
    return ~small & (F.lower(word) != word) & (F.upper(word) == word)


def _valences(words: Column, scorer: Scorer, lookup) -> Column:
    """The valences, in order, of those words that have one, after their neighbours have had their say.

    All other words count as 0.  They are looked up and left alone: what a step makes of a word is
    copied, so nothing but the word itself and what is known of it is kept for each of them.
    """

    def of_known(words: Column, lowered: Column, known: Column) -> Column:
        def with_setting(setting: Column) -> Column:
            def loudness(position: Column, negative: Column) -> Column:
                capital = setting["mixed"] & _is_capital(F.get(words, position))
                return F.when(capital, F.when(negative, F.lit(-CAPITALS)).otherwise(F.lit(CAPITALS))).otherwise(F.lit(0.0))

            def one(position: Column) -> Column:
                def step(valence: Column, back: Column) -> Column:
                    place = position - back
                    before, word = F.get(known, place), F.get(lowered, place)
                    damping = (
                        F.when(back == 1, F.lit(DAMPING[0])).when(back == 2, F.lit(DAMPING[1])).otherwise(F.lit(DAMPING[2]))
                    )
                    sign = F.when(valence < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
                    boosted = valence + (before["boost"] * sign + loudness(place, valence <= 0)) * damping
                    negates = F.contains(word, F.lit("n't")) | F.coalesce(before["negates"], F.lit(False))
                    return (
                        F.when((place < 0) | before["tenths"].isNotNull(), valence)
                        .when(before["boost"].isNotNull(), F.when(negates, boosted * NEGATION).otherwise(boosted))
                        .when(negates, valence * NEGATION)
                        .otherwise(valence)
                    )

                plain = F.get(known, position)["tenths"] / 10.0
                loud = plain + loudness(position, plain <= 0)
                turn = (
                    F.when(setting["turn"] == 0, F.lit(1.0))
                    .when(position + 1 < setting["turn"], F.lit(BEFORE_CONTRAST))
                    .when(position + 1 > setting["turn"], F.lit(AFTER_CONTRAST))
                    .otherwise(F.lit(1.0))
                )
                return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), loud, step) * turn

            return F.transform(setting["places"], one)

        own = F.transform(known, lambda k, i: F.when(k["tenths"].isNotNull() & k["boost"].isNull(), i))
        setting = F.struct(
            (F.exists(words, _is_capital) & F.exists(words, lambda w: ~_is_capital(w))).alias("mixed"),
            F.array_position(lowered, F.lit(scorer.contrast)).alias("turn"),
            F.array_compact(own).alias("places"),
        )
        return let(setting, with_setting)

    def of_words(own: Column) -> Column:
        return let(F.transform(own, F.lower), lambda low: let(F.transform(low, lookup), lambda known: of_known(own, low, known)))

    return let(words, of_words)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _squash(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + NORMALISER), 4)


def _total_with_emphasis(total: Column, emphasis: Column) -> Column:
    return total + F.signum(total) * emphasis


def chunk_compound(chunk: Column, scorer: Scorer, lookup) -> Column:
    total = F.aggregate(_valences(words_of(chunk), scorer, lookup), F.lit(0.0), _plus)
    return let(total, lambda t: _squash(_total_with_emphasis(t, _emphasis(chunk))))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), _plus) / F.size(values)


def polarity(column: Column, scorer: Scorer, lookup=None) -> Column:
    """Mean compound score over the chunks of a text; null for a blank one.

    ``lookup`` tells what is known of a word, if not the lexicon of the scorer.
    """
    lookup = lookup or word_lookup(scorer)
    scores = F.transform(sentence_chunks(column), lambda c: chunk_compound(c, scorer, lookup))
    return F.when(strip(text_or_empty(column)) != "", let(scores, mean_of))


def polarity_parts(column: Column, scorer: Scorer, lookup=None) -> Column:
    """``struct<compound, strongest>`` of a whole text as one chunk.

    ``strongest`` is the largest of the positive, negative and neutral shares.
    """
    lookup = lookup or word_lookup(scorer)
    text = text_or_empty(column)

    def parts(words: Column, valences: Column) -> Column:
        def side(keep, value) -> Column:
            return F.aggregate(F.transform(F.filter(valences, keep), value), F.lit(0.0), _plus)

        sums = F.struct(
            F.aggregate(valences, F.lit(0.0), _plus).alias("total"),
            side(lambda v: v > 0, lambda v: v + 1.0).alias("pos"),
            side(lambda v: v < 0, lambda v: 1.0 - v).alias("neg"),
            (F.size(words) - F.size(F.filter(valences, lambda v: v != 0))).cast("double").alias("neu"),
            _emphasis(text).alias("emphasis"),
        )

        def shares(s: Column) -> Column:
            pos = s["pos"] + F.when(s["pos"] > s["neg"], s["emphasis"]).otherwise(F.lit(0.0))
            neg = s["neg"] + F.when(s["pos"] < s["neg"], s["emphasis"]).otherwise(F.lit(0.0))
            return F.struct(
                _squash(_total_with_emphasis(s["total"], s["emphasis"])).alias("compound"),
                F.round(F.greatest(pos, neg, s["neu"]) / (pos + neg + s["neu"]), 3).alias("strongest"),
            )

        return let(sums, shares)

    nothing = F.struct(F.lit(0.0).alias("compound"), F.lit(0.0).alias("strongest"))
    return F.when(strip(text) == "", nothing).otherwise(
        let(words_of(text), lambda words: let(_valences(words, scorer, lookup), lambda valences: parts(words, valences)))
    )
