"""Rules for the driver's tables.

The texts are invented prose, so these phrases carry no meaning; they exist to
reach every branch.  They are ordinary parameters of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.common import strip
from voxtally.functions.lexicon import Scorer
from voxtally.operators.lookups import last_wins
from voxtally.plans.analyze import analyze
from voxtally.rules import (
    Dictionary,
    Phrases,
    Profile,
    five_tier_cascade,
    four_tier_cascade,
    no_positive_cascade,
    trigger_cascade,
)
from voxtally.sources.readers import spread

VERY_NEGATIVE = Phrases.of(["schst"])
VERY_POSITIVE = Phrases.of(["ononst"])
POSITIVE = Phrases.of(["with that", "was the", "die die"])
NEGATIVE = Phrases.of(["for the", "three", "ción"])
STRONG = Phrases.of(["hehely", "three"])
RESOLUTION = Phrases.of(["from", "this"])
NEUTRAL = Phrases.of(["and the", "entre", "iere"])

FIVE_TIER = five_tier_cascade(
    VERY_NEGATIVE, VERY_POSITIVE, POSITIVE, POSITIVE, NEGATIVE, STRONG, RESOLUTION, NEUTRAL
)
FOUR_TIER = four_tier_cascade(VERY_POSITIVE, POSITIVE, POSITIVE, NEGATIVE, STRONG, RESOLUTION, NEUTRAL)
NO_POSITIVE = no_positive_cascade(NEGATIVE, STRONG, RESOLUTION, NEUTRAL)
TRIGGERS = trigger_cascade(NEGATIVE, NEUTRAL)

DICTIONARY = Dictionary.of(
    {
        "openings": ["with that", "was the"],
        "slow_delivery": ["for the", "three", "for"],
        "schaden": ["schst", "die die", "ción"],
        "endings": ["ononst", "hehely", "tionst"],
        "inner_part": ["hre"],
        "never_seen": ["zzqqx", "qqxzz"],
    }
)
REPLACING = {"endings": ["orantion", "rewh"], "new_topic": ["inoran"]}
APPENDING = {"endings": ["orantion", "ononst"], "new_topic": ["inoran"]}

LEXICON = {
    "the": 4, "of": -7, "and": 12, "to": -15, "a": 9, "is": -11, "for": 19, "on": -3, "was": 21,
    "die": -19, "der": 8, "und": -5, "la": 13, "de": -13, "que": 17, "le": -22, "en": 6,
    "thatin": 31, "rewh": -28, "orre": 15, "hehely": -33, "er": 2, "an": -9, "los": 11,
}
SCORER = Scorer(
    lexicon=LEXICON,
    boosters=("in", "that", "des"),
    dampeners=("it", "von"),
    negations=("with", "by", "les", "zu"),
    contrast="from",
)

GROUPS = {
    "very_positive": ["ononst", "with that", "entre"],
    "positive": ["was the", "die", "for", "los"],
    "neutral_phrases": ["and the", "und"],
    "negative_phrases": ["for the", "of the"],
    "very_negative": ["schst", "hehely"],
    "moderate_negative": ["three", "ción", "iere", "que"],
}
OVERRIDE_STEPS = [[["from"], ["schst", "three"]], [["no"], ["that", "der"], ["und", "with"]]]

PROFILE = Profile("pipe_or_plain", DICTIONARY, FIVE_TIER, groups=GROUPS)
PIPE_PROFILE = Profile("pipe_chat", DICTIONARY, TRIGGERS)
REVIEW_PROFILE = Profile("review", DICTIONARY, groups=GROUPS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are expensive to score, spread over the cores."""
    df = table(spark, folder, name)
    return spread(df.select(*columns) if columns else df)


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of reviewers, derived from the quality marks; one of them is no known label."""
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("Positive"))
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("Very Negative"))
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("mixed"))
    )
    marks = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("_id_norm"), label.alias("override_label"), "doc_id"
    )
    return last_wins(marks.where(F.col("override_label").isNotNull()), "_id_norm", "override_label", "doc_id")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction per document, negative for those marked toxic, its confidence spread over [0.5, 1)."""
    marks = table(spark, folder, "labels").select("doc_id", "toxic")
    return table(spark, folder, "documents").select("doc_id").join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("row_key"),
        F.when(F.col("toxic") == 1, F.lit("NEGATIVE")).otherwise(F.lit("POSITIVE")).alias("label"),
        (F.lit(0.5) + F.pmod(F.col("doc_id") * 7, F.lit(50)) / F.lit(100.0)).alias("score"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon as a table; repeated tokens count with their largest valence."""
    rows = [*LEXICON.items(), ("the", -40), ("rewh", -29)]
    return spark.createDataFrame(rows, "token string, valence_tenths int")


def result(spark: SparkSession, folder: str, threshold: float = 0.7, with_overrides: bool = True, **more) -> DataFrame:
    """The analysis of all documents; reports run on it."""
    return analyze(
        texts(spark, folder, "documents"),
        PROFILE,
        "doc_id",
        "text",
        overrides=overrides(spark, folder) if with_overrides else None,
        rule_threshold=threshold,
        scorer=SCORER,
        **({"row_key": "doc_id"} | more),
    )


# ---------------------------------------------------------------------------
# Transcripts derived from documents, inside each row: one turn per line
# ---------------------------------------------------------------------------
TAGGED_SPEAKERS = ["Support Bot", "Dana", "Lee", "System"]
SMS_SPEAKERS = ["Care Team", "5550001", "Dana"]
CLOCK = "10:00:00"


def _lines():
    plain = F.translate(F.col("text"), "<|:[", "(/;(")
    return F.filter(F.transform(F.split(plain, "\n"), strip), lambda line: line != "")


def transcripts(spark: SparkSession, folder: str, form: str) -> DataFrame:
    """``(doc_id, transcript)`` in one of the transcript formats."""

    def speaker(names, position):
        chosen = F.lit(names[0])
        for i, name in enumerate(names):
            turn = F.pmod(position * position + F.col("doc_id"), F.lit(len(names)))
            chosen = F.when(turn == i, F.lit(name)).otherwise(chosen)
        return chosen

    def tagged(line, i):
        return F.concat(F.lit(f"<b>{CLOCK} "), speaker(TAGGED_SPEAKERS, i), F.lit(" :</b> "), line, F.lit(" <br/>"))

    def sms(line, i):
        return F.concat(F.lit(f"{CLOCK} "), speaker(SMS_SPEAKERS, i), F.lit(": "), line, F.lit(" SSN rule for Chat"))

    def bracket(line, i):
        return F.concat(F.lit(f"[{CLOCK} "), speaker(["AGENT", "CUSTOMER"], i), F.lit("]: "), line)

    def pipe(line, i):
        said = F.concat(F.lit("2024-01-01 "), speaker(["Agent", "Consumer", "Customer"], i), F.lit(": "), line)
        return F.when(F.pmod(i, F.lit(5)) == 0, F.concat(said, F.lit(" Consumer: again"))).otherwise(said)

    turn, glue = {
        "tagged": (tagged, ""), "sms": (sms, " "), "bracket": (bracket, " "), "pipe": (pipe, " | "),
    }[form]
    return texts(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(F.transform(_lines(), turn), glue).alias("transcript")
    )
