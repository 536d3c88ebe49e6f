"""The customer's side of a transcript held in one cell, as column expressions.

All formats are read inside the row: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed
from voxtally.functions.common import let, squeeze, strip, text_or_empty
from voxtally.rules import Phrases

AGENT_NAMES = Phrases.of(words=fixed.AGENT_NAME_WORDS)


def looks_like_agent(name: Column) -> Column:
    return AGENT_NAMES.found_in(name)


def _turns(text: Column, pattern: str, flags: str) -> Column:
    """Turns of a transcript as ``array<struct<speaker, message>>``, in order.

    The whole turns are extracted in one pass over the transcript and then taken
    apart one by one.
    """
    whole = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    return F.transform(
        whole,
        lambda t: F.struct(
            F.lower(strip(F.regexp_extract(t, flags + pattern, 2))).alias("speaker"),
            F.regexp_extract(t, flags + pattern, 3).alias("message"),
        ),
    )


def tagged_turns(text: Column) -> Column:
    """``<b>10:00:01 Name:</b> message <br/>``"""
    return _turns(text, fixed.TAGGED_TURN, "(?isU)")


def sms_turns(text: Column) -> Column:
    """``10:00:01 Name: message 10:00:05 ...`` without the noise lines of the gateway."""

    def quiet(message: Column) -> Column:
        for noise in fixed.SMS_NOISE:
            message = F.regexp_replace(message, "(?U)" + noise, "")
        return strip(message)

    cleaned = F.transform(
        _turns(text, fixed.SMS_TURN, "(?sU)"),
        lambda t: F.struct(t["speaker"].alias("speaker"), quiet(t["message"]).alias("message")),
    )
    return F.filter(cleaned, lambda t: t["message"] != "")


def customer_speaker(turns: Column, digits_first: bool = False) -> Column:
    """Not an agent if possible, then fewest messages, then earliest.

    With ``digits_first`` the first name made of digits only wins outright.
    """

    def pick(speakers: Column) -> Column:
        def ranked(name: Column, position: Column) -> Column:
            messages = F.size(F.filter(turns, lambda t: t["speaker"] == name))
            return F.struct(
                looks_like_agent(name).cast("int").alias("agent"),
                messages.alias("messages"),
                position.alias("position"),
                name.alias("speaker"),
            )

        chosen = F.array_min(F.transform(speakers, ranked))["speaker"]
        if digits_first:
            numbers = F.filter(speakers, lambda s: s.rlike(r"(?U)^\d+$"))
            chosen = F.coalesce(F.get(numbers, F.lit(0)), chosen)
        return chosen

    return let(F.array_distinct(F.transform(turns, lambda t: t["speaker"])), pick)


def messages_of(turns: Column, speaker: Column) -> Column:
    """The messages of one speaker as one text."""
    said = F.transform(
        F.filter(turns, lambda t: t["speaker"] == speaker),
        lambda t: squeeze(t["message"]),
    )
    return F.array_join(F.filter(said, lambda m: m != ""), " ")


def _customer_text(turns: Column, digits_first: bool) -> Column:
    def assemble(people: Column) -> Column:
        text = let(customer_speaker(people, digits_first), lambda who: messages_of(people, who))
        return F.coalesce(text, F.lit(""))

    return let(F.filter(turns, lambda t: t["speaker"] != "system"), assemble)


def extract_tagged(column: Column) -> Column:
    """Tagged turns; SMS turns only where there is no tagged turn at all."""
    text = text_or_empty(column)
    return let(
        tagged_turns(text),
        lambda turns: F.when(F.size(turns) > 0, _customer_text(turns, False)).otherwise(
            let(sms_turns(text), lambda sms: _customer_text(sms, True))
        ),
    )


def extract_bracket(column: Column) -> Column:
    """``[10:00:05 CUSTOMER]: message`` up to the next bracket."""
    said = F.regexp_extract_all(text_or_empty(column), F.lit("(?isU)" + fixed.BRACKET_TURN), F.lit(1))
    return F.array_join(F.filter(F.transform(said, squeeze), lambda m: m != ""), " ")


def extract_pipe(column: Column) -> Column:
    """Parts between pipes that hold ``Consumer:``; the text up to a second marker."""
    parts = F.filter(F.split(text_or_empty(column), r"\|"), lambda p: F.contains(p, F.lit("Consumer:")))
    said = F.transform(parts, lambda p: strip(F.get(F.split(p, "Consumer:"), F.lit(1))))
    return strip(F.array_join(said, " "))


def extract_pipe_or_plain(column: Column) -> Column:
    """Pipe parts marked ``Consumer:`` or else ``Customer:``; plain text where there are none."""
    text = text_or_empty(column)
    consumer, customer = F.lit("Consumer:"), F.lit("Customer:")
    parts = F.filter(
        F.split(text, r"\|"), lambda p: F.contains(p, consumer) | F.contains(p, customer)
    )
    said = F.transform(
        parts,
        lambda p: strip(
            F.when(F.contains(p, consumer), F.get(F.split(p, "Consumer:"), F.lit(1))).otherwise(
                F.get(F.split(p, "Customer:"), F.lit(1))
            )
        ),
    )
    is_chat = F.contains(text, F.lit("|")) & (F.contains(text, consumer) | F.contains(text, customer))
    return F.when(is_chat, strip(F.array_join(said, " "))).otherwise(strip(text))
