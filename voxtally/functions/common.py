"""Small building blocks shared by all column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space around and inside text
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same characters as a pattern; the class of Unicode white space is much faster than a list
WHITE_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# the same runs but for single spaces
UNEVEN_SPACE = r"(?U) [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside ``body``.

    Lambda bodies are outside common-subexpression elimination; a one-element
    array binds the value to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a column of its own, for ``select`` and ``withColumn``: the optimiser takes no filter and no later use of it apart.

    Filters over a computed column are pushed below it otherwise, and repeat what it is computed from for every mention.
    """
    return F.explode_outer(F.array(value))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITE_SPACE))


def squeeze(column: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return strip(F.regexp_replace(column, UNEVEN_SPACE, " "))


def is_blank(column: Column) -> Column:
    return F.octet_length(F.coalesce(column, F.lit(""))) == 0


def string_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def or_all(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def and_all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out
