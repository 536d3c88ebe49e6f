"""Checks of long texts stop early, and say what the plain ones say."""

from __future__ import annotations

import re
import time
import unicodedata

from pyspark.sql import functions as F

from voxtally.functions.text import clean_review, meaningless_reason
from voxtally.functions.unicode import _combining, _forms, _odd


def test_class_of_odd_characters(spark):
    """One comparison first: the class holds the same characters, and ordinary text is searched at once."""
    points = [p for p in range(0x3000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, t string")
    odd = {r.p for r in rows.where(F.col("t").rlike(_odd())).collect()}
    assert odd == {p for p in points if p >= 0x2070 or chr(p) in _combining() or chr(p) in _forms()}
    assert re.match(r"\[\\x\{a0\}-\\x\{10ffff\}&&", _odd())


def test_composed_as_python_does(value):
    for text in ("été", " a b", "ﬁne", "plain", "\U0001f600 ok", "각x"):
        assert value(clean_review, text) == unicodedata.normalize("NFKC", text).strip().strip("\U0001f600 ")


def test_meaningless_reasons(value):
    cases = {
        "N.-/A": "normalised=na", " o?k_": "normalised=ok", "naa": "ok", "n a x": "ok", "none\n": "normalised=none",
        "yes\n?": "ok", "good good good": "repeated_word", "good Good": "ok", "good good1": "ok", "good": "ok", "good goo": "ok",
        "goo good": "ok", "a\nb": "ok", "a\na": "repeated_word", "éa éa": "no_words", "1 good 1 good": "repeated_word",
        "1234567 ab": "mostly_numbers", "12 34 ab ab": "repeated_word", "": "empty", "q": "pattern=^[a-zA-Z]$",
    }
    assert {t: value(meaningless_reason, t) for t in cases} == cases


def test_repeated_words_cost_their_length(value):
    start = time.time()
    assert value(meaningless_reason, "same " * 100_000) == "repeated_word"
    assert time.time() - start < 20
