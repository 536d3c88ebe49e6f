from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtally import fixed_values as fixed
from voxtally.rules import (
    PROFILE_NAMES,
    Dictionary,
    Phrases,
    default_profile,
    dictionary_from_table,
    merge_dictionaries_by_appending,
    merge_dictionaries_by_replacing,
    phrase_regex,
    phrases_from_table,
)

WORD = st.text(alphabet="ab c'-.(", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=8), st.text(alphabet="abC c'-.(", max_size=40))
def test_phrase_regex_finds_what_a_longest_first_alternation_finds(phrases, text):
    plain = "|".join(re.escape(p.lower()) for p in sorted(phrases, key=len, reverse=True))
    expected = re.findall(plain, text, re.IGNORECASE)
    assert re.findall(phrase_regex(phrases), text, re.IGNORECASE) == expected


def test_phrase_regex_in_the_jvm(value):
    from pyspark.sql import functions as F

    phrases = fixed.TAGGED_NEGATIVE
    plain = "(?iU)" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))
    texts = [
        "Still HAVE NOT received it, not received!",
        "not working properly and not working",
        "You don't want to help; unhelpful, no help",
        "all is well",
    ]
    shared = value(lambda t: F.regexp_extract_all(t, F.lit(Phrases.of(phrases).regex), F.lit(0)), *texts)
    assert shared == value(lambda t: F.regexp_extract_all(t, F.lit(plain), F.lit(0)), *texts)
    assert shared[0] == ["Still HAVE NOT received", "not received"]


def test_case_folding_covers_accents(value):
    assert value(lambda t: Phrases.of(["été"]).count_in(t), "ÉTÉ été") == 2


def test_word_boundary_is_an_option(value):
    assert value(lambda t: Phrases.of(["sue"]).found_in(t), "an issue") is True
    assert value(lambda t: Phrases.of(["sue"], word_boundary=True).found_in(t), "an issue") is False
    assert value(lambda t: Phrases.of(["sue"], word_boundary=True).found_in(t), "I will sue") is True


def test_dictionary_merges():
    base = Dictionary.of({"a": ["x", "y"], "b": ["z"]})
    assert base.replaced_by({"a": ["q"], "c": ["w"]}).categories == {"a": ("q",), "b": ("z",), "c": ("w",)}
    assert base.extended_by({"a": ["y", "q"], "c": ["w"]}).categories == {"a": ("x", "y", "q"), "b": ("z",), "c": ("w",)}


def test_dictionary_tables_merge_alike(spark):
    base = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "category string, phrase string")
    extra = spark.createDataFrame([("a", "y"), ("a", "q"), ("c", "w")], "category string, phrase string")
    replaced = {tuple(r) for r in merge_dictionaries_by_replacing(base, extra).collect()}
    appended = {tuple(r) for r in merge_dictionaries_by_appending(base, extra).collect()}
    assert replaced == {("a", "y"), ("a", "q"), ("b", "z"), ("c", "w")}
    assert appended == {("a", "x"), ("a", "y"), ("a", "q"), ("b", "z"), ("c", "w")}


def test_rules_from_tables(spark):
    tiers = spark.createDataFrame([("negative", "slow"), ("strong_negative", "so slow")], "tier string, phrase string")
    cascade = default_profile("tagged_chat").cascade.with_phrases(phrases_from_table(tiers))
    negative = next(t for t in cascade.tiers if t.name == "negative")
    assert negative.phrases.phrases == ("slow",)
    assert negative.refinements[0].phrases.phrases == ("so slow",)
    rows = [("b", 0, "z"), ("a", 1, "x"), ("a", 2, "y")]
    loaded = dictionary_from_table(spark.createDataFrame(rows, "category string, ordinal int, phrase string"))
    assert loaded.categories == {"b": ("z",), "a": ("x", "y")}


def test_large_rule_tables_are_refused(spark):
    from voxtally.rules import bounded_rows

    with pytest.raises(ValueError):
        bounded_rows(spark.range(11), limit=10)


def test_profiles():
    assert {default_profile(n).name for n in PROFILE_NAMES} == set(PROFILE_NAMES)
    assert default_profile("unknown").name == "tagged_chat"
    assert len(default_profile("tagged_chat").dictionary.categories) == 18
    assert "i do not want this membership" in default_profile("bracket_chat").dictionary.categories["unwanted_actions"]
    assert not any("{brand}" in p for n in PROFILE_NAMES for p in default_profile(n).dictionary.phrases)
    branded = default_profile("pipe_chat", brands=["acme"])
    assert "acme for artists" in branded.dictionary.phrases
