from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from voxtally.functions import keywords as kw
from voxtally.functions import labels, language, text
from voxtally.rules import Dictionary


def test_normalise_id(value):
    assert value(text.normalise_id, "  A b\t c ", None) == ["Ab\tc", None]


def test_clean_boilerplate(value):
    cases = ["Chat with an AGENT please  help\n me", "four", "abcdef", "a bc", None, "talk to agent"]
    assert value(text.clean_boilerplate, *cases) == ["please help me", "", "", "", "", ""]


def test_strip_names_takes_the_longest_first(value):
    names = ["therapy", "physical therapy", "you"]
    assert value(lambda t: text.strip_names(t, names), "My Physical Therapy, thank you for your time") == "My , thank for r time"


def test_redaction_orders(value):
    sample = "mail a.b@c.org, card 4111111111111111, call (212) 555-0199, ssn 123-45-6789"
    assert value(text.redact, sample) == "mail [EMAIL], card [CARD], call [PHONE], ssn [SSN]"
    legacy = value(lambda t: text.redact(t, legacy_order=True), "card 4111111111111111")
    assert legacy == "card [PHONE]111111"


def test_redaction_is_idempotent(value):
    sample = "x@y.org 5111111111111111 212-555-0199 123-45-6789"
    once = value(text.redact, sample)
    assert value(text.redact, once) == once


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab@._ +\n<>", max_size=25), min_size=20, max_size=20))
def test_mail_addresses_are_found_as_by_the_plain_pattern(value, texts):
    plain = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
    assert value(text.redact, *texts) == [plain.sub("[EMAIL]", t) for t in texts]
    loose = [re.sub(r"\S+@\S+\.\S+", " ", t) for t in texts]
    loose = [re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", re.sub(r"<[^>]+>", " ", t)) for t in loose]
    tidy = [re.sub(r"^[^\w']+|[^\w']+$", "", " ".join(re.sub(r"([!?.,])\1+", r"\1", t).split())) for t in loose]
    assert value(text.strip_markup, *texts) == tidy


def test_long_runs_do_not_cost_their_square(value):
    run = "a1" * 200_000
    assert value(text.redact, run + " a@b.org") == run + " [EMAIL]"
    assert value(text.clean_review, "x > " + "<" * 200_000 + " y")[-1] == "y"
    assert value(text.clean_review, "x" + "=" * 100_000 + "y" + "z" * 100_000)[-1] == "z"


def test_clean_review(value):
    raw = '  <p>Caf&eacute; &amp; MaÃ±ana!!! see https://x.org/a or mail me@x.org ﬁne</p>\x07 "'
    assert value(text.clean_review, raw) == "Café & Mañana! see or mail fine"
    assert value(text.clean_review, None, "plain") == ["", "plain"]


def test_meaningless_reasons(value):
    cases = {
        "": "empty",
        None: "empty",
        "N/A": "normalised=na",
        "n o n e": "normalised=none",
        "k": r"pattern=^[a-zA-Z]$",
        "1234": r"pattern=^[0-9]+$",
        "nope": r"pattern=^(nil|none|non|nope)$",
        "okay": r"pattern=^(ok|okay|yes|no|y|n)$",
        "?!": r"pattern=^[^\w\s]+$",
        "zzzz": r"pattern=^(.)\1+$",
        "é": "single_char",
        "? ! ?": "no_alnum",
        "12 34": "no_words",
        "good good good": "repeated_word",
        "a 1234 5678": "mostly_numbers",
        "a1234 b5678": "no_words",
        "Good good": "ok",
        "all fine here": "ok",
    }
    assert dict(zip(cases, value(text.meaningless_reason, *cases))) == cases


def test_shorten_and_highlight(value):
    assert value(lambda t: text.shorten(t, 3), "abcd", "abc", None) == ["abc…", "abc", None]
    marked = value(lambda t: text.highlight(t, ["work", "doesn't work"]), "It doesn't WORK, work")
    assert marked == "It **doesn't WORK**, **work**"


def test_prefer_translation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hi", "hola"), ("", "hola"), (None, "hola")], "t string, c string")
    assert [r[0] for r in df.select(text.prefer_translation(F.col("t"), F.col("c"))).collect()] == ["hi", "hola", "hola"]


def test_labels(spark):
    from pyspark.sql import functions as F

    scores = [0.6, 0.2, 0.199, -0.2, -0.201, -0.6, -0.601, None, float("nan")]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in df.select(labels.label_of(F.col("s"))).collect()] == [
        "Very Positive", "Positive", "Neutral", "Neutral", "Negative", "Negative", "Very Negative", "Neutral", "Neutral",
    ]
    wide = spark.createDataFrame([(s,) for s in [5.0, 4.99, 1.0, 0.99, -2.0, -2.01, -3.0, -3.01]], "s double")
    assert [r[0] for r in wide.select(labels.wide_label_of(F.col("s"))).collect()] == [
        "Very Positive", "Positive", "Positive", "Neutral", "Neutral", "Negative", "Negative", "Very Negative",
    ]


def test_confidence_bands_and_score_of(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.71,), (0.7,), (0.3,), (0.29,)], "c double")
    assert [r[0] for r in df.select(labels.confidence_band(F.col("c"))).collect()] == ["High", "Medium", "Medium", "Low"]
    names = spark.createDataFrame([("Negative",), ("odd",)], "l string")
    assert [r[0] for r in names.select(labels.score_of(F.col("l"), 10.0)).collect()] == [-5.5, 0.0]


def test_language(value):
    cases = ["hi", "¿Qué pasa?", "muy como siempre", "the cat is not here", "le chat noir"]
    found = value(language.language_tag, *cases)
    assert [(f["lang"], f["lang_confidence"]) for f in found] == [
        ("en", 1.0), ("es", 0.95), ("es", 0.95), ("en", 0.99), ("en", 0.8),
    ]
    assert value(language.english_gate, "x", " ", None) == ["en", "non-en", "non-en"]


def _keywords(text_value: str, phrases: list[str]) -> list[str]:
    pattern = "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))
    seen, out = set(), []
    for hit in re.findall(pattern, text_value, re.IGNORECASE):
        if hit.lower() not in seen:
            seen.add(hit.lower())
            out.append(hit)
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abAB ", max_size=30), min_size=20, max_size=20))
def test_keywords_against_brute_force(spark, value, texts):
    phrases = ["ab", "aba", "b a", "bb"]
    dictionary = Dictionary.of({"one": phrases[:2], "two": phrases[2:]})
    assert value(lambda t: kw.keywords_in(t, dictionary), *texts) == [_keywords(t, phrases) for t in texts]


def test_keywords_keep_the_first_spelling(value):
    dictionary = Dictionary.of({"a": ["not working", "not working properly"], "b": ["angry"]})
    got = value(lambda t: kw.joined(kw.keywords_in(t, dictionary)), "ANGRY: Not Working properly, not working, angry")
    assert got == "ANGRY; Not Working properly; not working"
    assert value(lambda t: kw.categories_in(t, dictionary), "so angry", "fine") == [["b"], []]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abABck ", max_size=25), min_size=20, max_size=20))
def test_categories_against_one_search_per_category(value, texts):
    dictionary = Dictionary.of(
        {"one": ["ab", "k a"], "two": ["aba", "bc"], "three": ["ba"], "four": ["ab", "abac"], "five": []}
    )
    want = [
        [c for c, phrases in dictionary.categories.items() if any(p in t.lower() for p in phrases)] for t in texts
    ]
    assert value(lambda t: kw.categories_in(t, dictionary), *texts) == want
    assert value(lambda t: kw.categories_in(t, dictionary), "\u212a A", "\u017f") == [["one"], []]


def test_links_end_at_unicode_white_space(value):
    from voxtally.functions.text import clean_review

    assert value(clean_review, "see www.x.com/a\u2028bad service here") == "see bad service here"
    assert value(lambda c: clean_review(c, full_unicode=False), "see www.x.com/a\u00a0bad service") == "see bad service"


def test_letters_like_ascii_keep_their_categories(value):
    from voxtally.functions.keywords import categories_in
    from voxtally.rules import default_profile

    dictionary = default_profile("pipe_chat").dictionary
    phrase = next(p for p in dictionary.phrases if "i" in p or "s" in p)
    plain = value(lambda c: categories_in(c, dictionary), f"x {phrase} y")
    assert plain
    for odd in (phrase.upper().replace("I", "\u0130"), phrase.replace("i", "\u0131"), phrase.replace("s", "\u017f")):
        assert value(lambda c: categories_in(c, dictionary), f"{phrase}, {odd}") == plain


def test_heavy_ids_use_many_tasks(spark):
    from pyspark.sql import functions as F

    from voxtally.operators.lookups import _salts, lookup_join

    left = spark.createDataFrame([("hot", "same")] * 1000 + [(None, "n")] * 50 + [(str(i), "x") for i in range(200)], "k string, t string")
    right = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    assert _salts(left, "k")["hot"] > 100
    joined = lookup_join(left, right, "k", hot_keys=True, max_bytes=0)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r.v, r["count"]) for r in joined.groupBy("v").count().collect()} == {(1, 1000), (2, 1), (None, 249)}
    assert joined.where(F.col("k") == "hot").count() == 1000
