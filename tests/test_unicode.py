"""Entities and compatibility forms in the JVM, against Python's own tables."""

from __future__ import annotations

import html
import random
import unicodedata
from html.entities import html5

from conftest import SMALL
from pyspark.sql import functions as F

from voxtally.functions.text import unescape_full
from voxtally.functions.unicode import native_form, needs_python

FIXED = [
    None, "", "plain & simple", "&amp;lt; &lt;b&gt;", "&eacute;&Eacute;", "&#39;&#8217;&#x2019;&#65", "&ampfoo &unknown; &", "&#0;&#128;&#xD800;&#1114112;",
    "Straße für Übermut, „Gänsefüßchen“", "été à la carte, œuvre, 12 €", "niño ¿qué? mañana", "ﬁne ½ ² ™ … Ａｂｃ", "é ạ̈", "각각 가", "´ ¨ ¯",
    "𝒳 mathematical 𝟙", "日本語 ｶﾞｷﾞ", "&NotEqualTilde; &fjlig; &nbsp;x", "a&b&c;d", "&&amp;;", "क़ ো",
]


def plain(text):
    return None if text is None else unicodedata.normalize("NFKC", html.unescape(text))


def strings(rng, count):
    pools = [range(32, 127), range(0xA0, 0x250), range(0x250, 0x3000), range(0x3000, 0xD800), range(0xF900, 0x10000), range(0x1D000, 0x1F000), range(0x300, 0x370), range(0x1100, 0x1200)]
    names = sorted(html5)
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.25:
                parts.append("&" + rng.choice(names))
            elif kind < 0.35:
                parts.append(rng.choice(("&#%d;", "&#%d", "&#x%x;", "&#X%x")) % rng.randrange(0x11000))
            else:
                parts.append("".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 3))))
        yield "".join(parts)


def test_forms_are_those_of_python(spark):
    texts = [*FIXED, *strings(random.Random(4), 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    rows = df.select("i", unescape_full(F.col("t")).alias("full"), native_form(F.col("t")).alias("native"), needs_python(F.col("t")).alias("away")).collect()
    for r in rows:
        assert r.full == plain(texts[r.i]), (texts[r.i], r.full)
        if not r.away:
            assert r.native == plain(texts[r.i]), texts[r.i]
    assert sum(not r.away for r in rows) > 300


def test_every_character_by_itself(spark):
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(p, chr(p)) for p in points], "p int, t string").repartition(8)
    rows = df.select("p", native_form(F.col("t")).alias("n"), needs_python(F.col("t")).alias("away")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", chr(r.p)) for r in rows if not r.away)
    assert sum(r.away for r in rows) < 2500


def test_european_texts_stay_in_the_jvm(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    away = documents.where(needs_python(F.col("text")))
    assert documents.where("lang IN ('de', 'fr', 'es')").count() > 20 and away.count() == 0
