"""The lexicon score against a plain statement of the rule."""

from __future__ import annotations

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed
from voxtally.functions.hybrid import hybrid_score, keyword_group_score
from voxtally.functions.lexicon import MAX_LITERAL_LEXICON, Scorer, polarity, polarity_parts, sentence_chunks
from voxtally.operators.polarity import polarity_by_join, score_polarity

SCORER = Scorer()
WORDS = [
    "good", "GOOD", "bad", "terrible!", "very", "VERY", "slightly", "not", "isn't", "but", "great", "the",
    "thing", "love", "hate", "(kind)", "so", "never", "Thing.", "A", "ok?", "really", "worst!!!", "what??",
]


def chunks_of(text: str) -> list[str]:
    done, current = [], ""
    for sentence in re.split(r"(?<=[.!?]) +", text):
        if len(current) + len(sentence) <= 300:
            current = current + " " + sentence
        else:
            if current != "":
                done.append(current.strip())
            current = sentence
    return done + [current.strip()] if current != "" else done


def valences_of(chunk: str) -> list[float]:
    words = []
    for raw in chunk.split():
        bare = raw.strip(string.punctuation)
        words.append(raw if len(bare) <= 2 else bare)
    low = [w.lower() for w in words]
    capital = [w.isupper() for w in words]
    mixed = 0 < sum(capital) < len(words)
    modifiers = {**{w: 0.293 for w in SCORER.boosters}, **{w: -0.293 for w in SCORER.dampeners}}
    out = []
    for i, word in enumerate(low):
        if word not in SCORER.lexicon or word in modifiers:
            out.append(0.0)
            continue
        v = SCORER.lexicon[word] / 10
        if capital[i] and mixed:
            v += 0.733 if v > 0 else -0.733
        for back, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
            j = i - back
            if j < 0 or low[j] in SCORER.lexicon:
                continue
            s = 0.0
            if low[j] in modifiers:
                s = modifiers[low[j]] * (-1 if v < 0 else 1)
                if capital[j] and mixed:
                    s += 0.733 if v > 0 else -0.733
            v += s * damping
            if low[j] in SCORER.negations or "n't" in low[j]:
                v *= -0.74
        out.append(v)
    if "but" in low:
        turn = low.index("but")
        out = [v * (0.5 if i < turn else 1.5 if i > turn else 1.0) for i, v in enumerate(out)]
    return out


def emphasis_of(chunk: str) -> float:
    asks = chunk.count("?")
    return min(chunk.count("!"), 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)


def compound_of(chunk: str) -> float:
    total = sum(valences_of(chunk))
    total += math.copysign(emphasis_of(chunk), total) if total else 0.0
    return round(total / math.sqrt(total * total + 15), 4)


def polarity_of(text: str):
    if not text.strip():
        return None
    scores = [compound_of(c) for c in chunks_of(text)]
    return sum(scores) / len(scores)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = ["", "   ", "Good.", "NOT GOOD", "!!!", "a. b. c."]
    # more sentences than one slab of the chunk packer holds
    out.append(" ".join(rng.choice(WORDS) + rng.choice([".", "", "!"]) for _ in range(6000)))
    for _ in range(200):
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))))
    return out


def test_chunks(value, texts):
    assert value(sentence_chunks, *texts) == [chunks_of(t) for t in texts]


def test_polarity(value, texts):
    got = value(lambda t: polarity(t, SCORER), *texts)
    for mine, want in zip(got, [polarity_of(t) for t in texts]):
        assert (mine is None and want is None) or mine == pytest.approx(want, abs=2e-4)


def test_join_gives_the_same(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lexicon = spark.createDataFrame(list(SCORER.lexicon.items()), "token string, valence_tenths int")
    inside = score_polarity(df, "k", "t", lexicon, SCORER).select("k", "polarity")
    joined = polarity_by_join(df, "k", "t", lexicon, SCORER).select("k", "polarity")
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, joined.collect()))


def test_a_large_lexicon_is_not_put_into_the_plan():
    with pytest.raises(ValueError):
        Scorer(lexicon={str(i): 1 for i in range(MAX_LITERAL_LEXICON + 1)})


def test_parts(value, texts):
    got = value(lambda t: polarity_parts(t, SCORER), *texts)
    for text, part in zip(texts, got):
        if not text.strip():
            assert (part["compound"], part["strongest"]) == (0.0, 0.0)
            continue
        v, e = valences_of(text), emphasis_of(text)
        pos, neg = sum(x + 1 for x in v if x > 0), sum(1 - x for x in v if x < 0)
        pos, neg = pos + (e if pos > neg else 0), neg + (e if pos < neg else 0)
        neutral = sum(x == 0 for x in v)
        assert part["compound"] == pytest.approx(compound_of(text), abs=2e-4)
        assert part["strongest"] == pytest.approx(max(pos, neg, neutral) / (pos + neg + neutral), abs=2e-3)


def test_keyword_groups(value):
    got = value(keyword_group_score, "Excellent, good service", "nothing to add, all great", "", "xyz")
    assert (got[0]["kw_score"], got[0]["kw_total"]) == ((9 + 7 + 7) / 3, 3)
    # nothing, nothing to add, great, and the override
    assert (got[1]["kw_score"], got[1]["kw_total"]) == ((0 + 0 + 7 + 6) / 4, 4)
    assert [(g["kw_score"], g["kw_total"]) for g in got[2:]] == [(0.0, 0), (0.0, 0)]


def test_hybrid_by_hand(value):
    def both(t):
        return hybrid_score(t, polarity_parts(t, SCORER), keyword_group_score(t))

    got = value(both, "good service", "")
    lexicon = 10 * compound_of("good service")
    weights = [0.40 - 0.05 - 0.10, 0.20 - 0.025 + 0.05, 0.20 - 0.025 - 0.05, 0.20 + 0.10 + 0.10]
    scores = [lexicon, lexicon / 2, lexicon / 2, 7.0]
    mean = sum(scores) / 4
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / 4)
    shares = 2.9 / 3.9
    conf = round(shares, 3) * 0.6 + (1 - spread / 10) * 0.4 + 0.15
    assert got[0]["score"] == pytest.approx(sum(w * s for w, s in zip(weights, scores)) / sum(weights), abs=1e-9)
    assert got[0]["conf"] == pytest.approx(min(0.95, conf), abs=1e-9)
    assert (got[1]["score"], got[1]["conf"]) == (0.0, 0.0)


def test_no_python_in_the_score(spark):
    df = spark.createDataFrame([("good",)], "t string").select(polarity(F.col("t"), SCORER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_keyword_groups_against_single_searches(value):
    rng = random.Random(11)
    pieces = [p for g in fixed.REVIEW_GROUPS.values() for p in g] + ["xx", "no", "nothing", "complain", "GOOD"]
    texts = [rng.choice([" ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = value(keyword_group_score, *texts)
    for text, found in zip(texts, got):
        low = text.lower().strip()
        hits = [fixed.REVIEW_GROUP_WEIGHTS[g] for g, ps in fixed.REVIEW_GROUPS.items() for p in ps if p in low]
        patterns = [".*".join("(?:" + "|".join(words) + ")" for words in steps) for steps in fixed.POSITIVE_OVERRIDES]
        if any(re.search(p, low) for p in patterns):
            hits.append(6.0)
        assert found["kw_total"] == len(hits)
        assert found["kw_score"] == pytest.approx(sum(hits) / len(hits) if hits else 0.0)
