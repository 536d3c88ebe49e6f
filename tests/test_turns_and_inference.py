from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxtally.operators import inference, turns

TURNS = "c int, pos long, who string, said string"


def brute(rows, digits_first=False):
    by_conversation = defaultdict(list)
    for c, pos, who, said in sorted(rows):
        if who.lower() != "system" and (said.strip() or not digits_first):
            by_conversation[c].append((pos, who.strip().lower(), said))
    out = {}
    for c, said in by_conversation.items():
        names = list(dict.fromkeys(w for _, w, _ in said))
        numbers = [n for n in names if n.isdigit()]
        people = [n for n in names if not any(a in n.lower().split() for a in ("agent", "bot", "care"))] or names
        who = numbers[0] if digits_first and numbers else min(people, key=lambda n: sum(w == n for _, w, _ in said))
        out[c] = (who, " ".join(" ".join(t.split()) for _, w, t in said if w == who and t.strip()))
    return out


@pytest.mark.parametrize("digits_first", [False, True])
def test_customer_text_with_one_huge_conversation(spark, monkeypatch, digits_first):
    monkeypatch.setattr(turns, "SEGMENT", 10)
    rng = random.Random(3)
    names = ["Care Bot", "Dana", "Lee", "agent", "555", "System"]
    rows = [(0, p, rng.choice(names), f"m{p}  x") for p in range(400)]
    rows += [(c, p, rng.choice(names), rng.choice(["hi there", " ", "ok\nthen"])) for c in range(1, 120) for p in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    want = brute(rows, digits_first)
    picked = {r["c"]: r["who"] for r in turns.pick_customer(df, "c", "who", "pos", digits_first, "said").collect()}
    assert picked == {c: who for c, (who, _) in want.items()}
    rows = turns.customer_text(df, "c", "who", "pos", "said", digits_first).collect()
    assert len(rows) == len(want)
    assert {r["c"]: r["customer_text"] for r in rows} == {c: text for c, (_, text) in want.items()}


@pytest.mark.parametrize("rows", [1, 2, 7, 8, 9, 100, 5003])
def test_evenly_spaced(spark, monkeypatch, rows):
    monkeypatch.setattr(inference, "SMALL_BUCKET", 50)
    monkeypatch.setattr(inference, "BUCKETS", 16)
    rng = random.Random(rows)
    # a third of the keys are close together
    keys = sorted(set(rng.sample(range(10**9), rows)) | set(range(rows // 2)))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    n = len(keys)
    size = min(8, n)
    want = {i: keys[i * (n - 1) // max(size - 1, 1)] for i in range(size)}
    got = {r["sample_position"]: r["k"] for r in inference.evenly_spaced(df, "k").collect()}
    assert got == want


def test_evenly_spaced_over_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(inference, "SMALL_BUCKET", 50)
    monkeypatch.setattr(inference, "BUCKETS", 16)
    keys = sorted([-5] * 20 + [7] * 900 + list(range(2**62, 2**62 + 300)))
    df = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "k long, t string").repartition(4)
    got = inference.evenly_spaced(df, "k").collect()
    assert {r["sample_position"]: r["k"] for r in got} == {i: keys[i * 1219 // 7] for i in range(8)}
    assert len({r["t"] for r in got}) == len(got) == 8


def test_texts_to_sample_are_computed_once_and_for_few_rows(spark, monkeypatch):
    monkeypatch.setattr(inference, "SMALL_BUCKET", 50)
    monkeypatch.setattr(inference, "BUCKETS", 16)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(k):
        calls.add(1)
        return None if k % 2 else f"text {k}"

    df = spark.range(2000).repartition(4).select(F.col("id").alias("k"), told("id").alias("t"))
    got = inference.evenly_spaced(df, "k", among=F.col("t").isNotNull()).collect()
    assert {r["sample_position"]: (r["k"], r["t"]) for r in got} == {i: (2 * (i * 999 // 7), f"text {2 * (i * 999 // 7)}") for i in range(8)}
    assert calls.value <= 2 * 2000  # twice in the pass for the keys at most, and for the rows found


def test_text_and_id_columns(spark):
    rows = [(i, i % 3, f"some longer text number {i}", "x") for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, words string, s string")
    assert inference.infer_text_column(df) == "words"
    assert inference.infer_id_column(df, "words") == "a"
    assert inference.infer_id_column(df.select("b", "words"), "words") is None
    assert inference.infer_id_column(df.withColumnRenamed("b", "Ticket ID"), "words") == "Ticket ID"
    assert inference.infer_text_column(df.select("a", "s")) is None


@pytest.mark.parametrize(
    "text,profile",
    [
        ("[10:00:01 agent]: hello", "bracket_chat"),
        ("2024-01-01 x\n Consumer: hi", "pipe_chat"),
        ("a | consumer: hi", "pipe_chat"),
        ("<b>10:00:01 A:</b> hello there", "tagged_chat"),
        ("10:00:01 Care Team : hello", "tagged_chat"),
        ("consumer: without a pipe", "review"),
        ("just a friendly comment", "review"),
    ],
)
def test_detect(spark, text, profile):
    df = spark.createDataFrame([(i, text + " and some more words") for i in range(20)], "id int, body string")
    assert inference.detect(df, "id") == (profile, "id", "body")


def test_detect_needs_both_roles(spark):
    assert inference.detect(spark.createDataFrame([(1, "short")], "id int, t string"), "id") is None


def test_speakers_are_compared_without_case_and_blanks(spark):
    rows = [(1, 0, "Dana", "a"), (1, 1, "dana ", "b"), (1, 2, "Lee", "c"), (1, 3, "Agent", "d")]
    rows += [(2, 0, "Dana", " "), (2, 1, "Dana", "hi"), (2, 2, "Lee", "x")]
    rows += [(3, p, "Kim", f"m{p}") for p in range(3000)]
    df = spark.createDataFrame(rows, TURNS)
    assert {r["c"]: (r["who"], r["messages"]) for r in turns.pick_customer(df, "c", "who", "pos").where("c = 1").collect()} == {1: ("lee", 1)}
    sms = {r["c"]: r["customer_text"] for r in turns.customer_text(df, "c", "who", "pos", "said", digits_first=True).collect()}
    assert sms[2] == "hi" and sms[3] == " ".join(f"m{p}" for p in range(3000))
