"""Whitening, hard negatives and the quality classifier, against plain restatements."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from conftest import SMALL
from llm_rows import docs, no_docs, texts  # noqa: F401
from oracle import connect, difference
from pyspark.sql import functions as F

from llm import op11_whitening, op12_quality_classifier, op13_hard_negatives
from llm.queries import ORACLES, QUERIES

CLASHING = "x string, id string, dim int, k1 int, n int, place int, tree int, component int, rank int, score string"


def vectors_of(spark, rows):
    extra = [None] * len(CLASHING.split(","))
    return spark.createDataFrame([(*row, *extra) for row in rows], f"vec_id long, embedding array<float>, label int, {CLASHING}")


def odd_vectors(dim=6, seed=3):
    """Vectors with copies, ties, nulls, non-finite entries, repeated ids and another number of entries."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)], rng.randrange(3)) for i in range(120)]
    rows += [(200 + i, list(rows[5][1]), 1) for i in range(60)]
    rows += [(300, None, 1), (301, [1.0, None, *[0.0] * (dim - 2)], 1), (302, [math.nan] * dim, 1), (303, [math.inf] * dim, 0), (304, [], 0)]
    rows += [(100, list(rows[7][1]), 2), (100, list(rows[100][1]), rows[100][2]), (None, list(rows[9][1]), 1), (305, list(rows[10][1]), None)]
    rows += [(400 + i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(30)]
    rows += [(500 + i, [0.0] * dim, i % 3) for i in range(8)]
    return rows


def valid(vector):
    return bool(vector) and all(c is not None and math.isfinite(c) for c in vector)


def whole(vector, scale, offset=0):
    return tuple(math.floor(scale * c) + offset for c in np.array(vector, np.float32).astype(float).tolist())


# ---------------------------------------------------------------------------
# Whitening
# ---------------------------------------------------------------------------
def plain_whitening(rows, counts=False):
    """``(n, S, axes, values, trace)`` by number of entries."""
    out = {}
    kept = [whole(v, 64, 1_000_000) for _, v, _ in rows if valid(v)]
    for dim in {len(x) for x in kept}:
        own = [x for x in kept if len(x) == dim]
        fit = own if counts else sorted(set(own))
        n, sums = len(fit), [sum(x[i] for x in fit) for i in range(dim)]
        centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
        covariance = centred.T @ centred / n
        values, axes = np.linalg.eigh(covariance)
        out[dim] = n, sums, axes[:, ::-1], values[::-1], np.trace(covariance)
    return out


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_is_that_of_the_plain_covariance(spark, weights):
    rows = odd_vectors()
    out = op11_whitening.whiten(vectors_of(spark, rows), weights=weights)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    plain = plain_whitening(rows, weights == "counts")
    expected = defaultdict(list)
    for i, v, _ in rows:
        if valid(v):
            x = whole(v, 64, 1_000_000)
            n, sums, axes, values, trace = plain[len(x)]
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            shares = values / trace
            whitened = np.abs(np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ axes / np.sqrt(values))
            expected[i] += [(c + 1, n, deviation, whitened[c], shares[c]) for c in range(len(x))]
    found = defaultdict(list)
    for r in out.collect():
        found[r.vec_id].append((r.component, r.n, int(r.deviation), abs(r.whitened), r.explained))
        assert r.identity_error < 1e-9
    assert found.keys() == expected.keys()
    for key, held in expected.items():
        np.testing.assert_allclose(sorted(found[key]), sorted(held), rtol=1e-7, atol=1e-7)


def test_whitening_has_one_sign_and_sixteen_components(spark):
    out = QUERIES["op11_whitening"](spark, SMALL).toPandas()
    assert out.groupby("vec_id").size().eq(16).all() and out.deviation.dtype == np.int64
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    _, sums, axes, values, _ = plain_whitening([(r.vec_id, r.embedding, 0) for r in rows])[64]
    wide = out.pivot(index="vec_id", columns="component", values="whitened")
    x = np.array([whole(r.embedding, 64, 1_000_000) for r in rows], float)
    plain = ((x - np.array(sums) / len(x)) @ axes / np.sqrt(values))[:, :16]
    own = wide.loc[[r.vec_id for r in rows]].to_numpy()
    signs = np.sign((own * plain).sum(0))
    np.testing.assert_allclose(own, plain * signs, atol=1e-7)


def test_whitening_of_few_vectors_and_of_none(spark):
    same = [(i, [0.25, 0.5], 0) for i in range(5)]
    assert op11_whitening.whiten(vectors_of(spark, same)).count() == 0  # no direction in which they differ
    line = [(i, [float(i), 2.0 * i], 0) for i in range(5)]
    assert {r.component for r in op11_whitening.whiten(vectors_of(spark, line)).collect()} == {1}
    assert op11_whitening.whiten(vectors_of(spark, same).limit(0)).count() == 0


def test_deviations_beyond_a_long_are_exact(spark):
    big = [(i, [float(np.float32(3e13 * (i + 1))), float(np.float32(-7e12 * i * i))], 0) for i in range(4)]
    rows = op11_whitening.whiten(vectors_of(spark, big)).collect()
    held = {i: whole(v, 64, 1_000_000) for i, v, _ in big}
    sums = [sum(x[j] for x in held.values()) for j in range(2)]
    assert {(r.vec_id, int(r.deviation)) for r in rows} == {(i, sum((4 * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in held.items()}


# ---------------------------------------------------------------------------
# Hard negatives
# ---------------------------------------------------------------------------
def plain_negatives(rows, asks, positives=5, negatives=10):
    kept = [(i, label, whole(v, 256)) for i, v, label in rows if i is not None and label is not None and valid(v)]
    out = []
    for i, label, x in sorted({r for r in kept if asks(r[0])}):
        scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in kept if j != i and len(x) == len(y)]
        for score, j, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            inside = sorted(s for s in scores if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score)
            out += [(i, j, n + 1, k, -score, -s) for n, (s, k, _) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_negatives_are_those_of_all_pairs(spark, seed):
    rows = odd_vectors(seed=seed)
    out = op13_hard_negatives.hard_negatives(vectors_of(spark, rows).repartition(4), F.col("vec_id") % 20 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in out.collect())
    assert found and found == plain_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_of_clustered_vectors_and_many_trees(spark, monkeypatch):
    """Small trees and pages, no root balls or all of them: the same rows."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 3) for _ in range(5)] for _ in range(9)]
    rows = []
    for i in range(700):
        own = rng.randrange(9)
        rows.append((i, [c + rng.gauss(0, 0.3) for c in centres[own]], own % 4))
    plain = plain_negatives(rows, lambda i: i % 35 == 0)
    monkeypatch.setattr(op13_hard_negatives, "LEAF", 16)
    monkeypatch.setattr(op13_hard_negatives, "TREE_BYTES", 8 * 5 * 100)
    for root_bytes in (0, 1 << 20):
        monkeypatch.setattr(op13_hard_negatives, "ROOT_BYTES", root_bytes)
        out = op13_hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 35 == 0)
        assert sorted(tuple(r) for r in out.collect()) == plain


def test_negatives_of_an_empty_table_and_without_anchors(spark):
    rows = vectors_of(spark, odd_vectors())
    assert op13_hard_negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert op13_hard_negatives.hard_negatives(rows, F.col("vec_id") < 0).count() == 0


def test_cover_trees_cover():
    """Every row lies within its nodes' radii, nodes part their parent's rows, and the centres of a level are apart."""
    rng = np.random.default_rng(6)
    vectors = np.vstack([rng.integers(-300, 300, (900, 7)), np.repeat(rng.integers(-300, 300, (1, 7)), 700, 0)])
    tree = op13_hard_negatives.built(vectors)
    points = vectors[tree["order"]].astype(float)
    top = (points**2).sum(1).max()
    points = np.column_stack((points, np.sqrt(top - (points**2).sum(1))))
    assert sorted(tree["order"]) == list(range(len(vectors)))
    for low, high, center, radius, (first, last) in zip(*(tree[c] for c in ("low", "high", "center", "radius", "children")), strict=True):
        assert low <= center < high
        assert np.sqrt(((points[low:high] - points[center]) ** 2).sum(1)).max() <= radius + 1e-3
        if first < last:
            spans = list(zip(tree["low"][first:last], tree["high"][first:last], strict=True))
            assert spans[0][0] == low and spans[-1][1] == high and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
            own = points[tree["center"][first:last]]
            gaps = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) + 1e9 * np.eye(len(own))
            assert gaps.min() >= tree["radius"][first:last].max() - 1e-3


def test_registered_negatives_match_their_statement(spark):
    assert difference(QUERIES["op13_hard_negatives"](spark, SMALL), connect(SMALL), ORACLES["op13_hard_negatives"]) is None


# ---------------------------------------------------------------------------
# Quality classifier
# ---------------------------------------------------------------------------
def test_features_are_those_of_the_plain_rule():
    import pyarrow as pa

    def plain(text):
        """Tokens and shapes by regular expression; counts of distinct n-grams."""
        import re

        out, streams, last = set(), ([], []), None
        for found in re.finditer(r"\n|[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", text):
            token = found.group()
            big = sum("A" <= c <= "Z" for c in token)
            if token[0].isdigit() and token[0] < "\x80":
                shape = "digits"
            elif token == "\n":
                shape = "line"
            elif "a" <= token[0].lower() <= "z" or token[0] >= "\x80":
                size = len(token.encode())
                shape = "lower" if not big else "upper" if big == size > 1 else "title" if big == 1 and "A" <= token[0] <= "Z" else "mixed"
            else:
                shape = token
            streams[0].append(token)
            streams[1].append((shape, last == found.start()))
            last = found.end()
        for number, (stream, sizes) in enumerate(zip(streams, ((1, 2), (1, 2, 3, 4)), strict=True)):
            for size in sizes:
                out |= {(number, size, tuple(stream[i : i + size])) for i in range(len(stream) - size + 1)}
        return out

    rows = ["A bc. DEF!!  12|x\n\n| y Été où", "", None, "same same same", "a" * 5000, "x y" * 4]
    buckets, bounds = op12_quality_classifier.features(pa.array(rows))
    sizes = np.diff(bounds).tolist()
    assert sizes == [len(plain(t or "")) for t in rows]  # 18 bits: no collisions in so few n-grams
    for i in range(len(rows)):
        alone, _ = op12_quality_classifier.features(pa.array([rows[i]], pa.string()))
        assert alone.tolist() == buckets[bounds[i] : bounds[i + 1]].tolist()


def test_descent_reaches_the_optimum_of_the_hinge_loss(monkeypatch):
    """Primal and dual value meet: the steps of four shards lead to where one solver would end."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 8))
    y = (x[:, 0] + 0.5 * rng.normal(size=240) > 0).astype(np.int8)
    bounds, buckets = np.arange(0, 8 * 61, 8), np.tile(np.arange(8, dtype=np.int32), 60)
    weights, bias, duals = np.zeros(8), 0.0, [np.zeros(60) for _ in range(4)]
    for turn in range(300):
        steps = [op12_quality_classifier.descended(y[k::4], bounds, buckets, x[k::4].ravel(), duals[k], weights, bias, 4, turn) for k in range(4)]
        duals = [s[0] for s in steps]
        weights = weights + sum(s[1] for s in steps)
        bias += sum(s[2] for s in steps)
    constant = op12_quality_classifier.BIAS
    signs = np.where(y == 1, 1, -1)
    losses = np.maximum(0, 1 - signs * (x @ weights + constant * bias))
    length = (weights @ weights + bias * bias) / 2
    primal, dual = length + op12_quality_classifier.BOUND * losses.sum(), sum(d.sum() for d in duals) - length
    assert abs(primal - dual) < 1e-3 * primal
    assert np.allclose(weights, sum((d * signs[k::4]) @ x[k::4] for k, d in enumerate(duals)))


def test_quality_is_found_in_rows_that_were_held_out(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES["op12_quality_classifier"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r.score, r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    ordered = sum(a > b for a in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.98 and sum(p == y for _, p, y in held) > 0.93 * len(held)


def test_quality_of_odd_rows(spark, docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 18)] + [(4, None, 0), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, id int")
    model = op12_quality_classifier.fit(docs, labels)
    rows = op12_quality_classifier.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6, 7)}) == 1  # null, empty and blank
    assert op12_quality_classifier.score(no_docs, op12_quality_classifier.fit(no_docs, labels)).count() == 0
    for label, known in ((1, labels.where("quality = 1")), (0, labels.where("quality = 0")), (0, labels.limit(0))):
        assert {r.predicted for r in op12_quality_classifier.score(docs, op12_quality_classifier.fit(docs, known)).collect()} == {label}
