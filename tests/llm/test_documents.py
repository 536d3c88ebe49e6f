"""Document operators against plain restatements, on rows with every odd case."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs, no_docs, texts  # noqa: F401
from oracle import connect, difference
from pyspark.sql import functions as F

from llm import op1_toxicity, op3_warc, op4_quality_rules, op5_sentence_spans, op8_jaccard_join, op10_metric_search, slots
from llm.common import arrow_strings, released, shared_folder
from llm.pretokens import mixed
from llm.words import shingle_sets, word_hashes, word_spans

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op4_quality_rules", "op10_metric_search"])
def test_oracles(spark, name):
    from llm.queries import ORACLES, QUERIES

    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def plain_measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs, texts):
    rows = op4_quality_rules.ledger(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in rows) == Counter((i, *plain_measures(t)) for i, t in texts)
    assert {r.doc_id for r in rows if r.failures & 1} >= {5, 6, 7, 8, 9}
    assert {r.doc_id: r.failures & 2 > 0 for r in rows}[17]
    assert {r.doc_id: r.failures & 16 > 0 for r in rows}[16]


def test_ablations_count_what_each_rule_does(docs):
    rows = op4_quality_rules.ledger(docs)
    plain = [r.failures for r in rows.collect()]
    for r in op4_quality_rules.ablations(rows, [op4_quality_rules.BASE, op4_quality_rules.STANDARD]).collect():
        policy = {p.name: p for p in (op4_quality_rules.BASE, op4_quality_rules.STANDARD)}[r.policy]
        bit = 1 << list(op4_quality_rules.RULES).index(r.rule)
        assert r.kept == sum(not f & policy.mask for f in plain) and r.kept + r.rejected == len(plain)
        assert r.failing == sum(bool(f & bit) for f in plain) and r.only_by_rule == sum(f & policy.mask == bit for f in plain)


def plain_components(texts):
    def lowered(text):
        return (text or "").translate({c: c + 32 for c in range(65, 91)})

    sets = []
    for _, text in texts:
        words = WORD.findall(lowered(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    least, moved = list(range(len(texts))), True
    while moved:
        moved = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    ids = [i for i, _ in texts]
    label = [min((ids[b] for b in range(len(ids)) if least[b] == least[a] and ids[b] is not None), default=None) if sets[a] else ids[a] for a in range(len(ids))]
    return Counter(zip(ids, map(len, sets), label, strict=True))


def test_similar_documents(spark, docs, texts, monkeypatch):
    rng = random.Random(5)
    words = texts[0][1].split(" ")
    chain = []
    for i in range(40):  # a loose group: many members are too far from each other to be linked
        own = list(words)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        chain.append((100 + i, " ".join(own)))
    more = spark.createDataFrame(chain, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    monkeypatch.setattr(op8_jaccard_join, "CHUNK", 8)
    rows = op8_jaccard_join.similar_documents(both).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == plain_components([*texts, *chain])


def held_in(folder):
    return sorted(str(f.relative_to(folder)).split("/")[0] for f in folder.rglob("*.parquet") if f.is_dir())


def test_sets_and_spans_do_not_stay_on_disk(docs, tmp_path, monkeypatch):
    """Sets of shingles and rows of spans are about as large as the texts; what is left is read by the result."""
    monkeypatch.setattr(op8_jaccard_join, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(op5_sentence_spans, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    similar, passages = op8_jaccard_join.similar_documents(docs), op5_sentence_spans.without_repeats(docs)
    assert held_in(tmp_path / "jaccard") == ["ids.parquet", "labels.parquet"]
    assert held_in(tmp_path / "spans") == ["drop.parquet"]
    assert similar.count() == passages.count() == docs.count()


def test_maps_in_pieces_of_the_shared_folder(spark, docs, tmp_path):
    """Corpora with more tokens than slots of a broadcast: the maps lie in pieces, and the groups stay the same."""
    texts_ = docs.select(F.col("text").cast("string").alias("text"))

    def tokens_of(data, offsets):
        return shingle_sets(data, offsets, 5)[0]

    held = slots.slot_maps(texts_, 16, tokens_of)
    filed = slots.filed_maps(texts_, 16, tokens_of, f"file://{tmp_path}/maps")
    every = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    known = np.unpackbits(held[0]) + np.unpackbits(held[1])
    there = np.isin(np.arange(1 << 16) >> filed.width, [int(x.name.split("-")[1]) for x in (tmp_path / "maps").glob("piece-*")])
    assert known.any() and (filed.kinds(every[there]) == known[there]).all() and not known[~there].any()
    rows = [Counter(op8_jaccard_join.similar_documents(docs, held_bits=bits).collect()) for bits in (28, 15)]
    assert rows[0] == rows[1]


def test_shuffle_files_are_released(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    spark.range(10_000).repartition(7, "id").write.format("noop").mode("overwrite").save()
    mine = shuffled() - before
    assert mine
    for _ in range(50):
        released(spark)
        if not mine & shuffled():
            break
        time.sleep(0.2)
    assert not mine & shuffled()


def test_similar_documents_of_an_empty_table(no_docs):
    assert op8_jaccard_join.similar_documents(no_docs).count() == 0


def plain_pieces(words):
    """A unit's words as pieces: long ones are cut before the least word pair of each eight, by the pairs' hashes."""
    if len(words) <= 10:
        return [words]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    own = [int(h) for h in word_hashes(data, starts, ends, lower=False)]
    with np.errstate(over="ignore"):
        pairs = [int(mixed(np.array([a * 3 + b & (1 << 64) - 1], np.uint64))[0]) for a, b in zip(own, own[1:], strict=False)]
    least = {i for s in range(len(pairs) - 7) for i in range(s, s + 8) if pairs[i] == min(pairs[s : s + 8])}
    cuts = [i for i in sorted(least) if i and pairs[i] not in pairs[max(0, i - 7) : i] + pairs[i + 1 : i + 8]]
    return [words[x:y] for x, y in zip([0, *cuts], [*cuts, len(words)], strict=True)]


def plain_spans(units):
    """First unit and end of every shortest run of three units and twelve words, from either end; all of a shorter text."""
    size, least = len(units), max(1, min(3, len(units)))
    words = [sum(map(len, units[:i])) for i in range(size + 1)]
    forward = {(i, next((j for j in range(i + least, size + 1) if words[j] - words[i] >= 12), None)) for i in range(size)}
    back = {(next((i for i in range(j - least, -1, -1) if words[j] - words[i] >= 12), None), j) for j in range(size + 1)}
    return sorted(x for x in forward | back if None not in x)


def plain_repeats(texts):
    """Texts after removal, restated over lists of units."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    first, held, done = {}, {}, {}
    for k in order:
        doc, text = texts[k]
        if text is None or (doc, text) in held:
            continue
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        units, own = [], []
        for n, (a, b) in enumerate(words):
            own.append(n)
            gap = text[b : words[n + 1][0]] if n + 1 < len(words) else "\n"
            if text[b - 1] in ".!?,;:" or "\n" in gap:
                sizes = map(len, plain_pieces([text[slice(*words[i])] for i in own]))
                for size in sizes:
                    units.append(own[:size])
                    own = own[size:]
        kinds = {(i, j): tuple(tuple(text[slice(*words[n])] for n in u) for u in units[i:j]) for i, j in plain_spans(units)}
        held[doc, text] = words, units, kinds
        for place, kind in kinds.items():
            first.setdefault(kind, (doc, text, place))
    for (doc, text), (words, units, kinds) in held.items():
        drop = {n for (i, j), kind in kinds.items() if first[kind] != (doc, text, (i, j)) for n in range(i, j)}
        starts = [words[u[0]][0] for u in units] + [len(text)]
        kept = text[: starts[0]] + "".join(text[starts[i] : starts[i + 1]] for i in range(len(units)) if i not in drop)
        done[doc, text] = kept.rstrip(" \t\n\x0b\x0c\r") if len(units) - 1 in drop else kept
    return Counter((i, done.get((i, t), t)) for i, t in texts)


def test_repeated_spans(docs, texts):
    out = op5_sentence_spans.without_repeats(docs)
    assert out.columns == [*docs.columns, "n_units_removed"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == plain_repeats(texts)


def test_repeated_spans_of_an_empty_table(no_docs):
    assert op5_sentence_spans.without_repeats(no_docs).count() == 0


def fresh(rng, words):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(words)]


def test_a_passage_in_short_units_goes(spark):
    """Sixty words in lines of three, and words that each carry a mark."""
    rng = random.Random(11)
    shared = [" ".join(line) for line in zip(*[iter(fresh(rng, 60))] * 3, strict=True)]
    marked = [w + "!!" for w in fresh(rng, 60)]
    rows, hosts = [], [fresh(rng, 15) for _ in range(4)]
    for i, host in enumerate(hosts):
        inner = "\n".join(shared) if i < 2 else " ".join(marked)
        rows.append((i, " ".join(host) + ".\n" + inner + "\n" + " ".join(reversed(host)) + "."))
    out = {r.doc_id: r.text for r in op5_sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and out[2] == rows[2][1]
    for i in (1, 3):
        assert out[i].split() == (" ".join(hosts[i]) + ". " + " ".join(reversed(hosts[i])) + ".").split()


def test_any_fifty_shared_words_hold_a_span():
    """Marks anywhere, set into hosts that have marks or none; words that repeat over and over give no cuts."""
    rng = random.Random(12)
    for _ in range(400):
        marks = rng.choice((0.0, 0.02, 0.05, 0.1, 0.3))
        shared = [w + "." * (rng.random() < marks) for w in fresh(rng, 50)]
        hosts = [[[w + "." * (rng.random() < rng.choice((0, 0.2))) for w in fresh(rng, rng.randint(0, 30))] for _ in range(2)] for _ in range(2)]
        column = pa.array([" ".join([*a, *shared, *b]) for a, b in hosts])
        texts, _, _, found = op5_sentence_spans.spans_of(*arrow_strings(column))
        assert set(found[texts == 0].tolist()) & set(found[texts == 1].tolist())
    assert len(op5_sentence_spans.units_of(np.frombuffer(b"a b c d e f " * 10, np.uint8), np.array([0, 120]))[2]) == 2


def test_a_long_passage_in_unmarked_sentences_goes(spark):
    rng = random.Random(13)
    shared = " ".join(fresh(rng, 78))
    rows = [(i, f"{' '.join(fresh(rng, 20))} {shared} {' '.join(fresh(rng, 20))}") for i in range(2)]
    out = {r.doc_id: r.text for r in op5_sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = set(out[1].split()) & set(shared.split())
    assert out[0] == rows[0][1] and len(left) < 40 and set(rows[1][1].split()) - set(shared.split()) <= set(out[1].split())


def test_segments_are_maximal():
    """Ruzzo and Tompa against the recursive definition."""

    def best(scores, low, high):
        found = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
        if found[0] <= 0:
            return []
        _, _, a, b = found
        return best(scores, low, a) + [(a, b - 1, found[0])] + best(scores, b, high)

    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice((-0.5, -0.5, -0.5, rng.uniform(0.1, 3))) for _ in range(rng.randint(0, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = op1_toxicity.segments(at, [scores[i] for i in at])
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in best(scores, 0, len(scores))]
        assert np.allclose([x for _, _, x in found], [x for _, _, x in best(scores, 0, len(scores))])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega")) + str(rng.randrange(40)) for _ in range(80)]
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(("vile", "foul")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vile vile, foul. vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = op1_toxicity.fit(docs, labels)
    scored = {r.doc_id: r for r in op1_toxicity.score(docs, model).collect()}
    assert len(scored) == len(rows)
    assert all(scored[i].predicted == int(i % 5 == 0) for i in range(900)) and not scored[1000].predicted and scored[1001].score == scored[1000].score
    assert scored[None].predicted and scored[None].passages[0].start == 0
    kept = op1_toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in scored.values())
    nothing = op1_toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in op1_toxicity.score(docs, nothing).collect()} == {op1_toxicity.score(docs.limit(1), nothing).first().score}


def test_the_base_rate_does_not_depend_on_the_sample(spark):
    """One label in ten is toxic, also where the sample holds as many of both classes."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(20)) + " vile foul" * (i % 20 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    blank = spark.createDataFrame([(0, "")], "doc_id long, text string")
    whole, part = (op1_toxicity.score(blank, op1_toxicity.fit(docs, labels, sample=n)).first().score for n in (20_000, 100))
    assert abs(part - whole) < 0.05
    plain = docs.withColumn("text", F.lit("alpha beta"))
    assert abs(op1_toxicity.score(blank, op1_toxicity.fit(plain, labels, sample=100)).first().score - 0.1) < 0.04


def test_words_of_few_contexts_are_found_together(spark):
    """Twenty words, each in nine toxic texts, a third of them held out; every toxic text holds two."""
    rng = random.Random(15)
    rows = []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        if i % 10 == 0:
            words[10:10] = [f"bad{(2 * (i // 10) + k) % 20}" for k in (0, 1)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = op1_toxicity.score(docs, op1_toxicity.fit(docs, labels)).where(op1_toxicity.held_out(F.col("doc_id"))).collect()
    toxic = [r.predicted for r in out if r.doc_id % 10 == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in out if r.doc_id % 10) <= 0.02 * len(out)


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = op1_toxicity.fit(docs, labels)
    rows = op1_toxicity.score(docs, model).join(labels, "doc_id").where(op1_toxicity.held_out(F.col("doc_id"))).select("toxic", "predicted").collect()
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[0, 1] <= 0.02 * (right[0, 0] + right[0, 1])
    assert right[1, 1] / (right[1, 1] + right[0, 1]) > 0.9 and right[1, 1] >= 0.5 * (right[1, 0] + right[1, 1])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_round_trip(spark):
    big = "é<html>" * 2000
    rows = [(1, "u1", big), (2, "u2", "same"), (3, None, "same"), (4, "u 4\r\nX: y", None), (5, "u5", ""), (6, "u6", "a\r\n\r\nb"), (7, "u7", big)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, payload int, digest int")
    folder = shared_folder(spark, "tests")
    manifest = op3_warc.write_archives(op3_warc.revisits(pages), folder, chunk=1000)
    chunks = op3_warc.read_chunks(spark, manifest, folder, chunk=1000).orderBy("page_id", "chunk_no").collect()
    last = {int(r.page_id): r for r in chunks if r["last"]}
    for page, _, html in rows:
        payload = (html or "").encode()
        twin = max(p for p, _, h in rows if (h or "") == (html or ""))
        r = last[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), digest(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if twin == page else ("revisit", str(twin)))
        own = [c for c in chunks if c.page_id == str(page)]
        assert [c.chunk_no for c in own] == list(range(len(own))) and all(c.chunk_bytes <= 1000 for c in own)
        if twin == page:
            assert b"".join(bytes(c.data) for c in own) == payload and r.intact
            assert [c.digest_so_far for c in own] == [digest(payload[: 1000 * (n + 1)]) for n in range(len(own))]
    assert op3_warc.round_trip(spark, pages.limit(0)).count() == 0
    small = {r.page_id for r in op3_warc.revisits(pages, min_bytes=5).where("refers_to IS NOT NULL").selectExpr("id AS page_id").collect()}
    assert small == {1}


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(0, 0.2, 8).tolist() for _ in range(600)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7]) for i in range(150)]  # many equal vectors
    odd = [(2000, None), (2001, [None, 1.0] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (None, vectors[0]), (2100, [1.0, 2.0])]
    data = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score int, tree string").repartition(3)
    monkeypatch.setattr(op10_metric_search, "PAGE", 8)
    found = op10_metric_search.top_k(data, F.col("vec_id") % 100 == 0, k=10).collect()
    whole = {i: np.floor(1024 * np.array(np.float32(v), float)).astype(int) for i, v in rows}
    expected = set()
    for q in (i for i, _ in rows if i % 100 == 0):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:10]
        expected |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)
    assert op10_metric_search.top_k(data.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pages_are_pruned():
    rng = np.random.default_rng(2)
    points = (rng.normal(0, 300, (50, 6))[:, None] + rng.normal(0, 5, (50, 60, 6))).reshape(-1, 6).astype(np.int64)
    tree = op10_metric_search.Tree(np.arange(len(points)), points)
    looked = []
    tree.pages = [_Counted(p, looked) for p in tree.pages]
    tree.search(-1, points[0], 10, float("-inf"))
    assert 0 < len(set(looked)) < sum(p["leaf"] for p in map(dict, tree.pages)) / 2


class _Counted(dict):
    def __init__(self, page, looked):
        super().__init__(page)
        self.looked = looked

    def __getitem__(self, key):
        if key == "rows":
            self.looked.append(id(self))
        return super().__getitem__(key)


def test_jaccard_bounds_keep_every_similar_pair():
    """Sketches with few and many buckets never rule out sets that are similar enough, and rule out random ones."""
    generator = np.random.default_rng(5)
    for size in (5, 900, 1100, 4000, 5000, 17000, 70000):
        tokens = generator.integers(0, 1 << 63, 3 * size).astype(np.uint64)
        one = tokens[:size]
        for kept, more in ((1.0, 0.0), (0.86, 0.14), (0.9, 0.12), (0.76, 0.0), (1.0, 0.33), (0.5, 0.5), (0.0, 1.0)):
            two = np.concatenate((one[: int(kept * size)], tokens[size : size + int(more * size)]))
            if not len(two):
                continue
            a, b = (np.frombuffer(op8_jaccard_join.sketch(x), np.uint8).reshape(1, -1) for x in (one, two))
            similar = int(kept * size) >= op8_jaccard_join.needed(len(one), len(two))
            may = bool(op8_jaccard_join.may_overlap(a, b, len(one), len(two))[0])
            assert may or not similar
            assert bool(op8_jaccard_join.may_overlap(b, a, len(two), len(one))[0]) == may
            if size >= 900 and kept == 0:
                assert not may
