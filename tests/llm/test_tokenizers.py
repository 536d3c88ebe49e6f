"""Encoders against the tokenizer libraries, and round trips of files and packings."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from llm_rows import docs, no_docs, texts  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import op2_token_counts, op6_byte_bpe, op7_token_files, op9_packing
from llm.common import shared_folder
from llm.pretokens import BlockEncoder

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    lines = open(MULTI, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(BPE)
    found.encode_special_tokens = True
    return found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'strevmldl \n\t\r 　é1٢#$—日́👍"), max_size=60))
def test_merge_replay_gives_the_library_ids(library, text):
    encoder = op6_byte_bpe.rank_encoder(MULTI)[0]
    assert [x.tolist() for _, x in encoder.encode([text, None])] == [library.encode_ordinary(text), []]


def test_small_blocks_and_caches_change_nothing(library):
    text = " ".join(f"word{i % 50} it's  {i}\n" for i in range(400))
    small = BlockEncoder(op6_byte_bpe.rank_encoder(MULTI)[0].encode_pieces, block=40, memory=5)
    assert [x.tolist() for _, x in small.encode([text, "", "ab"])] == [library.encode_ordinary(text), [], library.encode_ordinary("ab")]


def test_encoding_and_decoding(docs, texts, library):
    rows = op6_byte_bpe.encode(docs, MULTI, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    again = op6_byte_bpe.decode(op6_byte_bpe.encode(docs, MULTI), MULTI).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in again) == Counter((i, (t or "").encode()) for i, t in texts)


def test_query_digests(spark, library):
    from llm.queries import byte_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, texts, tokenizer):
    folder = shared_folder(spark, "tests")
    index = op7_token_files.write_token_files(docs, folder, BPE, end_id=2)
    rows = sorted(op7_token_files.read_token_files(index, folder).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    by_id = defaultdict(list)
    for i, t in texts:
        by_id[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids) and r.ids in by_id[r.doc_id]
        start += r.n_tokens
    chosen = op7_token_files.read_token_files(index.where("doc_id IN (8, 12)"), folder).collect()
    assert {(r.doc_id, r.start) for r in chosen} == {(r.doc_id, r.start) for r in rows if r.doc_id in (8, 12)}


def test_a_damaged_frame_is_noticed(tmp_path, monkeypatch):
    monkeypatch.setattr(op7_token_files, "FRAME", 8)
    path = str(tmp_path / "ids.zst")
    writer = op7_token_files.FrameWriter(path, 2)
    writer.write(np.arange(30, dtype=np.uint32))
    writer.close()
    reader = op7_token_files.FrameReader(path, 2)
    assert reader.read(7, 3).tolist() == [7, 8, 9] and set(reader.frames) == {0, 1}
    reader.checks[2] ^= 1
    with pytest.raises(OSError, match="checksum"):
        reader.read(16, 1)


def check_packing(rows, expected: Counter, sequence: int = 2048) -> None:
    places = sorted((r.sequence_id * sequence + r.offset, r.length, r.offset) for r in rows)
    end = 0
    for place, length, offset in places:  # gapless: only the last sequence is short
        assert place == end and offset + length <= sequence
        end += length
    assert end == sum(n * k[1] for k, n in expected.items())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert {i: sum(p[1] for p in v) for i, v in pieces.items()} == {i: sum(n * k[1] for k, n in expected.items() if k[0] == i) for i in {k[0] for k in expected}}


@pytest.mark.parametrize("targets", [None, {"hot": 0.5}])
def test_packing_is_whole(docs, texts, tokenizer, targets):
    rows = op9_packing.pack(docs, BPE, end_id=1, targets=targets, sequence=64, window=4).collect()
    ids = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    check_packing(rows, Counter((i, len(ids[i, t])) for i, t in texts), 64)
    for r in rows:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for (i, _), x in ids.items() if i == r.doc_id)


def test_sources_without_a_queue_of_their_own_are_in_every_window(spark):
    """Eight sources of thirty documents, stored one after the other, and sources of one document."""
    rows = [(100 * s + i, " ".join(f"w{i}" for _ in range(12)), f"s{s}") for s in range(8) for i in range(30)]
    rows += [(1000 + i, "one two three", f"single{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(4, "doc_id")
    out = op9_packing.pack(docs, BPE, end_id=1, targets={}, sequence=64, window=16).collect()
    check_packing(out, Counter({(r.doc_id, r.doc_tokens): 1 for r in out}), 64)
    assert {r.doc_id for r in out} == {i for i, _, _ in rows}
    windows = max(r.window_id for r in out)
    held = Counter()
    for r in out:
        held[r.window_id, r.doc_id // 100] += r.length
    longest = max(r.doc_tokens for r in out)
    for s in range(8):
        total = sum(n for (_, x), n in held.items() if x == s)
        share = total * 1024 / sum(held.values())
        assert all(abs(held[w, s] - share) <= 3 * longest for w in range(windows)) and windows >= 3
    assert sum(any(held[w, s] for s in range(10, 11)) for w in range(windows)) == windows


def test_windows_follow_the_targets():
    schedule = op9_packing.Schedule([100_000, 20_000, 5_000], [0.5, 0.3, 0.2], 1_000)
    sent = np.array([schedule.by(w) for w in range(20)])
    assert np.abs(np.diff(sent, axis=0) - [500, 300, 200]).max() <= 1  # whole tokens, fractions carried
    assert schedule.by(schedule.windows).tolist() == [100_000, 20_000, 5_000]
    places = op9_packing.Places(schedule, 2048)
    taken = sorted((s * 2048 + o, n) for q, t in enumerate(schedule.totals.tolist()) for _, n, s, o, _ in places.pieces(q, 0, t))
    assert all(a + n == b for (a, n), (b, _) in zip(taken, taken[1:]))


def as_unigram(model: bytes) -> bytes:
    """The model file with its type set to unigram, so that the library itself runs Viterbi on the same pieces."""

    def fields(start, end):
        while start < end:
            tag, start = number(start)
            if tag & 7 == 2:
                size, start = number(start)
            else:
                size = {0: number(start)[1] - start if tag & 7 == 0 else 0, 1: 8, 5: 4}[tag & 7]
            yield tag >> 3, start, start + size
            start += size

    def number(place):
        value = shift = 0
        while True:
            value |= (model[place] & 127) << shift
            place, shift = place + 1, shift + 7
            if model[place - 1] < 128:
                return value, place

    trainer = next((a, b) for f, a, b in fields(0, len(model)) if f == 2)
    kind = next(a for f, a, _ in fields(*trainer) if f == 3)
    return model[:kind] + b"\x01" + model[kind + 1 :]


@pytest.fixture(scope="module")
def unigram():
    return SentencePieceProcessor(model_proto=as_unigram(open(PIECES, "rb").read()))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdethin  erst日☃👍éß.\n"), max_size=40))
def test_counts_are_those_of_the_library(unigram, text):
    counter, normalize = op2_token_counts.load_model(PIECES)
    assert counter.count(normalize(text))[1] == len(unigram.encode(text))


def test_ties_go_to_the_earliest_start():
    counter = op2_token_counts.CountViterbi({"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0}, False)
    assert counter.count("abc") == (-3.0, 1)
    assert counter.count("abcab") == (-5.0, 2)
    assert counter.count("a??b")[1] == 3  # a run of unknown characters is one piece


def plain_viterbi(pieces, unknown, text):
    """Every segmentation's best score, by the definition."""
    best = [(0.0, 0)] + [None] * len(text)
    for start in range(len(text)):
        covered = False
        for end in range(start + 1, len(text) + 1):
            if (score := pieces.get(text[start:end])) is not None:
                covered |= end == start + 1
                total = best[start][0] + score
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, best[start][1] + 1)
        if not covered:
            total = best[start][0] + unknown
            if best[start + 1] is None or total > best[start + 1][0]:
                best[start + 1] = (total, best[start][1] + len(text[start].encode()))
    return best[-1]


def test_counts_of_all_rows(docs, texts):
    model = SentencePieceProcessor(model_file=PIECES)
    plain = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
    unknown = min(pieces.values()) - 10
    rows = op2_token_counts.token_counts(docs, PIECES).collect()
    short = [(i, t) for i, t in texts if len(t or "") < 1000]
    found = Counter((r.doc_id, r.n_tokens, r.score) for r in rows)
    assert len(rows) == len(texts)
    for i, t in short:
        score, count = plain_viterbi(pieces, unknown, model.normalize(t)) if t else (0.0, 0)
        assert found[i, count, score]


def test_empty_tables(spark, no_docs):
    assert op2_token_counts.token_counts(no_docs, PIECES).count() == 0
    assert op6_byte_bpe.encode(no_docs, MULTI).count() == 0
    folder = shared_folder(spark, "tests")
    index = op7_token_files.write_token_files(no_docs, folder, BPE, end_id=2)
    assert op7_token_files.read_token_files(index, folder).count() == 0
    assert op9_packing.pack(no_docs, BPE, end_id=1).count() == 0
    assert no_docs.select(F.col("doc_id")).count() == 0


@pytest.mark.parametrize("totals", [[30_000_000_000_000, 1_000_000_000_000, 7], [10**15, 10**14, 10**15 - 3]])
def test_schedules_hold_any_number_of_tokens(totals):
    """Sent tokens follow the shares to within a token a phase, also where a shifted count leaves 64 bits."""
    schedule = op9_packing.Schedule(totals, [float(t) for t in totals], 131_072)
    assert schedule.by(schedule.windows).tolist() == totals
    for part in (0.001, 0.37, 0.9):
        window = int(schedule.windows * part)
        sent, then = schedule.by(window), schedule.by(window + 1)
        assert (sent >= 0).all() and (then >= sent).all()
        for total, before, after in zip(totals, sent.tolist(), then.tolist(), strict=True):
            if total > 10**6:
                assert abs(before / total - window * 131_072 / sum(totals)) < 1e-4
                assert abs((after - before) / 131_072 - total / sum(totals)) < 1e-3
    place = totals[0] * 2 // 3
    window = schedule.window_of(0, place)
    assert schedule.by(window)[0] <= place < schedule.by(window + 1)[0]


def test_ids_that_do_not_fit_the_files_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index = op7_token_files.write_token_files(docs, f"file://{tmp_path}/wide", BPE, end_id=1 << 17, width=4)
    assert op7_token_files.read_token_files(index, f"file://{tmp_path}/wide", width=4).first().ids[-1] == 1 << 17
    with pytest.raises(Exception, match="does not fit"):
        op7_token_files.write_token_files(docs, f"file://{tmp_path}/narrow", BPE, end_id=1 << 17, width=2)
