"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a slice of the corpus are laid out as one sequence of byte tokens.
An inverted index holds, for every pair that can merge, the positions where it stands.
Merges are replayed over all words at once, lowest rank first; a merge touches the pairs
of its two neighbours alone and enters those into the index.  The slice is a block of the
documents of one task: a dictionary of the whole corpus would need a shuffle of every
word occurrence, and pieces are independent, so the ids are the same.

Contract: null text counts as empty; an empty text has no ids.  Rows that repeat give
rows that repeat, in any order.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import blocks, file_system, ragged
from llm.pretokens import BlockEncoder


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    fs, name = file_system(path)
    with fs.open_input_stream(name) as source:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.read().splitlines()) if token}


def replay_merges(words: list[bytes], ranks: dict[bytes, int], vocabulary: dict[int, bytes]) -> list[list[int]]:
    """Ids of each word after all merges, applied over all words in rank order.

    Of equal pairs in a word the leftmost merges first.  Should a merge make a pair of
    lower rank, that one is applied before the rest of its own rank.
    """
    tokens: list[int] = []
    after: list[int] = []
    before: list[int] = []
    spans = []
    single = [ranks[bytes([b])] for b in range(256)]
    for word in words:
        first = len(tokens)
        tokens += map(single.__getitem__, word)
        last = len(tokens)
        before += range(first - 1, last - 1)
        after += range(first + 1, last + 1)
        if last > first:
            before[first], after[last - 1] = -1, -1
        spans.append((first, last))
    of_pair: dict[tuple[int, int], int | None] = {}

    def rank_of(left: int, right: int) -> int | None:
        try:
            return of_pair[left, right]
        except KeyError:
            rank = of_pair[left, right] = ranks.get(vocabulary[left] + vocabulary[right])
            return rank

    index: dict[int, list[int]] = {}
    for place, following in enumerate(after):
        if following >= 0 and (rank := rank_of(tokens[place], tokens[following])) is not None:
            index.setdefault(rank, []).append(place)
    heap = list(index)
    heapify(heap)

    def enter(rank: int, place: int) -> None:
        if (places := index.get(rank)) is None:
            index[rank] = [place]
            heappush(heap, rank)
        else:
            places.append(place)

    while heap:
        rank = heappop(heap)
        places = index.pop(rank)
        places.sort()
        for done, place in enumerate(places, 1):
            following = after[place]
            if tokens[place] < 0 or following < 0 or rank_of(tokens[place], tokens[following]) != rank:
                continue  # one of the two was merged meanwhile
            tokens[place], tokens[following] = rank, -1
            after[place] = right = after[following]
            lowest = rank
            if right >= 0:
                before[right] = place
                if (made := rank_of(rank, tokens[right])) is not None:
                    enter(made, place)
                    lowest = min(lowest, made)
            if (left := before[place]) >= 0 and (made := rank_of(tokens[left], rank)) is not None:
                enter(made, left)
                lowest = min(lowest, made)
            if lowest < rank and done < len(places):
                index[rank] = places[done:]
                heappush(heap, rank)
                break
    return [[token for token in tokens[first:last] if token >= 0] for first, last in spans]


@lru_cache(2)
def rank_encoder(path: str) -> tuple[BlockEncoder, np.ndarray, np.ndarray, np.ndarray]:
    """The encoder of a rank file, and its tokens as bytes with starts and lengths by id."""
    ranks = load_ranks(path)
    vocabulary = {rank: token for token, rank in ranks.items()}

    def encode_pieces(pieces: list[str]) -> list[list[int]]:
        words = [piece.encode() for piece in pieces]
        out: list = [[ranks[word]] if word in ranks else None for word in words]
        open_ = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(open_, replay_merges([words[i] for i in open_], ranks, vocabulary), strict=True):
            out[i] = ids
        return out

    lengths = np.zeros(max(vocabulary) + 1, np.int64)
    for rank, token in vocabulary.items():
        lengths[rank] = len(token)
    flat = np.frombuffer(b"".join(vocabulary.get(rank, b"") for rank in range(len(lengths))), np.uint8)
    return BlockEncoder(encode_pieces), flat, np.cumsum(lengths) - lengths, lengths


def _decoded(ids: np.ndarray, path: str) -> bytes:
    _, flat, starts, lengths = rank_encoder(path)
    return ragged(flat, starts[ids], lengths[ids]).tobytes()


def encode(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """``id_column``, ``ids`` (array of int) and, if asked for, ``decoded``: the bytes that the ids stand for."""

    def run(batches):
        encoder = rank_encoder(ranks)[0]
        for table in blocks(batches, 8 << 20):
            found = [ids for _, ids in encoder.encode(table.column("text").to_pylist())]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32)
            columns = [table.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(pa.array([_decoded(x, ranks) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"][: len(columns)])

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``decoded``: the bytes of each row's ids; null ids count as none."""

    def run(batches):
        for batch in batches:
            values = [_decoded(np.asarray(x or [], np.int64), ranks) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], [id_column, "decoded"])

    source = encoded.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{ids_column}`").alias("ids"))
    return source.mapInArrow(run, f"`{id_column}` {source.schema['id'].dataType.simpleString()}, decoded binary")
