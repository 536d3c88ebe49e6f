"""Token counts of a unigram vocabulary without token ids: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character.
The dynamic programme keeps, for each character, the best score of a segmentation up to
there and its number of pieces; no path is stored.  Ties follow the tokenizer: of equal
scores the one whose last piece begins first stays.  A character without a piece of its own
costs the least score less 10 and counts as its UTF-8 bytes where the vocabulary has byte
pieces, else runs of such characters count as one.

No piece of the vocabulary holds a word mark after another character (checked when it is
loaded), so segments that begin with marks are independent, and each distinct segment of a
task is solved once.  Scores are summed exactly in double precision; the library sums a
whole text in single precision, so for scores beyond its 24 bits its own choice may differ.

Contract: null text counts as empty and has no pieces.  Rows that repeat give rows that
repeat.  Memory is bounded by a block of texts, one segment and the cache of segments.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import blocks, file_system

#: Distinct segments kept by a Python worker.
MEMORY = 1_000_000
#: The word mark, and what an unknown character costs besides the least score.
MARK, PENALTY = "▁", 10.0
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class CountViterbi:
    """Best score and number of pieces of normalised text."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece in pieces if len(piece) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.byte_pieces = byte_pieces
        self.independent = not any(MARK in piece.lstrip(MARK) for piece in pieces)
        self.known: dict[str, tuple[float, int, bool, bool]] = {}

    def solve(self, segment: str) -> tuple[float, int, bool, bool]:
        """Score, pieces, and whether the first and the last piece are unknown runs."""
        size = len(segment)
        scores = [0.0] * (size + 1)
        starts = [-1] * (size + 1)
        counts = [0] * (size + 1)
        opens = [False] * (size + 1)  # the last piece is unknown
        heads = [False] * (size + 1)  # the first piece is unknown
        done = 0

        def unknown_ends(until: int) -> None:
            """A character that no single piece covers may stand alone; later starts lose ties."""
            nonlocal done
            while done < until:
                done += 1
                character = segment[done - 1]
                if character in self.single:
                    continue
                score = scores[done - 1] + self.unknown
                if starts[done] < 0 or score > scores[done]:
                    scores[done], starts[done], opens[done] = score, done - 1, True
                    heads[done] = heads[done - 1] if done > 1 else True
                    more = len(character.encode()) if self.byte_pieces else (0 if opens[done - 1] else 1)
                    counts[done] = counts[done - 1] + more

        for last, (length, value) in self.automaton.iter(segment):
            unknown_ends(last)
            end, start = last + 1, last + 1 - length
            score = scores[start] + value
            if starts[end] < 0 or score > scores[end] or (score == scores[end] and start < starts[end]):
                scores[end], starts[end], opens[end], counts[end] = score, start, False, counts[start] + 1
                heads[end] = heads[start] if start else False
        unknown_ends(size)
        return scores[size], counts[size], heads[size], opens[size]

    def count(self, text: str) -> tuple[float, int]:
        """Score and pieces of a whole normalised text."""
        total, pieces, open_ = 0.0, 0, False
        known = self.known
        for segment in SEGMENT.findall(text) if self.independent else [text] * bool(text):
            found = known.get(segment)
            if found is None:
                if len(known) >= MEMORY:
                    known.clear()
                found = known[segment] = self.solve(segment)
            score, count, head, tail = found
            total += score
            pieces += count - (open_ and head and not self.byte_pieces)
            open_ = tail
        return total, pieces


@lru_cache(2)
def load_model(path: str):
    """The counter of a sentencepiece file and the normaliser of that file."""
    from sentencepiece import SentencePieceProcessor

    fs, name = file_system(path)
    with fs.open_input_stream(name) as source:
        model = SentencePieceProcessor(model_proto=source.read())
    ids = range(len(model))
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
    return CountViterbi(pieces, any(model.is_byte(i) for i in ids)), model.normalize


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_tokens, score`` of each text."""

    def run(batches):
        counter, normalize = load_model(model)
        for table in blocks(batches, 8 << 20):
            found = [counter.count(normalize(text)) if text else (0.0, 0) for text in table.column("text").to_pylist()]
            columns = [pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], [id_column, "n_tokens", "score"])

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_column}` {source.schema['id'].dataType.simpleString()}, n_tokens bigint, score double")
