"""Byte-level BPE over blocks of texts: pieces are found and counted with numpy, each distinct piece is encoded once.

The split is that of the public pattern ``public_tokenizers.PATTERN``.  It only looks at
the class of a character and of its neighbours, so its cuts are computed for a whole
block of texts at once.  A piece is known by a 64-bit hash of its characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from llm.common import ragged

LETTER, NUMBER, OTHER, SPACE, END = range(5)

#: The Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Separator of texts within a block; no text can hold it.
STOP = 0x110000
#: Characters of one block.  Longer texts are cut where the pattern always cuts.
BLOCK = 1 << 20
#: Distinct pieces kept between blocks: 32 bytes and the ids of each.
MEMORY = 1_000_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, STOP included."""
    import regex

    kinds = np.full(STOP + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, STOP)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            first, last = ord(every[found.start()]), ord(every[found.end() - 1])
            run = np.arange(first, last + 1)
            kinds[run[(run < 0xD800) | (run >= 0xE000)]] = kind
    kinds[WHITE_SPACE] = SPACE
    kinds[STOP] = END
    return kinds


#: An odd factor and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(factor: int, size: int) -> np.ndarray:
    """1, factor, factor**2, ... modulo 2**64."""
    out = np.full(size, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


@lru_cache(1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(FACTOR, 2 * BLOCK), powers(INVERSE, 2 * BLOCK)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values lie far apart."""
    with np.errstate(over="ignore"):
        values = values.astype(np.uint64, copy=True)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
    return values


def cuts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points whose texts each end with STOP; the STOPs are marked too."""
    kinds = classes()[points]
    size = len(points)
    before = np.empty(size, np.uint8)
    before[0], before[1:] = END, kinds[:-1]
    after = np.empty(size, np.uint8)
    after[-1], after[:-1] = END, kinds[1:]
    starts = kinds != before
    word = kinds < SPACE
    joined = np.zeros(size, bool)
    joined[1:] = points[:-1] == 32
    starts &= ~(word & joined)
    # the last blank before other characters stands alone, or begins their piece
    starts |= (kinds == SPACE) & (after < SPACE)
    marks = np.flatnonzero((points == 39) & starts & (after == LETTER))
    if len(marks):
        padded = np.concatenate((points, np.full(3, STOP, points.dtype)))
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(marks), bool)
        for x in ("re", "ve", "ll"):
            long |= (one == ord(x[0])) & (two == ord(x[1]))
        for found, step in ((marks[short], 2), (marks[long & ~short], 3)):
            starts[found + 1] = False
            starts[found + step] = True
    return starts


def hashed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each slice; ``values`` are the random values of the units, those of code points if not given."""
    values = mixed_points() if values is None else values
    size = len(points) + 1
    power, inverse = _block_powers() if size <= 2 * BLOCK else (powers(FACTOR, size), powers(INVERSE, size))
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[points] * power[: len(points)], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@lru_cache(1)
def mixed_points() -> np.ndarray:
    return mixed(np.arange(1, STOP + 2, dtype=np.uint64))


class BlockEncoder:
    """Encodes texts through a cache of distinct pieces.

    ``encode_pieces`` gets a list of new pieces (str) and returns their ids, one list each.
    Memory is bounded by a block and ``MEMORY`` pieces; the cache is emptied beyond that.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list], block: int = BLOCK, memory: int = MEMORY):
        self.encode_pieces, self.block, self.memory = encode_pieces, block, memory
        self._empty()

    def _empty(self) -> None:
        # hashes of the pieces in ascending order, and the number of each
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)

    def encode(self, texts: list[str | None]):
        """Yields ``(index, ids)`` for each text in order, ids as uint32."""
        waiting, size = [], 0
        for index, text in enumerate(texts):
            text = text or ""
            if len(text) > self.block:
                yield from self._block(waiting)
                waiting, size = [], 0
                parts = [ids for part in self._parts(text) for _, ids in self._block([(index, part)])]
                yield index, np.concatenate(parts)
                continue
            if size + len(text) > self.block:
                yield from self._block(waiting)
                waiting, size = [], 0
            waiting.append((index, text))
            size += len(text)
        yield from self._block(waiting)

    def _parts(self, text: str):
        """Slices of a long text; a blank between two letters always begins a piece."""
        start = 0
        while start < len(text):
            end = start + self.block
            while end < len(text):
                end = text.find(" ", end)
                if end < 0:
                    end = len(text)
                elif text[end - 1].isalpha() and end + 1 < len(text) and text[end + 1].isalpha():
                    break
                else:
                    end += 1
            yield text[start:end]
            start = end

    def _block(self, rows: list[tuple[int, str]]):
        if not rows:
            return
        joined = "".join(text for _, text in rows)
        sizes = np.array([len(text) for _, text in rows], np.int64)
        points = np.full(len(joined) + len(rows), STOP, np.uint32)
        stops = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(points), bool)
        inside[stops] = False
        points[inside] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        marks = np.flatnonzero(cuts(points))
        begins = marks[inside[marks]]
        ends = np.append(marks[1:], len(points))[inside[marks]]
        keys, where, inverse = np.unique(hashed(points, begins, ends), return_index=True, return_inverse=True)
        slots = self._slots(keys, points, begins[where], ends[where])
        slot = slots[inverse]
        ids = ragged(self.flat, self.starts[slot], self.lengths[slot])
        total = np.concatenate(([0], np.cumsum(self.lengths[slot])))
        bounds = total[np.concatenate(([0], np.searchsorted(begins, stops)))]
        for (index, _), start, end in zip(rows, bounds[:-1], bounds[1:], strict=True):
            yield index, ids[start:end]

    def _slots(self, keys, points, begins, ends) -> np.ndarray:
        """Numbers of the pieces in the cache; new ones are encoded."""
        if len(self.known) + len(keys) > max(self.memory, len(keys)):
            self._empty()
        place = np.searchsorted(self.known, keys)
        there = np.zeros(len(keys), bool)
        inside = place < len(self.known)
        there[inside] = self.known[place[inside]] == keys[inside]
        found = np.empty(len(keys), np.int64)
        found[there] = self.number[place[there]]
        where = np.flatnonzero(~there)
        if len(where):
            begins, ends = begins[where], ends[where]
            text = ragged(points, begins, ends - begins).tobytes().decode("utf-32-le")
            limits = np.concatenate(([0], np.cumsum(ends - begins))).tolist()
            encoded = self.encode_pieces([text[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)])
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            total = int(lengths.sum())
            first = len(self.known)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            while first + len(where) > len(self.starts):
                self.starts = np.concatenate((self.starts, np.empty_like(self.starts)))
                self.lengths = np.concatenate((self.lengths, np.empty_like(self.lengths)))
            self.flat[self.used : self.used + total] = np.fromiter((x for ids in encoded for x in ids), np.uint32, total)
            self.starts[first : first + len(where)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(where)] = lengths
            self.used += total
            found[where] = first + np.arange(len(where))
            self.known, self.number = np.insert(self.known, place[where], keys[where]), np.insert(self.number, place[where], found[where])
        return found


@lru_cache(4)
def library_encoder(path: str) -> BlockEncoder:
    """Ids of the tokenizers library for a byte-level BPE file, special tokens' strings being ordinary text.

    One per Python worker, so that the cache outlives a task.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode_pieces(pieces: list[str]) -> list:
        return [x.ids for i in range(0, len(pieces), 20_000) for x in tokenizer.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False)]

    return BlockEncoder(encode_pieces)


def default_tokenizer(name: str) -> str:
    """The file of a public tokenizer that is installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
