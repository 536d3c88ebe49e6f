"""Words and word shingles of Arrow texts, with numpy over whole batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from llm.common import SPACES
from llm.pretokens import hashed, mixed


@lru_cache(4)
def _between(separators: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(separators)] = True
    return flags


@lru_cache(1)
def _values() -> tuple[np.ndarray, np.ndarray]:
    """Random values of bytes as they are, and with A-Z lowered."""
    plain = mixed(np.arange(1, 257, dtype=np.uint64))
    lowered = plain.copy()
    lowered[65:91] = plain[97:123]
    return plain, lowered


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (one more entry than texts)."""
    inside = ~_between(separators)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered if asked for."""
    return hashed(data, starts, ends, _values()[int(lower)])


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` words; a shorter text with words gives its whole sequence."""
    counts = np.diff(firsts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    texts = np.repeat(np.arange(len(counts)), made)
    within = np.arange(len(texts)) - np.repeat(np.cumsum(made) - made, made)
    place = firsts[:-1][texts] + within
    length = np.minimum(counts, size)[texts]
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64)
        for j in range(size):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.where(j < length, padded[place + j], np.uint64(0)))
    return texts, total


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, and the bounds of the texts."""
    starts, ends, firsts = word_spans(data, offsets)
    texts, found = shingles(word_hashes(data, starts, ends), firsts, size)
    order = np.lexsort((found, texts))
    texts, found = texts[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])
    texts, found = texts[new], found[new]
    return found, np.searchsorted(texts, np.arange(len(offsets)))
