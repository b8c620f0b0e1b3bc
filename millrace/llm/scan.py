"""Words of many texts at once, as positions and 64-bit hashes in arrays: no Python object per word.

Texts lie one after another in an Arrow buffer. A prefix sum of (byte value x power of an odd base, modulo 2^64) gives the
hash of any span from two of its places, brought to a common origin by the inverse power.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Word characters of the rules: everything but blank and the five controls from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[ord("A") : ord("Z") + 1] = LETTERS[0x80:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection of 64-bit values in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit value for each byte, and with ASCII capitals taken as small letters.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
BYTE_VALUE_FOLDED = BYTE_VALUE.copy()
BYTE_VALUE_FOLDED[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]

_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse; kept at the longest length asked for."""
    have = _powers[inverse]
    base = BASE_INVERSE if inverse else BASE
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[inverse] = have
    return have[:n]


@dataclass
class Words:
    """Words of a slice of texts: byte positions in `data`, the row, a hash; first[i]:first[i+1] are the words of row i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (null: none) and the offsets of the rows in them."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, is_word: np.ndarray = NOT_SPACE, fold: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that are not empty
    begins[edges] = inside[edges]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    value = (BYTE_VALUE_FOLDED if fold else BYTE_VALUE)[data]
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * powers(len(data)), out=prefix[1:])
    hashes = mixed((prefix[end] - prefix[start]) * powers(len(data) + 1, inverse=True)[start])
    return Words(data, offsets, start, end, row, first, hashes)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (number of the first word) of each window of `size` words that lies within one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = words.hash[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(BASE) + words.hash[k : k + n]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mixed(out[at]), at
