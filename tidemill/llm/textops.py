"""Vectorised word and shingle hashing over the bytes of an Arrow string column.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters, after
lower-casing; everything else separates words. A shingle is five words in a row; a text of
one to four words has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = np.where(WORD_BYTE, mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1), np.uint64(0)).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of the texts (null: empty) and n + 1 offsets into them."""
    if pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "")
        kind = np.int64
    else:
        column = pc.fill_null(column.cast(pa.string()), "")
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Hashes of all words of some texts, one after the other."""

    hashes: np.ndarray  # uint64, one for each word
    starts: np.ndarray  # byte at which each word starts in the lower-cased, joined texts
    first: np.ndarray  # index of the first word of each text; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array) -> Words:
    b, offsets = raw_bytes(pc.utf8_lower(column))
    is_word = WORD_BYTE[b]
    before = np.empty_like(is_word)
    if len(b):
        before[0] = False
        before[1:] = is_word[:-1]
        before[offsets[:-1][offsets[:-1] < len(b)]] = False
    starts = np.flatnonzero(is_word & ~before)
    if len(starts):
        terms = _VALUE[b]
        terms *= _powers_of(_P, len(b))
        # a text that starts within the run of its predecessor is a word of its own: reduceat cuts there too
        hashes = np.add.reduceat(terms, starts)
        hashes *= _powers_of(_P_INV, len(b))[starts]
        hashes = mix(hashes)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(hashes, starts, np.searchsorted(starts, offsets))


@dataclass
class Shingles:
    hashes: np.ndarray  # uint64, one for each shingle
    word: np.ndarray  # index of its first word
    first: np.ndarray  # index of the first shingle of each text; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingles(w: Words, size: int = SHINGLE) -> Shingles:
    n, total = w.counts, len(w.hashes)
    q = [np.uint64(pow(_Q, j, 1 << 64)) for j in range(size)]
    joined = w.hashes.copy()
    for j in range(1, size):
        joined[: max(0, total - j)] += w.hashes[j:] * q[j]
    per_text = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per_text)])
    text = np.repeat(np.arange(len(n)), per_text)
    at = np.arange(first[-1]) - first[:-1][text] + w.first[:-1][text]
    out = joined[at]
    short = np.flatnonzero((n > 0) & (n < size))
    for t in short:  # texts of fewer words than a shingle
        own = w.hashes[w.first[t] : w.first[t + 1]]
        out[first[t]] = np.add.reduce(own * np.array(q[: len(own)], np.uint64)) + np.uint64(len(own))
    return Shingles(mix(out), at, first)


def text_keys(w: Words) -> np.ndarray:
    """128-bit keys (n x 2 uint64) of the word sequences; equal for texts with equal words in equal order."""
    n = w.counts
    out = np.zeros((len(n), 2), np.uint64)
    has = np.flatnonzero(n > 0)
    if not len(has):
        return out
    at = np.arange(len(w.hashes), dtype=np.int64) - np.repeat(w.first[:-1], n)
    for k, seed in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        value = mix(w.hashes ^ np.uint64(seed)) * _powers_of(seed, int(n.max()))[at]
        out[has, k] = mix(np.add.reduceat(value, w.first[:-1][has]) + n[has].astype(np.uint64))
    return out


def occurrences(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each shingle, how often the same one stands before it in its text (0 for the first)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    key = mix(hashes + (text.astype(np.uint64) << np.uint64(40)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.flatnonzero(new)
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    out = np.empty(len(key), np.int64)
    out[order] = rank
    return out
