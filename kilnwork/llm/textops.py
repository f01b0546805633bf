"""Word boundaries, word hashes and shingles of Arrow text columns, in numpy over the UTF-8 bytes of many texts at once.

All hashes are 64 bits wide and depend on the bytes of the word alone, so that they agree between tasks and tables.
Words of up to LONG bytes have polynomial hashes modulo 2**64; those can be equal for different long words of a regular
make, so longer words have BLAKE2 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
#: Bytes of the longest word with a polynomial hash.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
#: A value for each byte, the same for both cases of A-Z.
VALUES = mix(np.arange(1, 257, dtype=U))[LOWER] | U(1)


def class_table(delimiters: str) -> np.ndarray:
    """True for the bytes of words: all but the given ASCII characters; bytes of other characters always belong to words."""
    t = np.ones(256, dtype=bool)
    t[[ord(c) for c in delimiters]] = False
    return t


#: Words between white space.
SPACED = class_table(" \t\n\v\f\r")
#: Words of ASCII letters, digits and any other character outside ASCII.
ALNUM = class_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))

_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i below n; kept and doubled as needed."""
    if _powers["n"] < n:
        size = max(n, 2 * _powers["n"], CHUNK + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, U(base), dtype=U)
            t[0] = U(1)
            _powers[key] = np.multiply.accumulate(t)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of some texts: word i spans bytes start[i] to end[i] of data; text t has words first[t] to first[t + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield at, to
        at = to


def words(column: pa.Array, table: np.ndarray = SPACED) -> Words:
    """The words of each text, with hashes that take A-Z as a-z."""
    data, offsets = buffers(column)
    inside = table[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offsets))
        head, tail = offsets[full], offsets[full + 1] - 1
        starts[head] = inside[head]
        ends[tail] = inside[tail]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(VALUES[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(LOWER[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashes)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of k words, sorted within the text, and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    counts = w.counts
    kept = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(kept)])
    n = len(w.hash)
    weight = mix(np.arange(11, 11 + k, dtype=U)) | U(1)
    run = np.zeros(n, dtype=U)
    left = np.repeat(w.first[1:], counts) - np.arange(n)
    for j in range(k):
        here = w.hash[j:] * weight[j]
        run[: n - j] += np.where(left[: n - j] > j, here, U(0))
    size = np.minimum(left, k)
    run = mix(run + size.astype(U))
    keep = (left >= k) | ((np.repeat(counts, counts) < k) & (np.arange(n) == np.repeat(w.first[:-1], counts)))
    return distinct(run[keep], first)


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each segment, and the segments' new beginnings."""
    out = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (segment[1:] != segment[:-1])
    sizes = np.bincount(segment[new], minlength=len(first) - 1)
    return out[new], np.concatenate([[0], np.cumsum(sizes)])
