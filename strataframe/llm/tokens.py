"""Vectorised word splitting and n-gram hashing for one Arrow batch.

Spark partitions the documents; these helpers turn the string column of one
batch into flat numpy arrays (one entry per word), so no Python loop runs per
word.  All splitting is on ASCII separators, hence valid on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text bytes handled at once; a longer document is a chunk of its own

#: Two families of hashes; both together name a string with 125 bits. The first is a polynomial modulo the prime 2**61 - 1, the second one
#: modulo 2**64: strings that repeat themselves with letters exchanged at all dyadic scales fool any base of the second, so it never decides alone.
FAMILIES = (0, 1)
_PRIME = np.uint64(2**61 - 1)
_PRIME_BASE = 0x1B873593CC9E2D51
_LOW = np.uint64(2**31 - 1)
_FOLD = 1 << 24  # bytes that the sums of the first family hold without a carry out of 64 bits
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xC2B2AE3D27D4EB4B)
_NGRAM = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]

_codes = np.arange(256)
#: Bytes of a word: everything but space and \t\n\v\f\r.
SPACE_RULE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
#: Bytes of a word: digits, lower-case a-z and non-ASCII (after lower-casing A-Z).
ALNUM_RULE = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)

_powers: dict[int, tuple[np.ndarray, ...]] = {}


def _reduced(v: np.ndarray) -> np.ndarray:
    """Modulo the prime, from any 64 bits."""
    v = (v & _PRIME) + (v >> np.uint64(61))
    return np.where(v >= _PRIME, v - _PRIME, v)


def _times_2_31(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(30)) + ((v & np.uint64(2**30 - 1)) << np.uint64(31))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    shift = np.uint64(31)
    a1, a0, b1, b0 = a >> shift, a & _LOW, b >> shift, b & _LOW
    middle = _times_2_31(_reduced(a1 * b0 + a0 * b1))
    return _reduced(_reduced(np.uint64(2) * a1 * b1 + middle) + _reduced(a0 * b0))


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = times(out[:m], np.full(m, pow(base, k, int(_PRIME)), np.uint64))
        k *= 2
    return out


def powers(n: int, family: int = 0) -> tuple[np.ndarray, ...]:
    """The family's powers 0..n: low and high half of the base's (the base's alone in the second family), and the inverse's."""
    if family not in _powers or len(_powers[family][0]) <= n:
        size = max(n, CHUNK_BYTES + 1024) + 1
        if family == 0:
            up, down = _prime_powers(_PRIME_BASE, size), _prime_powers(pow(_PRIME_BASE, -1, int(_PRIME)), size)
            _powers[0] = (up & _LOW, up >> np.uint64(31), down)
        else:
            pair = []
            for base in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _powers[1] = tuple(pair)
    return _powers[family]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (one more than rows) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes of text."""
    data, off = text_buffers(texts)
    n, at = len(off) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


@dataclass
class Words:
    """Words of some rows: byte spans, 64-bit hashes, and ``first[r]:first[r + 1]`` as the words of row r."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def split_words(data: np.ndarray, off: np.ndarray, rule: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    """All maximal runs of ``rule`` bytes inside rows, in order."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = rule[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = off[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off)
    h = span_hashes(data, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(data, start, end, first, h)


def word_strings(w: Words) -> pa.Array:
    """The words as an Arrow array of bytes."""
    size = np.append(0, np.cumsum(w.end - w.start))
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    raw = w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def word_codes(w: Words) -> np.ndarray:
    """A number for every word, equal for equal words and for no others."""
    return word_strings(w).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def prefix_sums(data: np.ndarray, family: int = 0) -> tuple[np.ndarray, ...]:
    """Running sums of the bytes times the family's powers, from which spans have their hashes."""
    out, n = [], len(data)
    values = _BYTE[data] if family else data.astype(np.uint64)
    for up in powers(n, family)[:-1]:
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=s[1:])
        out.append(s)
    return tuple(out)


def _between(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over spans of at most ``_FOLD`` bytes modulo the prime."""
    low, high = (s[end] - s[start] for s in sums)
    return _reduced(_reduced(low) + _times_2_31(_reduced(high)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: tuple[np.ndarray, ...] | None = None, family: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes."""
    sums = prefix_sums(data, family) if sums is None else sums
    down, size = powers(len(data), family)[-1][start], (end - start).astype(np.uint64)
    if family:
        return mix((sums[0][end] - sums[0][start]) * down + size)
    total = _between(sums, start, np.minimum(end, start + _FOLD))
    for k in np.flatnonzero(size > _FOLD):  # what is longer is added up in parts
        parts = np.arange(start[k], end[k], _FOLD)
        total[k] = sum(_between(sums, parts, np.minimum(parts + _FOLD, end[k])).tolist()) % int(_PRIME)
    return mix(times(total, down) + size * _NGRAM[0])


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words inside one row."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = w.hashes[:m].copy()
    for j in range(1, n):
        h *= _NGRAM[0]
        h += w.hashes[j : j + m]
    ok = np.ones(m, bool)
    # a run may not cross into the next row: drop the last n - 1 starts of every row
    ends = w.first[1:]
    for j in range(1, n):
        bad = ends - j
        bad = bad[(bad >= 0) & (bad < m)]
        ok[bad] = False
    at = np.flatnonzero(ok)
    return at, mix(h[at] + np.uint64(n))


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hashes of the runs of n words that start at the given words, from the words' hashes of the family."""
    h = hashes[at]
    for j in range(1, n):
        h = h * _NGRAM[family] + hashes[at + j]
    return mix(h + np.uint64(n))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sort: faster here than np.unique's hash table)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of 0..n-1 lie in any of the half-open spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.subtract.at(step, end, 1)
    return np.cumsum(step[:-1]) > 0
