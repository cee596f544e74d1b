"""Hashes of the words and shingles of a text, computed over whole arrays.

Words are maximal runs without ASCII white space. A word's hash is a polynomial over its
bytes modulo 2**64, mixed; it is the same in every process.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit changes every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base & _U64, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWER = _powers(_BASE, CHUNK)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def _chunk_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = (_POWER, _INVERSE) if n <= CHUNK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    edges = np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | bytes) -> np.ndarray:
    """Hashes of the words of a text with A-Z lower-cased, in order."""
    raw = (text.encode() if isinstance(text, str) else text).lower()
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= CHUNK:
        return _chunk_hashes(data) if len(data) else np.zeros(0, np.uint64)
    parts, begin = [], 0
    while begin < len(data):
        end = begin + CHUNK
        while end < len(data) and not (blanks := np.flatnonzero(SPACE[data[end : end + CHUNK]])).size:
            end += CHUNK
        end = len(data) if end >= len(data) else end + int(blanks[0])
        parts.append(_chunk_hashes(data[begin:end]))
        begin = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of ``size`` consecutive words; of all words if they are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total) + words[k : n - width + 1 + k] * np.uint64(2 * k + 3)
    return np.unique(mix(total))


def word_hashes_of_all(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts (lower-cased bytes) one after another, and each text's number of words."""
    hashes, counts, begin = [np.zeros(0, np.uint64)], np.zeros(len(raws), np.int64), 0
    while begin < len(raws):
        end, size = begin, 0
        while end < len(raws) and (end == begin or size + len(raws[end]) + 1 <= CHUNK):
            size += len(raws[end]) + 1
            end += 1
        if end == begin + 1:
            one = word_hashes(raws[begin])
            hashes.append(one)
            counts[begin] = len(one)
        else:
            data = np.frombuffer(b" ".join(raws[begin:end]), np.uint8)
            hashes.append(_chunk_hashes(data))
            # a word belongs to the text in which it starts
            starts = np.flatnonzero(~SPACE[data] & np.concatenate(([True], SPACE[data[:-1]]))) if len(data) else np.zeros(0, np.int64)
            edges = np.cumsum([0, *(len(raw) + 1 for raw in raws[begin:end])])
            counts[begin:end] = np.diff(np.searchsorted(starts, edges))
        begin = end
    return np.concatenate(hashes), counts
