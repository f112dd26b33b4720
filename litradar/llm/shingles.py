"""Word shingles of whole texts as sets of 64-bit hashes, computed on the bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SIZE = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit integers that depend on ``seed`` alone."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(np.array([seed + 1], dtype=np.uint64)))


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTE = seeded(11, 256)[_LOWERED]  # upper and lower case have one value
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
# all ASCII characters but letters and digits
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = True
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACE = seeded(12, SIZE) | np.uint64(1)


def word_hashes(texts: Sequence[bytes], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of other than separator bytes, A-Z lower-cased), and the number of words before each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = separators[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)))
    bounds = np.searchsorted(starts, firsts)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    # Horner's sums for all words at once: the letters of place i of every word that is longer than i
    size = ends - starts
    hashes = np.zeros(len(starts), dtype=np.uint64)
    todo = np.arange(len(starts))
    for i in range(int(size.max())):
        if i == 64:
            break
        todo = todo[size[todo] > i]
        hashes[todo] = hashes[todo] * _BASE + _BYTE[data[starts[todo] + i]]
    for k in np.flatnonzero(size > 64):  # rare: one long word after the other, by the powers of the base
        powers = np.full(size[k] - 63, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)[::-1]
        hashes[k : k + 1] *= powers[:1]
        hashes[k : k + 1] += (_BYTE[data[starts[k] + 64 : ends[k]]] * powers[1:]).sum(dtype=np.uint64, keepdims=True)
    return mix64(hashes), bounds


def shingle_sets(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has one shingle, one without words none."""
    words, bounds = word_hashes(texts)
    n = max(len(words) - SIZE + 1, 0)
    shingles = np.zeros(n, dtype=np.uint64)
    for k in range(SIZE):
        shingles += words[k : k + n] * _PLACE[k]
    shingles = mix64(shingles)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SIZE:
            out.append(np.unique(shingles[a : b - SIZE + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
