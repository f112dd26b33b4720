"""Periodic runs of words: stretches that repeat a period three times or more, found by splitting at rare words.

A word of a run with at least ``TIMES`` periods occurs ``TIMES`` times within the run. So a word that occurs less often in
its segment is in no run of the segment and splits it; the parts are judged again by their own counts, until no part
changes or a part is too short for a run. What survives is scanned by lags:

* Periods below ``GRAM`` are compared at each lag.
* Longer ones go by classes of ``width`` to twice that. A run of such a period covers a multiple of ``width`` whose next
  ``GRAM`` words stand once more one period later, and each place is a period's length after one multiple only. So a class
  costs one comparison a place, whatever the number of lags. Where the words agree, the stretch is extended to both sides by
  binary search over prefix hashes. What lies inside a run of a smaller period is passed over.

Hashes only propose: each run is confirmed word by word. Words are numbered by their bytes, not by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix64

# a run has so many words and so many periods at least
LEAST, TIMES = 24, 3
GRAM = LEAST // TIMES
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
# bytes of texts that are worked on at once; a longer text is worked on alone
PIECE = 1 << 23


def numbered_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` of the words in ``data``, a number for each that equal words share, and the words before each of ``firsts``."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return starts, ends, codes, np.searchsorted(starts, firsts)


def split_by_rarity(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """First place and end of the stretches, within one owner, in which every word occurs ``TIMES`` times or more."""
    at, segment, stable = np.arange(len(codes)), owner, []
    while len(at):
        pair = segment * (int(codes.max()) + 1) + codes[at]
        _, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        stays = n[which] >= TIMES
        if not stays.any():
            break
        kept, old = at[stays], segment[stays]
        first = np.flatnonzero(np.concatenate(([True], (kept[1:] != kept[:-1] + 1) | (old[1:] != old[:-1]))))
        length = np.diff(np.append(first, len(kept)))
        # a segment that lost no word is stable; the parts of the others are judged again
        lost = np.bincount(segment, weights=~stays, minlength=int(segment.max()) + 1) > 0
        changed = lost[old[first]]
        enough = length >= LEAST
        stable += [(int(kept[a]), int(kept[a]) + int(m)) for a, m in zip(first[enough & ~changed], length[enough & ~changed], strict=True)]
        again = np.repeat(enough & changed, length)
        at, segment = kept[again], np.repeat(np.arange(len(first)), length)[again]
    return sorted(stable)


def _stretches(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs at one lag by comparing every word."""
    same = np.concatenate(([False], words[period:] == words[:-period], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, end = edge[0::2], edge[1::2] + period
    enough = end - start >= max(LEAST, TIMES * period)
    return start[enough], end[enough]


def _has_period(words: np.ndarray, start: int, end: int, period: int) -> bool:
    return np.array_equal(words[start : end - period], words[start + period : end])


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


class _Lags:
    """Prefix hashes of a segment: do two stretches a lag apart agree, and how far."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        power = np.full(self.n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * self.power[:-1], dtype=np.uint64, out=self.sums[1:])

    def agree(self, begin: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.power[lag] == self.sums[end + lag] - self.sums[begin + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, forward: bool) -> np.ndarray:
        """Number of words from ``at`` on (or before it) that stand again ``lag`` words later."""
        m, most = np.zeros_like(at), self.n - at - lag if forward else at
        step = 1 << self.n.bit_length()
        while step:
            longer = m + step
            open_ = np.flatnonzero(longer <= most)
            a, t = at[open_], longer[open_]
            fits = self.agree(a, a + t, lag[open_]) if forward else self.agree(a - t, a, lag[open_])
            m[open_[fits]] = t[fits]
            step >>= 1
        return m


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs in a segment, by start and period."""
    n, found = len(words), []
    # runs of smaller classes: starts in order, and the farthest end so far
    starts, ends = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(start: list[int], end: list[int], period: list[int]) -> None:
        nonlocal starts, ends
        for s, e, q in zip(start, end, period, strict=True):
            if not any(_has_period(words, s, e, q // r) for r in _prime_factors(q)):
                found.append((s, e - s, q))
        runs = np.array([(s, s + m) for s, m, _ in sorted(found)], dtype=np.int64).reshape(-1, 2)
        starts, ends = runs[:, 0], np.maximum.accumulate(runs[:, 1]) if len(runs) else runs[:, 1]

    def within(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Does a run found so far hold all of the stretch."""
        if not len(starts):
            return np.zeros(len(begin), dtype=bool)
        place = np.searchsorted(starts, begin, side="right") - 1
        return (place >= 0) & (ends[place] >= end)

    for q in range(1, min(GRAM, n // TIMES + 1)):
        start, end = _stretches(words, q)
        add(start.tolist(), end.tolist(), [q] * len(start))
    lags, width = _Lags(words) if n >= TIMES * GRAM else None, GRAM
    while TIMES * width <= n:
        later = np.arange(width, n - GRAM + 1)
        lag = width + later % width
        at = later - lag
        same = lags.agree(at, at + GRAM, lag)
        at, lag = at[same], lag[same]
        passed = within(at, at + 2 * lag)
        at, lag = at[~passed], lag[~passed]
        start = at - lags.reach(at, lag, False)
        end = at + lag + lags.reach(at, lag, True)
        enough = (end - start >= np.maximum(LEAST, TIMES * lag)) & ~within(start, end)
        runs = set(zip(start[enough].tolist(), end[enough].tolist(), lag[enough].tolist(), strict=True))
        # hashes that agree by chance: all words are compared at that lag
        chance = {q for s, e, q in runs if not _has_period(words, s, e, q)}
        runs = {r for r in runs if r[2] not in chance}
        for q in chance:
            runs |= {(s, e, q) for s, e in zip(*(x.tolist() for x in _stretches(words, q)), strict=True)}
        add(*([list(x) for x in zip(*sorted(runs), strict=True)] if runs else ([], [], [])))
        width *= 2
    return sorted(found)


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, with starts counted from the text's first word; text ``i`` has the words from ``bounds[i]`` on."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for begin, end in split_by_rarity(codes, owner):
        text = int(owner[begin])
        shift = begin - int(bounds[text])
        out[text] += [(s + shift, m, q) for s, m, q in lag_scan(codes[begin:end])]
    return [sorted(r) for r in out]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one blank."""
    parts, size = [], ends - starts + 1
    place = np.concatenate(([0], np.cumsum(size)))
    begin = 0
    while begin < len(starts):
        stop = max(int(np.searchsorted(place, place[begin] + PIECE)), begin + 1)
        stop = min(stop, len(starts))
        at = place[begin:stop] - place[begin]
        text = data[np.repeat(starts[begin:stop] - at, size[begin:stop]) + np.arange(place[stop] - place[begin])]
        text[place[begin + 1 : stop + 1] - place[begin] - 1] = 32
        parts.append(text.tobytes())
        begin = stop
    return b"".join(parts)[:-1]


def _judged(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[int], list[bytes]]:
    """Runs, number of words and text without repeated periods of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    firsts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)))
    starts, ends, codes, bounds = numbered_words(data, firsts)
    runs = runs_of(codes, bounds)
    kept = []
    for own, a, b in zip(runs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s, e = starts[a:b], ends[a:b]
        if own:
            depth = np.zeros(b - a + 1, dtype=np.int64)
            for start, length, period in own:
                depth[start + period] += 1
                depth[start + length] -= 1
            once = np.cumsum(depth)[:-1] == 0
            s, e = s[once], e[once]
        kept.append(_joined(data, s, e))
    return runs, np.diff(bounds).tolist(), kept


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    begin, held, out = 0, 0, []
    for i in range(len(texts)):
        out.append(texts[i].as_py() or b"")
        held += len(out[-1])
        if held >= PIECE or i + 1 == len(texts):
            yield begin, out
            begin, held, out = i + 1, 0, []


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _slices(batch.column(1).cast(pa.large_binary())):
            runs, n_words, kept = _judged(texts)
            flat = [r for own in runs for r in own]
            columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_RUN))
            yield pa.record_batch({"row": batch.column(0).slice(at, len(texts)), "n_words": pa.array(n_words, pa.int64()),
                                   "runs": pa.ListArray.from_arrays(pa.array(offsets), items), "collapsed": pa.array(kept, pa.binary()).cast(pa.string())})


def periodic_runs(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row, ``n_words``, ``runs`` (``start, length, period`` by start and period) and ``collapsed``.

    Words are split at ASCII white space and numbered from 0. A run is a stretch of words with smallest period q (words q
    apart are equal) and at least max(24, 3 q) words that no neighbour extends. ``collapsed`` has the words that no run
    holds after its first q words, joined by one blank. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are judged one by one, so repeated rows give repeated results, a null id is kept, an empty table
    gives no rows, and other columns are ignored whatever their names. One pass without a shuffle; a task holds about
    8 MB of texts at a time, or one longer text.
    """
    rows = documents.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_periodic, schema).select("row.*", "n_words", "runs", "collapsed")
