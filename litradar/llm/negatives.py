"""Hard negatives by exact integer products in a residue number system.

Components are cut to integers. A matrix product of integers modulo a small prime fits the 24 bits of a float32, so a batch is
multiplied once for each of a few primes in float32, and the exact signed scores follow from the residues by the Chinese
remainder theorem (mixed radix digits, all centred on zero). How many primes are needed follows from the largest norms.

Anchors travel in groups and rows in slices; a piece of work is one group against one slice, whose rows stream by while the
anchors are held. Two passes: the first finds each anchor's best rows of its own label (only equal labels are
multiplied), the second the best rows of other labels inside the score window of each of these positives. A piece leaves
a bounded number of rows an anchor; windows over anchors then rank what the pieces left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
# the window of a negative's score, in per cent of the positive's
LEAST_PERCENT, MOST_PERCENT = 50, 95
# components below 512 / 2 in absolute value, 256 at a time: their products stay below 2**24
MOST_PRIME, COMPONENTS = 512, 256
# beyond this, scores might not fit 64 bits
MOST_SCORE = 2.0**60
ANCHOR_GROUP, SLICE_ROWS, LEAST_SLICE = 16_384, 262_144, 1_024
TILE, BATCH = 512, 4_096


def primes_for(bound: float) -> list[int]:
    """Primes below ``MOST_PRIME``, largest first, whose product exceeds all signed scores up to ``bound``."""
    chosen, product = [], 1
    for p in range(MOST_PRIME - 1, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            chosen.append(p)
            product *= p
    return chosen


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of integers held in float64; the remainder of a division of floats is exact."""
    out = []
    for p in primes:
        r = np.fmod(values, p)
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    return values - p * np.rint(values * np.float32(1 / p))


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact scores of all rows of ``a`` against all rows of ``b``, both given by their residues."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        total = np.zeros((len(a[i]), len(b[i])), dtype=np.float32)
        for at in range(0, a[i].shape[1], COMPONENTS):
            total = _centred(total + _centred(a[i][:, at : at + COMPONENTS] @ b[i][:, at : at + COMPONENTS].T, p), p)
        # what is left after the digits of the earlier primes, divided by these primes
        for digit, q in zip(digits, primes, strict=False):
            total = _centred((total - digit) * np.float32(pow(q, -1, p)), p)
        # rounding in the centring may leave a residue one prime away
        half = np.float32((p - 1) // 2)
        total -= np.float32(p) * (total > half)
        total += np.float32(p) * (total < -half)
        digits.append(total)
    score = np.zeros_like(digits[0], dtype=np.int64)
    for digit, p in zip(reversed(digits), reversed(primes), strict=True):
        score = score * p + digit.astype(np.int64)
    return score


def _usable(scale: int):
    """Whole batches at once: rows without id, label or vector or with a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            offsets = vectors.offsets.to_numpy()
            flat = vectors.values
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            present = [c.is_valid().to_numpy(zero_copy_only=False) for c in (batch.column("vec_id"), batch.column("label"), vectors)]
            good = np.logical_and.reduce(present) & (bad[offsets[1:]] == bad[offsets[:-1]])
            size = np.where(good, np.diff(offsets), 0)
            # minus zero becomes zero, so that equal vectors have equal bytes
            values = np.floor(x[_inside(offsets, good)] * scale) + 0.0
            with np.errstate(over="ignore"):
                squares = np.concatenate(([0.0], np.cumsum(values**2)))
            ends = np.cumsum(size)
            held = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(np.concatenate(([0], 8 * ends[good])).astype(np.int32)), pa.py_buffer(values.astype("<f8"))])
            keep = pa.array(good)
            yield pa.record_batch({"vec_id": batch.column("vec_id").filter(keep), "label": batch.column("label").filter(keep), "v": held,
                                   "square": pa.array(_row_sums(values, size[good], squares))})

    return run


def _inside(offsets: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Places of the components of the good rows."""
    size = np.diff(offsets)[good]
    begin = offsets[:-1][good]
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _row_sums(values: np.ndarray, size: np.ndarray, squares: np.ndarray) -> np.ndarray:
    if not np.isfinite(squares[-1]) or squares[-1] > 2.0**53:
        # a running sum would swallow small rows beside large ones
        ends = np.cumsum(size)
        return np.array([float((values[e - s : e] ** 2).sum()) for s, e in zip(size, ends, strict=True)], dtype=np.float64)
    ends = np.cumsum(size)
    return squares[ends] - squares[ends - size]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers in float64; shorter vectors are filled with zeros."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    flat = np.frombuffer(column.buffers()[2], dtype="<f8")[offsets[0] // 8 : offsets[-1] // 8] if len(column) and offsets[-1] > offsets[0] else np.zeros(0)
    size = np.diff(offsets) // 8
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Best:
    """The ``k`` best rows of each key so far: higher scores first, then smaller ids."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.least = np.full(keys, np.iinfo(np.int64).min)
        self.rows = [np.zeros(0, dtype=np.int64)] * 3

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        key, ids, score = (np.concatenate(x) for x in zip(self.rows, (key, ids, score), strict=True))
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        first = np.searchsorted(key, key)
        keep = np.arange(len(key)) - first < self.k
        self.rows = [key[keep], ids[keep], score[keep]]
        full = np.arange(len(key)) - first == self.k - 1
        self.least[key[full]] = score[full]

    def offer(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray, allowed: np.ndarray) -> None:
        """A matrix of scores, one row a key; what cannot be among the best is left out before anything is sorted."""
        allowed = allowed & (score >= self.least[key][:, None])
        if score.shape[1] > self.k and allowed.sum() > 4 * self.k * len(key):
            held = np.where(allowed, score, np.iinfo(np.int64).min)
            cut = np.partition(held, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            allowed &= held >= cut[:, None]
        row, column = np.nonzero(allowed)
        if len(row):
            self.add(key[row], ids[column], score[row, column])


def _pieces(width: int, primes: list[int], begin: Callable, rows: Callable, end: Callable):
    """Batches come sorted by piece, the anchors of a piece before its rows. ``begin`` gets the anchors, ``rows`` each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, anchors, state = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("slice", "group", "side")])
            if not len(keys):
                continue
            cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if piece != tuple(keys[a, :2]):
                    if state is not None:
                        yield end(state)
                    piece, anchors, state = tuple(keys[a, :2]), [], None
                part = batch.slice(a, b - a)
                if keys[a, 2] == 0:
                    anchors.append(part)
                elif anchors:
                    if state is None:
                        held = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
                        state = begin(held, residues(_matrix(held.column("v"), width), primes))
                    for at in range(0, len(part), BATCH):
                        own = part.slice(at, BATCH)
                        rows(state, own, residues(_matrix(own.column("v"), width), primes))
        if state is not None:
            yield end(state)

    return run


def _taken(residue: list[np.ndarray], which) -> list[np.ndarray]:
    return [r[which] for r in residue]


def _positives(width: int, primes: list[int], k: int):
    """The best rows of the anchor's own label; labels are multiplied one by one."""

    def begin(anchors, residue):
        return {"anchors": anchors, "ids": anchors.column("id").to_numpy(), "labels": anchors.column("label").to_numpy(), "residue": residue, "best": Best(len(anchors), k)}

    def rows(state, batch, residue):
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        values, first = np.unique(labels[order], return_index=True)
        for label, same in zip(values, np.split(order, first[1:]), strict=True):
            asking = np.flatnonzero(state["labels"] == label)
            for at in range(0, len(asking), TILE):
                tile = asking[at : at + TILE]
                score = products(_taken(state["residue"], tile), _taken(residue, same), primes)
                state["best"].offer(tile, ids[same], score, state["ids"][tile][:, None] != ids[same])

    def end(state):
        key, ids, score = state["best"].rows
        at = pa.array(key)
        return pa.record_batch({"anchor_id": state["anchors"].column("id").take(at), "_a": state["anchors"].column("_a").take(at), "vec_id": pa.array(ids), "score": pa.array(score)})

    return _pieces(width, primes, begin, rows, end)


def _negatives(width: int, primes: list[int], k: int, least_percent: int, most_percent: int):
    """The best rows of other labels inside the window of each positive."""

    def begin(anchors, residue):
        lists = anchors.column("positives")
        count = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        ps = flat.field("score").to_pylist()
        # 100 n >= least * p and 100 n <= most * p in integers
        low, high = np.array([-(-least_percent * p // 100) for p in ps], dtype=np.int64), np.array([most_percent * p // 100 for p in ps], dtype=np.int64)
        owner = np.repeat(np.arange(len(anchors)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return {"anchors": anchors, "ids": anchors.column("id").to_numpy(), "labels": anchors.column("label").to_numpy(), "residue": residue, "flat": flat,
                "owner": owner, "low": low, "high": high, "nth": nth, "best": Best(len(owner), k)}

    def rows(state, batch, residue):
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for at in range(0, len(state["ids"]), TILE):
            tile = np.arange(at, min(at + TILE, len(state["ids"])))
            score = products(_taken(state["residue"], tile), residue, primes)
            other = (state["labels"][tile][:, None] != labels) & (state["ids"][tile][:, None] != ids)
            own = np.flatnonzero((state["owner"] >= at) & (state["owner"] < at + TILE))
            for nth in np.unique(state["nth"][own]):
                key = own[state["nth"][own] == nth]
                spot = state["owner"][key] - at
                mine = score[spot]
                state["best"].offer(key, ids, mine, other[spot] & (mine >= state["low"][key][:, None]) & (mine <= state["high"][key][:, None]))

    def end(state):
        key, ids, score = state["best"].rows
        at, spot = pa.array(state["owner"][key]), pa.array(key)
        return pa.record_batch({"anchor_id": state["anchors"].column("id").take(at), "_a": state["anchors"].column("_a").take(at),
                                "positive_id": state["flat"].field("vec_id").take(spot), "positive_score": state["flat"].field("score").take(spot),
                                "negative_id": pa.array(ids), "negative_score": pa.array(score)})

    return _pieces(width, primes, begin, rows, end)


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
                   least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors with an id divisible by ``every``.

    The table has ``vec_id, label, embedding``; a component counts as floor(scale * x). Positives are the anchor's best rows
    of its label, negatives the best rows of other labels with least_percent * p <= 100 * n <= most_percent * p. Higher
    scores come first, equal ones by the smaller id. Rows without an id, label or vector and such with a null or non-finite
    component take no part. Rows that repeat id, label and vector count once; an id with several of them competes with
    each and asks with each, and no row of the anchor's id is its positive or negative. Shorter vectors are filled with
    zeros, empty ones have score 0. Too few rows give fewer results, an empty table none; other columns are ignored.
    Scores that might not fit 64 bits are an error.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_usable(scale), "vec_id long, label long, v binary, square double").dropDuplicates(["vec_id", "label", "v"])
    rows = cut_lineage(rows.withColumn("_a", F.xxhash64("vec_id", "label", "v")))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.max("square").alias("square"), F.max(F.octet_length("v")).alias("bytes")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stats["n"] or not stats["anchors"]:
        return spark.createDataFrame([], schema)
    bound = stats["square"] * (1 + 1e-9) + 1
    if not bound < MOST_SCORE:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    primes, width = primes_for(bound), stats["bytes"] // 8
    groups = -(-stats["anchors"] // ANCHOR_GROUP)
    # at least a slice for each core, unless slices get very small
    slices = max(-(-stats["n"] // SLICE_ROWS), min(spark.sparkContext.defaultParallelism, -(-stats["n"] // LEAST_SLICE)))
    group, part = F.pmod(F.xxhash64("_a"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    anchors = rows.where(F.col("vec_id") % every == 0)
    piece = ["slice", "group"]

    def searched(asking: DataFrame, found, out: str) -> DataFrame:
        offered = rows.select(part.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "label", "_a", "v")
        if "positives" in asking.columns:
            offered = offered.withColumn("positives", F.lit(None).cast(asking.schema["positives"].dataType))
        asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), group.alias("group"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), *[c for c in offered.columns[4:]])
        return asked.unionByName(offered).repartition(*piece).sortWithinPartitions(*piece, "side").mapInArrow(found, out)

    near = searched(anchors, _positives(width, primes, positives), "anchor_id long, _a long, vec_id long, score long").distinct()
    best = Window.partitionBy("anchor_id", "_a").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id"), "_a").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("positives"))
    asking = cut_lineage(anchors.join(lists, ["vec_id", "_a"]))
    out = "anchor_id long, _a long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = searched(asking, _negatives(width, primes, negatives, least_percent, most_percent), out).distinct()
    ranks = Window.partitionBy("anchor_id", "_a", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
