"""Exact top-k search by inner product with a pivot-distance index.

Vectors are cut to integers. A vector's key is its nearest pivot and its distance from it; the distances around a pivot
are cut into annuli, and a crowded annulus into slices of bounded size. For a query the triangle inequality bounds the
distance to all vectors of an annulus from below, and with their largest norm their inner products from above. A first
slice of the most promising annulus gives each query a score that it can surely reach; then only annuli whose bound is
no lower are searched, so the expansion stops without losing a result.

Pivots and the limits of annuli come from a bounded sample; they decide the speed, not the result. The annuli are so few
that their bounds are sent with the code. Queries travel in groups, rows in slices; a piece of work is one group against
one slice, in batches, and leaves k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

SCALE = 1024
SAMPLE, PIVOTS, ANNULI = 2_000, 32, 8
SLICE_ROWS, GROUP_QUERIES = 8_192, 512
# beyond this, scores might not fit 64 bits
MOST_SCORE = 2.0**62
TOO_LARGE = "inner products of these vectors may not fit 64 bits"


def _integers(scale: int):
    """Whole batches at once: rows without id or vector or with a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            offsets = vectors.offsets.to_numpy()
            x = vectors.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            present = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
            good = present & (bad[offsets[1:]] == bad[offsets[:-1]])
            size = np.diff(offsets)[good]
            place = np.repeat(offsets[:-1][good] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            values = np.floor(x[place] * scale)
            if len(values) and not np.abs(values).max() < MOST_SCORE**0.5:
                raise ValueError(TOO_LARGE)
            ends = np.concatenate(([0], 8 * np.cumsum(size))).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<i8"))])
            yield pa.record_batch({"vec_id": batch.column("vec_id").filter(pa.array(good)), "v": held})

    return run


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), dtype="<i8").reshape(len(values), width)
    out = np.zeros((len(values), width), dtype=np.int64)
    for row, v in zip(out, values, strict=True):
        row[: len(v) // 8] = np.frombuffer(v, dtype="<i8")
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where all sums are below 2**53."""
    if a.shape[1] and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def choose_pivots(rows: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest first: each next pivot is the row with the largest distance from those chosen."""
    if not len(rows):
        return rows
    chosen = [0]
    far = np.linalg.norm(rows - rows[0], axis=1)
    while len(chosen) < min(pivots, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
    return rows[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T, 0))


def _keyed(pivots: np.ndarray, edges: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            far = _distances(rows, pivots)
            pivot = far.argmin(axis=1)
            near = far[np.arange(len(rows)), pivot]
            annulus = (near[:, None] > edges[pivot]).sum(axis=1)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "annulus": pa.array(pivot * ANNULI + annulus, pa.int32()),
                                   "far": pa.array(near), "norm": pa.array(np.sqrt((rows**2).sum(axis=1)))})

    return run


def _needs(pivots: np.ndarray, rings: np.ndarray, width: int, first: bool):
    """Annuli each query has to search: the best one, or all whose bound reaches the query's sure score.

    ``rings`` has a row ``annulus, nearest, farthest, largest norm`` for each annulus that is not empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            if not len(rows):
                continue
            away = _distances(rows, pivots)[:, rings[:, 0].astype(int) // ANNULI]
            gap = np.maximum(np.maximum(away - rings[:, 2], rings[:, 1] - away), 0)
            norm = np.sqrt((rows**2).sum(axis=1))[:, None]
            bound = np.minimum((norm**2 + rings[:, 3] ** 2 - gap**2) / 2, norm * rings[:, 3])
            # rounding must not cut a result off
            bound = bound + 1e-9 * (norm**2 + rings[:, 3] ** 2) + 1e-3
            if first:
                row, ring = np.arange(len(rows)), bound.argmax(axis=1)
            else:
                sure = np.array([-np.inf if x is None else x for x in batch.column("sure").to_pylist()], dtype=np.float64)
                row, ring = np.nonzero(bound >= sure[:, None])
            take = pa.array(row)
            yield pa.record_batch({"query_id": batch.column("vec_id").take(take), "v": batch.column("v").take(take), "group": batch.column("group").take(take), "annulus": pa.array(rings[ring, 0].astype(np.int32))})

    return run


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= least
        ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _searched(width: int, k: int):
    """Rows come sorted by piece, the queries of a piece before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, query_ids, queries, matrix, found = None, [], [], None, {}

        def finish() -> pa.RecordBatch:
            rows = [(q, i, s) for q, (ids, score) in found.items() for i, s in zip(ids.tolist(), score.tolist(), strict=True)]
            return pa.record_batch({n: pa.array([r[c] for r in rows], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("annulus", "slice", "group")])
            cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if piece != tuple(keys[a]):
                    if found:
                        yield finish()
                    piece, query_ids, queries, matrix, found = tuple(keys[a]), [], [], None, {}
                part = batch.slice(a, b - a)
                side = part.column("side").to_numpy()
                ids, values = part.column("id").to_numpy(), part.column("v").to_pylist()
                n = int((side == 0).sum())
                query_ids += ids[:n].tolist()
                queries += values[:n]
                for at in range(n, len(values) if queries else 0, 4096):
                    own, matrix = ids[at : at + 4096], _matrix(queries, width) if matrix is None else matrix
                    scores = _products(matrix, _matrix(values[at : at + 4096], width))
                    for q, row in zip(query_ids, scores, strict=True):
                        other = own != q
                        had = found.get(q, (own[:0], row[:0]))
                        found[q] = _best(np.concatenate((had[0], own[other])), np.concatenate((had[1], row[other])), k)
        if found:
            yield finish()

    return run


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """``query_id, rank`` (from 1)``, vec_id, score`` for queries with an id divisible by ``every`` against all other rows.

    Components are floor(scale * x); equal scores go by the smaller id. A null id, a null vector and one with a null or
    non-finite component take no part. Rows that repeat id and vector count once; an id with several vectors competes
    with each, and asks with each of them at once (its best scores). Shorter vectors are filled with zeros. Fewer than
    ``k`` other rows give fewer results, an empty table none. Scores that might not fit 64 bits are an error.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers(scale), "vec_id long, v binary")
    rows = cut_lineage(rows.dropDuplicates(["vec_id", "v"]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()  # bounded
    widest = rows.agg(F.max(F.octet_length("v"))).first()[0] or 0
    width = widest // 8
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = _matrix([bytes(r["v"]) for r in sample], width).astype(np.float64)
    pivots = choose_pivots(held, PIVOTS)
    far = _distances(held, pivots)
    nearest, near = far.argmin(axis=1), far.min(axis=1)
    inner = np.linspace(0, 1, ANNULI + 1)[1:-1]
    edges = np.array([np.quantile(near[nearest == p], inner) if (nearest == p).any() else np.zeros(ANNULI - 1) for p in range(len(pivots))])
    index = cut_lineage(rows.mapInArrow(_keyed(pivots, edges, width), "vec_id long, v binary, annulus int, far double, norm double"))
    # at most PIVOTS * ANNULI rows
    stats = index.groupBy("annulus").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    rings = np.array(sorted((r["annulus"], r["least"], r["most"], r["norm"]) for r in stats), dtype=np.float64)
    if not rings[:, 3].max() ** 2 * (1 + 1e-9) < MOST_SCORE:
        raise ValueError(TOO_LARGE)
    slices = F.create_map(*[F.lit(x) for r in stats for x in (r["annulus"], -(-r["n"] // SLICE_ROWS))])
    sliced = index.withColumn("slice", F.pmod(F.xxhash64("vec_id"), slices[F.col("annulus")]).cast("int"))
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    groups = -(-queries.count() // GROUP_QUERIES) or 1
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))

    def search(asked: DataFrame, first: bool) -> DataFrame:
        needs = cut_lineage(asked.mapInArrow(_needs(pivots, rings, width, first), "query_id long, v binary, group int, annulus int"))
        pairs = F.broadcast(needs.select("annulus", "group").distinct()) if groups <= 100 else needs.select("annulus", "group").distinct()
        last = F.lit(0) if first else (slices[F.col("annulus")] - 1).cast("int")
        asking = needs.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
        data = sliced.where(F.col("slice") == 0) if first else sliced
        both = asking.select("annulus", "slice", "group", F.lit(0).alias("side"), F.col("query_id").alias("id"), "v").unionByName(
            data.join(pairs, "annulus").select("annulus", "slice", "group", F.lit(1).alias("side"), F.col("vec_id").alias("id"), "v"))
        piece = ["annulus", "slice", "group"]
        found = both.repartition(*piece).sortWithinPartitions(*piece, "side").mapInArrow(_searched(width, k), "query_id long, vec_id long, score long")
        ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)

    sure = search(queries, True).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("sure"))
    asked = queries.join(sure, "vec_id", "left").select("vec_id", "v", "group", "sure")
    return search(asked, False).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
