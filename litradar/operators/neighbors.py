"""Exact nearest neighbours and cluster similarity in blocks.

Both sides are cut into blocks; a block pair is one Arrow group with one matrix
product, and only the winners leave Python. The candidate side is shared by all
profiles; a library block holds several small profiles or a slice of a large one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import skew_join, with_slices

BLOCK_ROWS = 20_000
_SCORE_ROWS, _SCORE_COLUMNS = 256, 4096  # candidate rows and library rows per matrix product inside a block
_DIGITS = 9  # equal up to here is a tie: the last bits depend on how rows fall into blocks


def _matrix(column: pa.ChunkedArray, eps: float) -> np.ndarray:
    """Unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + eps)


def _segments(owner: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal owners."""
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    edges = np.concatenate(([0], cuts, [len(owner)]))
    return list(zip(edges[:-1], edges[1:], strict=True))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best per row, best first; equal scores by column order."""
    if scores.shape[1] > 4 * k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        masked = np.where(scores >= kth[:, None], scores, -np.inf)
        width = int((scores >= kth[:, None]).sum(axis=1).max())
        if width == k:
            picked = np.sort(np.argpartition(-masked, k - 1, axis=1)[:, :k], axis=1)
            order = np.argsort(-np.take_along_axis(masked, picked, axis=1), axis=1, kind="stable")
            return np.take_along_axis(picked, order, axis=1)
        scores = masked
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _merge(best: np.ndarray, at: np.ndarray, sims: np.ndarray, first: int, k: int) -> None:
    """Take the scores of columns ``first``… into the k best so far (``best`` similarities, ``at`` columns), in place."""
    worst = np.round(best[:, -1], _DIGITS)
    # a tie with the worst one is lost, as its column is later; half a digit more is needed to come before it
    rows, cols = np.nonzero(sims > (np.where(np.isnan(worst), -np.inf, worst) + 0.25 * 10.0**-_DIGITS)[:, None])
    if not len(rows):
        return
    touched, where = np.unique(rows, return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(touched)), k), where])
    sim = np.concatenate([best[touched].ravel(), sims[rows, cols]])
    col = np.concatenate([at[touched].ravel(), cols + first])
    order = np.lexsort((col, -np.round(sim, _DIGITS), row))
    starts = np.searchsorted(row[order], np.arange(len(touched)))
    picked = order[starts[:, None] + np.arange(k)]
    best[touched], at[touched] = sim[picked], col[picked]


def _top_of(left: np.ndarray, right: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and similarities of the k best of the library rows ``lo`` to ``hi``; the scores of one tile are held at a time."""
    k, end = min(k, hi - lo), min(hi, lo + max(_SCORE_COLUMNS, k))
    sims = left @ right[:, lo:end]
    at = _top(np.round(sims, _DIGITS), k)
    best = np.take_along_axis(sims, at, axis=1)
    at = at + lo
    for first in range(end, hi, _SCORE_COLUMNS):
        _merge(best, at, left @ right[:, first : min(hi, first + _SCORE_COLUMNS)], first, k)
    return at, best


def _block_top_k(k: int, eps: float):
    def fn(candidates: pa.Table, library: pa.Table) -> pa.Table:
        out = {name: [] for name in ("profile_id", "ordinal", "key", "weight", "sim")}
        if candidates.num_rows and library.num_rows:
            library = library.sort_by([("profile_id", "ascending"), ("key", "ascending")])
            owner = library["profile_id"].to_numpy()
            keys = np.asarray(library["key"].to_pylist(), dtype=object)
            weights = library["weight"].to_numpy()
            right = _matrix(library["embedding"], eps).T
            left = _matrix(candidates["embedding"], eps)
            ordinals = candidates["ordinal"].to_numpy()
            for at in range(0, len(left), _SCORE_ROWS):
                for lo, hi in _segments(owner):
                    best, sims = _top_of(left[at : at + _SCORE_ROWS], right, lo, hi, k)
                    rows, width = best.shape
                    flat = best.ravel()
                    out["profile_id"].append(np.full(rows * width, owner[lo]))
                    out["ordinal"].append(np.repeat(ordinals[at : at + rows], width))
                    out["key"].append(keys[flat])
                    out["weight"].append(weights[flat])
                    out["sim"].append(sims.ravel())
        types = {"profile_id": pa.int64(), "ordinal": pa.int64(), "key": pa.string(), "weight": pa.float64(), "sim": pa.float64()}
        return pa.table(
            {n: pa.array(np.concatenate(v) if v else [], type=types[n]) for n, v in out.items()}
        )

    return fn


def _blocks(rows: int, block_rows: int, parallelism: int, min_rows: int = 256) -> int:
    """Enough blocks to bound a group, and to keep all cores busy on smaller inputs."""
    return max(1, math.ceil(rows / block_rows), min(parallelism, math.ceil(rows / min_rows)))


def _each(n: int) -> Column:
    """One copy of the row per block of the other side."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _reaching(candidates: DataFrame, homes: DataFrame, n_right: int, wanted: DataFrame | None) -> DataFrame:
    """Candidates with the library blocks ``rb_c`` they have to meet: all, or those with a profile that wants them.

    ``homes(profile_id, rb)`` tells in which blocks a profile is.
    """
    rows = candidates.select(F.col("ordinal").cast("long").alias("ordinal"), "embedding")
    if wanted is None:
        return rows.select("*", _each(n_right).alias("rb_c"))
    pairs = wanted.select(F.col("profile_id").cast("long").alias("profile_id"), F.col("ordinal").cast("long").alias("ordinal"))
    if n_right == 1:
        return rows.join(pairs.select("ordinal").distinct(), "ordinal", "left_semi").withColumn("rb_c", F.lit(0).cast("long"))
    spots = skew_join(pairs, homes.distinct(), ["profile_id"], "inner", ["ordinal"]).select("ordinal", F.col("rb").alias("rb_c")).distinct()
    return rows.join(spots, "ordinal")


def knn_join(candidates: DataFrame, library: DataFrame, k: int = 5, eps: float = 1e-12,
             block_rows: int = BLOCK_ROWS, wanted: DataFrame | None = None) -> DataFrame:
    """The k library items most similar to each candidate, per profile.

    ``wanted(profile_id, ordinal)`` sends a candidate only to blocks with a profile that wants it; a block may
    hold others, too, so the caller keeps the wanted pairs of the result.

    ``candidates(ordinal, embedding)``, ``library(profile_id, key, weight, embedding)`` give
    ``(profile_id, ordinal, key, weight, sim, rank)``; ties go to the smaller key.
    """
    spark = candidates.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # two numbers come to the driver
    total, n_candidates = library.count(), candidates.count()
    if not total or not n_candidates:
        return spark.createDataFrame([], "profile_id long, ordinal long, key string, weight double, sim double, rank int")
    n_left = _blocks(n_candidates, block_rows, cores)
    n_right = max(1, math.ceil(total / block_rows))

    right = library.select("profile_id", "key", F.col("weight").cast("double").alias("weight"), "embedding")
    right = with_slices(right, ["profile_id"], "key", block_rows) if n_right > 1 else right.withColumn("slice", F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("profile_id", "slice"), F.lit(n_right)).alias("rb")
    left = _reaching(candidates, right.select("profile_id", block), n_right, wanted)
    left = left.select(F.pmod(F.xxhash64("ordinal"), F.lit(n_left)).alias("lb_c"), "rb_c", "ordinal", "embedding")
    right = right.select(block, _each(n_left).alias("lb"), "profile_id", "key", "weight", "embedding")
    found = left.groupBy("lb_c", "rb_c").cogroup(right.groupBy("lb", "rb")).applyInArrow(
        _block_top_k(k, eps), "profile_id long, ordinal long, key string, weight double, sim double"
    )
    # slices of one profile bring k rows each; the limit on the rank prunes them before the shuffle
    ranked = Window.partitionBy("profile_id", "ordinal").orderBy(F.desc(F.round("sim", _DIGITS)), "key")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def micro_scores(neighbors: DataFrame) -> DataFrame:
    """Weighted mean similarity of the neighbours, and the best plain similarity."""
    return neighbors.groupBy("profile_id", "ordinal").agg(
        (F.sum(F.col("sim") * F.col("weight")) / (F.sum("weight") + F.lit(1e-8))).alias("micro"),
        F.max("sim").alias("top_similarity"),
    )


_CLUSTER_SCHEMA = (
    "profile_id long, ordinal long, cluster_id long, sim double, raw double, max_log_size double, sim_rank int, is_best boolean"
)


def _block_clusters(keep: int, eps: float):
    def fn(candidates: pa.Table, clusters: pa.Table) -> pa.Table:
        names = ("profile_id", "ordinal", "cluster_id", "sim", "raw", "max_log_size", "sim_rank", "is_best")
        out = {name: [] for name in names}
        if candidates.num_rows and clusters.num_rows:
            clusters = clusters.sort_by([("profile_id", "ascending"), ("cluster_id", "ascending")])
            owner = clusters["profile_id"].to_numpy()
            ids = clusters["cluster_id"].to_numpy()
            logs = clusters["log_size"].to_numpy()
            right = _matrix(clusters["centroid"], eps).T
            left = _matrix(candidates["embedding"], eps)
            ordinals = candidates["ordinal"].to_numpy()
            for at in range(0, len(left), _SCORE_ROWS):
                for lo, hi in _segments(owner):
                    part = left[at : at + _SCORE_ROWS] @ right[:, lo:hi]
                    raw = part * logs[lo:hi]
                    winner = np.argmax(np.round(raw, _DIGITS), axis=1)
                    order = np.argsort(-np.round(part, _DIGITS), axis=1, kind="stable")[:, :keep]
                    rows, width = order.shape
                    # the winner may lie outside the closest few: one extra row, rank 0
                    picked = np.concatenate([winner[:, None], order], axis=1)
                    n = rows * (width + 1)
                    out["profile_id"].append(np.full(n, owner[lo]))
                    out["ordinal"].append(np.repeat(ordinals[at : at + rows], width + 1))
                    out["cluster_id"].append(ids[lo:hi][picked].ravel())
                    out["sim"].append(np.take_along_axis(part, picked, axis=1).ravel())
                    out["raw"].append(np.take_along_axis(raw, picked, axis=1).ravel())
                    out["max_log_size"].append(np.full(n, logs[lo:hi].max()))
                    out["sim_rank"].append(np.tile(np.arange(width + 1), rows))
                    out["is_best"].append((np.tile(np.arange(width + 1), rows) == 0))
        types = dict(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()],
                         strict=True))
        return pa.table({n: pa.array(np.concatenate(v) if v else [], type=types[n]) for n, v in out.items()})

    return fn


def cluster_scores(candidates: DataFrame, clusters: DataFrame, keep: int = 5, eps: float = 1e-8,
                   block_rows: int = BLOCK_ROWS, wanted: DataFrame | None = None) -> DataFrame:
    """Per candidate and profile: the winning cluster (``is_best``) and the ``keep`` most similar ones.

    ``clusters(profile_id, cluster_id, centroid, effective_size)``. The winner maximises
    sim * ln(1 + effective size); its macro score is that over the largest ln(1 + size).
    A profile has at most a few dozen clusters, so it is never split over blocks. ``wanted`` as in ``knn_join``.
    """
    spark = candidates.sparkSession
    n_clusters, n_candidates = clusters.count(), candidates.count()
    n_left = _blocks(n_candidates, block_rows, spark.sparkContext.defaultParallelism)
    n_right = max(1, math.ceil(n_clusters / block_rows))
    block = F.pmod(F.xxhash64("profile_id"), F.lit(n_right)).alias("rb")
    right = clusters.select(
        block, _each(n_left).alias("lb"),
        "profile_id", F.col("cluster_id").cast("long").alias("cluster_id"), "centroid",
        F.log1p("effective_size").alias("log_size"),
    )
    left = _reaching(candidates, clusters.select("profile_id", block), n_right, wanted)
    left = left.select(F.pmod(F.xxhash64("ordinal"), F.lit(n_left)).alias("lb_c"), "rb_c", "ordinal", "embedding")
    return left.groupBy("lb_c", "rb_c").cogroup(right.groupBy("lb", "rb")).applyInArrow(_block_clusters(keep, eps), _CLUSTER_SCHEMA)


def macro_scores(scored: DataFrame) -> DataFrame:
    """The winner rows as ``(profile_id, ordinal, macro, cluster_id)``."""
    macro = F.when(F.col("max_log_size") > 0, F.col("raw") / F.col("max_log_size")).otherwise(F.lit(0.0))
    return scored.where("is_best").select("profile_id", "ordinal", macro.alias("macro"), "cluster_id")


def similar_clusters(scored: DataFrame) -> DataFrame:
    return scored.where("NOT is_best").select("profile_id", "ordinal", "sim_rank", "cluster_id", "sim")
