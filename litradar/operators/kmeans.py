"""Spherical k-means for many profiles at once, and the search for k.

A fit is made for (profile, k) pairs and runs over all items. Every round assigns each item to its nearest centroid
and moves each centroid to the mean direction of its members, until no coordinate moves by more than 1e-13. A profile
that fits in one group makes its rounds there; the items of a larger one sit in (profile, slice) groups of bounded size
in a table bucketed by them, so each round shuffles only the centroids, and the groups return partial sums. Start, update and stop are the same. All k of a
profile are tried on the one copy of its vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import l2_normalize
from ..params import Clustering
from ..session import cut_lineage, ensure_checkpoint_dir
from .clusters import choose_k, cluster_bounds
from .neighbors import BLOCK_ROWS, _matrix
from .skew import hot_keys, with_slices

SETTLED = 1e-13


def _owners(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(rows @ centroids.T, 9), axis=1)


def _sums(rows: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, rows.shape[1]))
    for c in np.unique(owner):
        out[c] = rows[owner == c].sum(axis=0)
    return out


def _lloyd(rows: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Owner of each row; the first k rows are the start, and a cluster that loses all members stays where it is."""
    centroids = rows[:k].copy()
    for _ in range(iterations):
        totals = _sums(rows, _owners(rows, centroids), k)
        norm = np.linalg.norm(totals, axis=1, keepdims=True)
        moved = np.where(norm > 0, totals / np.where(norm > 0, norm, 1.0), centroids)
        settled = np.abs(moved - centroids).max() <= SETTLED
        centroids = moved
        if settled:
            break
    return _owners(rows, centroids)


def _silhouettes(rows: np.ndarray, owner: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cosine silhouette of each row from the sums and sizes of all clusters; 0 for the only member of one."""
    distance = counts[None, :] - rows @ sums.T
    at = np.arange(len(rows))
    own = distance[at, owner] / np.maximum(counts[owner] - 1, 1)
    others = np.where(counts[None, :] > 0, distance / np.maximum(counts, 1)[None, :], np.inf)
    others[at, owner] = np.inf
    nearest = others.min(axis=1)
    top = np.maximum(own, nearest)
    return np.where((counts[owner] > 1) & (top > 0), (nearest - own) / np.where(top > 0, top, 1.0), 0.0)


def _table(profile: int, columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    n = len(next(iter(columns.values()))[0])
    return pa.table({"profile_id": pa.array([profile] * n, pa.int64()), **{name: pa.array(v, t) for name, (v, t) in columns.items()}})


def _whole(iterations: int, scores: bool) -> Callable[[pa.Table], pa.Table]:
    """All rounds of a profile in its one group: assignments, or the silhouette of each k."""

    def fn(items: pa.Table) -> pa.Table:
        items = items.sort_by([("place", "ascending"), ("key", "ascending")])
        rows, profile = _matrix(items["embedding"], 1e-12), items["profile_id"][0].as_py()
        ks, keys, owners, values = [], [], [], []
        for k in sorted(items["ks"][0].as_py()):
            owner = _lloyd(rows, min(k, len(rows)), iterations)
            if scores:
                counts = np.bincount(owner)
                if 2 <= (counts > 0).sum() < len(rows):
                    ks.append(k)
                    values.append(float(_silhouettes(rows, owner, _sums(rows, owner, len(counts)), counts).mean()))
            else:
                ks += [k] * len(rows)
                keys += items["key"].to_pylist()
                owners += owner.tolist()
        if scores:
            return _table(profile, {"k": (ks, pa.int64()), "silhouette": (values, pa.float64())})
        return _table(profile, {"k": (ks, pa.int64()), "key": (keys, pa.string()), "cluster_id": (owners, pa.int64())})

    return fn


def _part(result: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one slice contributes: partial sums, assignments, or the sum of its silhouettes."""

    def fn(items: pa.Table, centroids: pa.Table) -> pa.Table:
        ks, ids, totals, counts, keys, values = [], [], [], [], [], []
        profile = items["profile_id"][0].as_py() if items.num_rows else 0
        rows = _matrix(items["embedding"], 1e-12) if items.num_rows and centroids.num_rows else None
        for k in sorted(set(centroids["k"].to_pylist())) if rows is not None else ():
            own = centroids.filter(pa.compute.equal(centroids["k"], k)).sort_by("cluster_id")
            owner = _owners(rows, _matrix(own["centroid"], 1e-12))
            if result == "sums":
                sums, size = _sums(rows, owner, own.num_rows), np.bincount(owner, minlength=own.num_rows)
                for c in np.flatnonzero(size).tolist():
                    ks.append(k)
                    ids.append(c)
                    totals.append(sums[c].tolist())
                    counts.append(int(size[c]))
            elif result == "owners":
                ks += [k] * len(rows)
                keys += items["key"].to_pylist()
                ids += owner.tolist()
            else:
                sums = np.array(own["total"].to_pylist(), dtype=np.float64)
                value = _silhouettes(rows, owner, sums, own["n"].to_numpy())
                ks.append(k)
                values.append(float(value.sum()))
                counts.append(len(rows))
        if result == "sums":
            return _table(profile, {"k": (ks, pa.int64()), "cluster_id": (ids, pa.int64()), "total": (totals, pa.list_(pa.float64())), "n": (counts, pa.int64())})
        if result == "owners":
            return _table(profile, {"k": (ks, pa.int64()), "key": (keys, pa.string()), "cluster_id": (ids, pa.int64())})
        return _table(profile, {"k": (ks, pa.int64()), "value": (values, pa.float64()), "n": (counts, pa.int64())})

    return fn


class _Sliced:
    """The rounds of profiles whose items are cut into slices. The items are shuffled once, into a table bucketed by slice."""

    def __init__(self, library: DataFrame, tries: DataFrame, seed: int, block_rows: int):
        rows = with_slices(library, ["profile_id"], "key", block_rows).withColumn("place", F.xxhash64(F.lit(seed), F.col("key")))
        spark = library.sparkSession
        parts = hot_keys(library.select("profile_id"), ["profile_id"], block_rows).agg(F.sum("_parts")).first()[0] or 1
        buckets = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table, path = f"litradar_slices_{uuid.uuid4().hex}", f"{ensure_checkpoint_dir(spark)}/slices-{uuid.uuid4().hex}"
        rows.repartition(buckets, "profile_id", "slice").write.bucketBy(buckets, "profile_id", "slice").option("path", path).saveAsTable(self.table)
        self.items = spark.table(self.table)
        self.slices = cut_lineage(self.items.select(F.col("profile_id").alias("p"), F.col("slice").alias("s")).distinct())
        # the limit prunes before the shuffle
        most = tries.agg(F.max("k")).first()[0] or 0
        order = Window.partitionBy("profile_id").orderBy("place", "key")
        first = self.items.withColumn("no", F.row_number().over(order)).where(F.col("no") <= most)
        self.centroids = cut_lineage(first.join(tries, "profile_id").where("no <= k").select(
            "profile_id", "k", (F.col("no") - 1).cast("long").alias("cluster_id"), l2_normalize(F.col("embedding").cast("array<double>")).alias("centroid")))

    def _parts(self, state: DataFrame, result: str, schema: str) -> DataFrame:
        spread = state.join(self.slices, state.profile_id == self.slices.p).drop("profile_id")
        return self.items.groupBy("profile_id", "slice").cogroup(spread.groupBy("p", "s")).applyInArrow(_part(result), schema)

    def _totals(self) -> DataFrame:
        sums = self._parts(self.centroids, "sums", "profile_id long, k long, cluster_id long, total array<double>, n long")
        added = sums.groupBy("profile_id", "k", "cluster_id").agg(Summarizer.metrics("sum").summary(array_to_vector("total")).alias("t"), F.sum("n").alias("n"))
        return added.select("profile_id", "k", "cluster_id", vector_to_array("t.sum").alias("total"), "n")

    def run(self, iterations: int) -> None:
        path = ["profile_id", "k", "cluster_id"]
        for _ in range(iterations):
            moved = self._totals().select(*path, l2_normalize(F.col("total"), 0.0).alias("moved"))
            step = F.array_max(F.zip_with("moved", "centroid", lambda a, b: F.abs(a - b)))
            both = self.centroids.join(moved, path, "left")
            after = cut_lineage(both.select(*path, F.coalesce("moved", "centroid").alias("centroid"), F.coalesce(step > SETTLED, F.lit(False)).alias("moving")))
            self.centroids = after.drop("moving")
            if after.where("moving").isEmpty():
                return

    def owners(self) -> DataFrame:
        return cut_lineage(self._parts(self.centroids, "owners", "profile_id long, k long, key string, cluster_id long"))

    def silhouettes(self) -> DataFrame:
        path = ["profile_id", "k", "cluster_id"]
        zero = F.transform("centroid", lambda x: x * 0.0)
        totals = cut_lineage(self._totals())
        state = self.centroids.join(totals, path, "left").select(*path, "centroid", F.coalesce("total", zero).alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        values = self._parts(state, "silhouettes", "profile_id long, k long, value double, n long")
        found = totals.groupBy("profile_id", "k").agg(F.count("*").alias("clusters"))
        mean = values.groupBy("profile_id", "k").agg((F.sum("value") / F.sum("n")).alias("silhouette"), F.sum("n").alias("rows"))
        kept = mean.join(found, ["profile_id", "k"]).where((F.col("clusters") >= 2) & (F.col("clusters") < F.col("rows")))
        return cut_lineage(kept.select("profile_id", "k", "silhouette"))

    def close(self) -> None:
        """Forget the table; its files stay in the shared folder."""
        self.items.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def _fit(library: DataFrame, tries: DataFrame, iterations: int, seed: int, block_rows: int, scores: bool) -> DataFrame:
    narrow = library.select(F.col("profile_id").cast("long").alias("profile_id"), "key", "embedding")
    wanted = cut_lineage(tries.select(F.col("profile_id").cast("long").alias("profile_id"), F.col("k").cast("long").alias("k")).distinct())
    large = cut_lineage(hot_keys(narrow.select("profile_id"), ["profile_id"], block_rows).select("profile_id"))
    ks = wanted.groupBy("profile_id").agg(F.collect_set("k").alias("ks"))  # a few dozen at most
    small = narrow.join(large, "profile_id", "left_anti").join(ks, "profile_id").withColumn("place", F.xxhash64(F.lit(seed), F.col("key")))
    schema = "profile_id long, k long, silhouette double" if scores else "profile_id long, k long, key string, cluster_id long"
    out = cut_lineage(small.groupBy("profile_id").applyInArrow(_whole(iterations, scores), schema))
    if large.isEmpty():
        return out
    sliced = _Sliced(narrow.join(large, "profile_id", "left_semi"), wanted.join(large, "profile_id", "left_semi"), seed, block_rows)
    try:
        sliced.run(iterations)
        return out.unionByName(sliced.silhouettes() if scores else sliced.owners())
    finally:
        sliced.close()


def fit_assign(library: DataFrame, ks: DataFrame, p: Clustering = Clustering(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cluster every profile with its own k: ``(profile_id, key, cluster_id)``.

    ``library(profile_id, key, embedding)``, ``ks(profile_id, k)``. Start centroids are the first k items in seeded hash
    order; ``block_rows`` is the size of a group.
    """
    return _fit(library, ks, p.iterations, p.seed, block_rows, False).drop("k")


def search_k(library: DataFrame, p: Clustering = Clustering(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette over all items of each k between the bounds, where at least two clusters came out."""
    sizes = library.groupBy("profile_id").agg(F.count("*").alias("n_items"))
    low, high = cluster_bounds(F.col("n_items"), p)
    bounds = sizes.select("profile_id", low.alias("min_k"), high.alias("max_k")).where("max_k > 1")
    tries = bounds.select("profile_id", F.explode(F.sequence("min_k", "max_k")).alias("k"))
    return _fit(library, tries, p.search_iterations, p.seed, block_rows, True)


def choose_cluster_counts(library: DataFrame, p: Clustering = Clustering(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(profile_id, k)``; 1 where the profile is tiny or no k gave two clusters."""
    chosen = choose_k(search_k(library, p, block_rows), p.tolerance).select("profile_id", "k")
    return library.select("profile_id").distinct().join(chosen, "profile_id", "left").select(
        F.col("profile_id").cast("long").alias("profile_id"), F.coalesce("k", F.lit(1)).cast("long").alias("k")
    )
