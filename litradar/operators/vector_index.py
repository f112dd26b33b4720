"""A library's vectors stored once in cells, and an exact neighbour search that visits cells in order of their bound.

A profile has pivots, and each vector belongs to its nearest one. The vectors of a pivot are cut into cells by their
distance to it, so a cell is a ring with an inner and an outer radius. By the triangle inequality nothing in a cell is
nearer to a candidate than the gap between the ring and the candidate's distance to the pivot, which bounds the similarity.

The cells are one row each in a table bucketed by cell, which stays in place for later runs. A search
sends each candidate to the cell with the best bound of each profile, for a sure similarity. Candidates of the same best cell
are then a group, and groups meet the cells whose bound reaches them in one lane a core: a cell is copied once for a lane and
not a candidate once for a cell, and only the best of all cells read together leave a task. What is gained depends on the
data: on random directions rings overlap and all cells are searched, which is quadratic in time; ``visited_share`` tells.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .neighbors import _DIGITS, _SCORE_ROWS, _each, _matrix, _top
from .skew import with_slices

CELL_ROWS = 4096
MOST_PIVOTS = 64  # of a profile; more vectors make more rings, not more pivots
RINGS = 128  # steps of the distance, which is at most 2
GROUP_ROWS = 1024  # candidates that meet a cell at once
SIDE_VALUES = 1 << 23  # components of the cells that a task of the search reads
_BOUND_ROWS = 4096  # candidates whose bounds are found at once
_SLACK = 1e-7  # rounding of distances and of scores


@dataclass(frozen=True)
class VectorIndex:
    """``pivots(profile_id, pivot, embedding, cells)`` with the rings of each pivot, and the name of the table of ``cell, items``."""

    pivots: DataFrame
    table: str

    @property
    def cells(self) -> DataFrame:
        return self.pivots.sparkSession.table(self.table)


def _nearest_pivot(eps: float):
    def fn(items: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("pivot")
        left, right = _matrix(items["embedding"], eps), _matrix(pivots["embedding"], eps)
        square = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * (left @ right.T)
        nearest = square.argmin(axis=1)
        # from the difference: the expanded square loses digits near zero
        distance = np.linalg.norm(left - right[nearest], axis=1)
        return pa.table({"profile_id": items["profile_id"], "key": items["key"], "weight": items["weight"], "embedding": items["embedding"],
                         "pivot": pa.array(pivots["pivot"].to_numpy()[nearest], pa.int32()), "distance": pa.array(distance, pa.float64())})

    return fn


def build_index(library: DataFrame, cell_rows: int = CELL_ROWS, eps: float = 1e-12, buckets: int | None = None) -> VectorIndex:
    """Write ``library(profile_id, key, weight, embedding)`` as cells of about ``cell_rows`` vectors.

    Pivots are the first rows of a profile in hash order, one for each ``cell_rows`` vectors and at most ``MOST_PIVOTS``.
    Rows without a vector are left out. A ring with more rows, copies for instance, is cut into parts by key.
    """
    spark = library.sparkSession
    items = cut_lineage(library.where("embedding IS NOT NULL").select(
        F.col("profile_id").cast("long").alias("profile_id"), "key", F.col("weight").cast("double").alias("weight"), "embedding"))
    sizes = items.groupBy("profile_id").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("profile_id").orderBy(F.xxhash64("key"), "key")
    pivots = items.select("profile_id", "key", "embedding").withColumn("pivot", F.row_number().over(first)).where(F.col("pivot") <= MOST_PIVOTS)
    pivots = cut_lineage(pivots.join(sizes, "profile_id").where(F.col("pivot") <= F.ceil(F.col("_n") / cell_rows)).select("profile_id", "pivot", "embedding"))
    sliced = cut_lineage(with_slices(items, ["profile_id"], "key", 20_000))
    copies = pivots.join(sliced.select("profile_id", F.col("slice").alias("slice_p")).distinct(), "profile_id")
    kind = library.schema["embedding"].dataType.simpleString()
    placed = cut_lineage(sliced.groupBy("profile_id", "slice").cogroup(copies.groupBy("profile_id", "slice_p")).applyInArrow(
        _nearest_pivot(eps), f"profile_id long, key string, weight double, embedding {kind}, pivot int, distance double"))
    ring = F.floor(F.col("distance") * (RINGS / 2)).cast("int").alias("_ring")
    counts = placed.groupBy("profile_id", "pivot", ring).agg(F.count("*").alias("_n"))
    # neighbouring rings share a cell until it is full; at most RINGS + 1 rows a pivot
    inner = Window.partitionBy("profile_id", "pivot").orderBy("_ring").rowsBetween(Window.unboundedPreceding, -1)
    numbers = cut_lineage(counts.withColumn("_cell", F.floor(F.coalesce(F.sum("_n").over(inner), F.lit(0)) / cell_rows))
                          .withColumn("_parts", F.ceil(F.col("_n") / cell_rows)).drop("_n"))
    on = ["profile_id", "pivot", "_ring"]
    part = F.pmod(F.xxhash64("key"), F.col("_parts"))
    named = placed.withColumn("_ring", F.floor(F.col("distance") * (RINGS / 2)).cast("int")).join(numbers, on)
    named = named.withColumn("cell", F.concat_ws("/", "profile_id", "pivot", "_cell", part))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}", f"litradar_cells_{uuid.uuid4().hex}"
    packed = named.repartition(n, "cell").groupBy("cell", "profile_id", "pivot").agg(
        F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("key", "weight", "embedding"))).alias("items"))
    packed.write.bucketBy(n, "cell").sortBy("cell").option("path", path).saveAsTable(table)
    rings = spark.table(table).groupBy("profile_id", "pivot").agg(F.collect_list(F.struct("cell", "inner", "outer", "n")).alias("cells"))
    return VectorIndex(cut_lineage(pivots.join(rings, ["profile_id", "pivot"])), table)


def _bounds(k: int, eps: float, only_first: bool):
    """Cells of each candidate with the best similarity they may hold; ``first`` are the best that hold k vectors, ``place`` 0 the best."""
    types = {"profile_id": pa.int64(), "ordinal": pa.int64(), "cell": pa.string(), "bound": pa.float64(), "first": pa.bool_(), "place": pa.int32()}

    def fn(candidates: pa.Table, pivots: pa.Table) -> pa.Table:
        out = {name: [] for name in types}
        if candidates.num_rows and pivots.num_rows:
            left, ordinals = _matrix(candidates["embedding"], eps), candidates["ordinal"].to_numpy()
            owner = pivots["profile_id"].to_numpy()
            for profile in np.unique(owner):
                mine = pivots.filter(pa.array(owner == profile))
                right = _matrix(mine["embedding"], eps)
                lists = mine["cells"].to_pylist()
                at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                cells = [c for x in lists for c in x]
                names = np.array([c["cell"] for c in cells], dtype=object)
                low, high, size = (np.array([c[f] for c in cells]) for f in ("inner", "outer", "n"))
                for begin in range(0, len(left), _BOUND_ROWS):
                    some = left[begin : begin + _BOUND_ROWS]
                    square = (some**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * (some @ right.T)
                    bound = _bound(np.sqrt(np.maximum(square, 0))[:, at], low, high)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    first = np.cumsum(size[order], axis=1) - size[order] < k
                    row, place = np.nonzero(first if only_first else np.ones_like(first))
                    out["profile_id"].append(np.full(len(row), profile))
                    out["ordinal"].append(ordinals[begin + row])
                    out["cell"].append(names[order[row, place]])
                    out["bound"].append(bound[row, order[row, place]])
                    out["first"].append(first[row, place])
                    out["place"].append(place)
        return pa.table({x: pa.array(np.concatenate(v) if v else [], type=types[x]) for x, v in out.items()})

    return fn


def _bound(distance: np.ndarray, inner: np.ndarray | float, outer: np.ndarray | float) -> np.ndarray:
    """The best similarity that a ring may hold for a candidate at this distance from its pivot."""
    gap = np.maximum(np.maximum(distance - outer, inner - distance) - _SLACK, 0)
    return 1 - gap**2 / 2


def _best_of_cell(k: int, eps: float):
    names = ("profile_id", "ordinal", "key", "weight", "sim")
    types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())

    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, items = (pa.table(batch.column(c).slice(i, 1).flatten().flatten(), names=list(f)) for c, f in
                                (("asked", ("ordinal", "embedding")), ("items", ("key", "weight", "embedding"))))
                sims = _matrix(asked["embedding"], eps) @ _matrix(items["embedding"], eps).T
                best = _top(np.round(sims, _DIGITS), min(k, items.num_rows))
                rows, width = best.shape
                flat = pa.array(best.ravel())
                columns = [pa.array(np.full(rows * width, batch.column("profile_id")[i].as_py())), pa.array(np.repeat(asked["ordinal"].to_numpy(), width)),
                           items["key"].take(flat), items["weight"].take(flat), pa.array(np.take_along_axis(sims, best, axis=1).ravel())]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return fn


def _search(candidates: DataFrame, visits: DataFrame, index: VectorIndex, k: int, eps: float) -> DataFrame:
    """The k best of each visited cell. Candidates go to the buckets of their cells, in groups of bounded size."""
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_parts"))
    grouped = visits.select("ordinal", "cell").join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("ordinal"), F.col("_parts")))
    asked = grouped.join(candidates, "ordinal").groupBy("cell", "_part").agg(F.collect_list(F.struct("ordinal", "embedding")).alias("asked"))
    met = asked.join(index.cells.select("cell", "profile_id", "items").hint("merge"), "cell").select("profile_id", "asked", "items")
    return met.mapInArrow(_best_of_cell(k, eps), "profile_id long, ordinal long, key string, weight double, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("profile_id", "ordinal").orderBy(F.desc(F.round("sim", _DIGITS)), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(candidates: DataFrame, index: VectorIndex, k: int, eps: float, wanted: DataFrame | None, only_first: bool) -> DataFrame:
    spark = candidates.sparkSession
    blocks = max(1, spark.sparkContext.defaultParallelism)
    left = candidates.select("ordinal", "embedding", F.pmod(F.xxhash64("ordinal"), F.lit(blocks)).alias("lb_c"))
    # a profile's pivots are at most MOST_PIVOTS rows; a group is the pivots of some profiles and a share of the candidates
    homes = index.pivots.withColumn("rb", F.pmod(F.xxhash64("profile_id"), F.lit(blocks)))
    wanted_blocks = homes.select(F.col("rb").alias("rb_c")).distinct()
    if wanted is None:
        left = left.withColumn("rb_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(wanted_blocks), "rb_c", "left_semi")
    else:
        asked = wanted.select(F.col("ordinal").cast("long").alias("ordinal"), F.pmod(F.xxhash64(F.col("profile_id").cast("long")), F.lit(blocks)).alias("rb_c"))
        left = left.join(asked.distinct(), "ordinal").join(F.broadcast(wanted_blocks), "rb_c", "left_semi")
    right = homes.withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = left.select(F.col("lb_c").cast("long").alias("lb_c"), F.col("rb_c").cast("long").alias("rb_c"), "ordinal", "embedding")
    right = right.select(F.col("lb").cast("long").alias("lb"), F.col("rb").cast("long").alias("rb"), "profile_id", "pivot", "embedding", "cells")
    visits = left.groupBy("lb_c", "rb_c").cogroup(right.groupBy("lb", "rb")).applyInArrow(
        _bounds(k, eps, only_first), "profile_id long, ordinal long, cell string, bound double, first boolean, place int")
    if wanted is not None:
        pair = wanted.select(F.col("profile_id").cast("long").alias("profile_id"), F.col("ordinal").cast("long").alias("ordinal"))
        visits = visits.join(pair, ["profile_id", "ordinal"], "left_semi")
    return visits


def cell_visits(candidates: DataFrame, index: VectorIndex, k: int, eps: float = 1e-12, wanted: DataFrame | None = None) -> DataFrame:
    """All cells of each candidate's profiles in narrow rows: ``profile_id, ordinal, cell, bound, first``. No vector of a cell is read.

    As many rows as candidates times cells; they are not stored.
    """
    return _visits(candidates, index, k, eps, wanted, only_first=False).drop("place")


def _ranges(eps: float):
    """Of each group the least and the greatest distance to each pivot of its profile, and the least sure similarity."""

    def fn(batches):
        for batch in batches:
            low, high, least = [], [], []
            for i in range(batch.num_rows):
                asked, pivots = (pa.table(batch.column(c).slice(i, 1).flatten().flatten(), names=list(f)) for c, f in
                                 (("asked", ("ordinal", "embedding", "sure")), ("pivots", ("pivot", "embedding"))))
                left, right, number = _matrix(asked["embedding"], eps), _matrix(pivots["embedding"], eps), pivots["pivot"].to_numpy()
                distance = np.stack([np.linalg.norm(left - p, axis=1) for p in right], axis=1)
                near, far = np.zeros(number.max()), np.full(number.max(), 4.0)
                # a distance that is no number reaches everything
                near[number - 1], far[number - 1] = np.nan_to_num(distance, nan=0.0).min(axis=0), np.nan_to_num(distance, nan=4.0).max(axis=0)
                sure = asked["sure"].to_numpy()
                low.append(near)
                high.append(far)
                least.append(np.nan_to_num(sure.astype(np.float64), nan=-2.0).min())
            doubles = pa.list_(pa.float64())
            columns = [*batch.columns, pa.array(low, doubles), pa.array(high, doubles), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "low", "high", "least"])

    return fn


class _Group:
    """The best of some cells for a group of candidates. What cannot be among the k best of a candidate any more is not kept."""

    def __init__(self, name: str, profile: int, asked: pa.Table, pivots: pa.Table, k: int, eps: float):
        self.name, self.profile, self.k, self.eps = name, profile, k, eps
        self.ordinals, self.left = asked["ordinal"].to_numpy(), _matrix(asked["embedding"], eps)
        self.pivots = dict(zip(pivots["pivot"].to_pylist(), _matrix(pivots["embedding"], eps), strict=True))
        sure = asked["sure"].to_numpy().astype(np.float64)
        self.floor = np.where(np.isnan(sure), -np.inf, sure)
        self.best = np.full((len(self.left), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def meet(self, pivot: int, inner: float, outer: float, items: pa.Table) -> None:
        bound = _bound(np.linalg.norm(self.left - self.pivots[pivot], axis=1), inner, outer)
        reached = np.flatnonzero(~(bound + _SLACK < self.floor))
        right = _matrix(items["embedding"], self.eps).T if len(reached) else None
        for at in range(0, len(reached), _SCORE_ROWS):
            rows = reached[at : at + _SCORE_ROWS]
            sims = self.left[rows] @ right
            # no number counts as the greatest one, as in an order of Spark
            where, cols = np.nonzero(~(sims < (self.floor[rows] - 2 * 10.0**-_DIGITS)[:, None]))
            if len(where) > 16 * self.k * len(rows):
                cols = _top(np.round(np.where(np.isnan(sims), np.inf, sims), _DIGITS), self.k)
                where, cols = np.repeat(np.arange(len(rows)), cols.shape[1]), cols.ravel()
            if not len(where):
                continue
            found = sims[where, cols]
            value = np.where(np.isnan(found), np.inf, found)
            order = np.lexsort((cols, -np.round(value, _DIGITS), where))
            where, cols, found, value = where[order], cols[order], found[order], value[order]
            nth = np.arange(len(where)) - np.searchsorted(where, where)
            kept = nth < self.k
            where, cols, found, value, nth = where[kept], cols[kept], found[kept], value[kept], nth[kept]
            new = np.full((len(rows), self.k), -np.inf)
            new[where, nth] = value
            best = np.concatenate([self.best[rows], new], axis=1)
            self.best[rows] = np.partition(best, self.k, axis=1)[:, self.k :]
            self.floor[rows] = np.maximum(self.floor[rows], self.best[rows].min(axis=1))
            some = pa.array(cols)
            self.found.append((rows[where], found, *(items[c].combine_chunks().take(some) for c in ("key", "weight"))))

    def rows(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        at, sims = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        keys, weights = (pa.concat_arrays([f[i] for f in self.found]) for i in (2, 3))
        kept = np.flatnonzero(~(sims < self.floor[at] - 2 * 10.0**-_DIGITS))
        columns = [pa.array(np.full(len(kept), self.profile)), pa.array(self.ordinals[at[kept]]), keys.take(pa.array(kept)), weights.take(pa.array(kept)), pa.array(sims[kept])]
        types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=["profile_id", "ordinal", "key", "weight", "sim"])


def _best_of_cells(k: int, eps: float):
    """The cells that a group meets in a task come one after the other."""

    def part(batch, column, i, names):
        return pa.table(batch.column(column).slice(i, 1).flatten().flatten(), names=names)

    def fn(batches):
        group = None
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("group")[i].as_py()
                if group is None or group.name != name:
                    if group is not None and (rows := group.rows()) is not None:
                        yield rows
                    group = _Group(name, batch.column("profile_id")[i].as_py(), part(batch, "asked", i, ["ordinal", "embedding", "sure"]),
                                   part(batch, "pivots", i, ["pivot", "embedding"]), k, eps)
                group.meet(*(batch.column(c)[i].as_py() for c in ("pivot", "inner", "outer")), part(batch, "items", i, ["key", "weight", "embedding"]))
        if group is not None and (rows := group.rows()) is not None:
            yield rows

    return fn


def _groups(asked: DataFrame, home: DataFrame, sure: DataFrame, index: VectorIndex, eps: float) -> DataFrame:
    """Candidates with the same best cell, at most about ``GROUP_ROWS`` in a row, with their ranges of distances."""
    parts = home.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_parts"))
    rows = home.join(sure, ["profile_id", "ordinal"], "left").join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("ordinal"), F.col("_parts")))
    rows = rows.join(asked, "ordinal").groupBy("profile_id", "cell", "_part").agg(F.collect_list(F.struct("ordinal", "embedding", F.col("_sure").alias("sure"))).alias("asked"))
    pivots = index.pivots.groupBy("profile_id").agg(F.collect_list(F.struct("pivot", "embedding")).alias("pivots"))
    rows = rows.withColumn("group", F.concat_ws("/", "cell", "_part")).join(pivots, "profile_id").select("profile_id", "group", "asked", "pivots")
    kind = asked.schema["embedding"].dataType.simpleString()
    lib = index.pivots.schema["embedding"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(_ranges(eps), f"profile_id long, group string, asked array<struct<ordinal:bigint,embedding:{kind},sure:double>>, "
                                       f"pivots array<struct<pivot:int,embedding:{lib}>>, low array<double>, high array<double>, least double"))


def _met(groups: DataFrame, index: VectorIndex) -> DataFrame:
    """Each group with the cells whose bound reaches it. Cells are copied once for a lane of groups (one a core), groups once for ``SIDE_VALUES`` of cells."""
    held = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    # one number comes to the driver
    values = index.pivots.agg(F.sum(held * F.size("embedding"))).first()[0] or 0
    lanes, parts = max(1, index.pivots.sparkSession.sparkContext.defaultParallelism), max(1, math.ceil(values / SIDE_VALUES))
    g = groups.select("*", F.pmod(F.xxhash64("group"), F.lit(lanes)).alias("lane"), _each(parts).alias("side")).alias("g")
    c = index.cells.select("*", _each(lanes).alias("lane"), F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("side")).alias("c")
    number = F.col("c.pivot") - 1
    gap = F.greatest(F.get("g.low", number) - F.col("c.outer"), F.col("c.inner") - F.get("g.high", number), F.lit(0.0))
    gap = F.greatest(gap - 2 * _SLACK, F.lit(0.0))
    reaches = 1 - gap * gap / 2 + 2 * _SLACK >= F.col("g.least")
    same = [F.col(f"g.{x}") == F.col(f"c.{x}") for x in ("profile_id", "lane", "side")]
    met = g.join(c, [*same, reaches])
    return met.select("g.profile_id", "g.group", "g.asked", "g.pivots", "c.pivot", "c.inner", "c.outer", "c.items")


def indexed_knn(candidates: DataFrame, index: VectorIndex, k: int = 5, eps: float = 1e-12, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``knn_join`` from a stored index, and the visits ``profile_id, ordinal, cell, bound, first, visited``.

    The cells with the best bounds that hold k vectors are searched first; their k-th similarity is sure, and only cells
    whose bound reaches it are searched for the result. The visits are found when they are asked for; a cell of theirs
    is skipped, too, when better ones were found before it. Candidates without a vector are left out.
    """
    asked = cut_lineage(candidates.where("embedding IS NOT NULL").select(F.col("ordinal").cast("long").alias("ordinal"), "embedding"))
    first = cut_lineage(_visits(asked, index, k, eps, wanted, only_first=True).select("profile_id", "ordinal", "cell", "place"))
    pair = ["profile_id", "ordinal"]
    best = _ranked(_search(asked, first, index, k, eps), k)
    sure = cut_lineage(best.groupBy(*pair).agg(F.when(F.count("*") >= k, F.min("sim")).alias("_sure")))
    groups = _groups(asked, first.where("place = 0").drop("place"), sure, index, eps)
    found = _met(groups, index).mapInArrow(_best_of_cells(k, eps), "profile_id long, ordinal long, key string, weight double, sim double")
    reaches = F.col("_sure").isNull() | (F.col("bound") + _SLACK >= F.col("_sure"))
    told = cell_visits(asked, index, k, eps, wanted).join(sure, pair, "left").withColumn("visited", F.col("first") | reaches).drop("_sure")
    return _ranked(found, k), told


def visited_share(visits: DataFrame) -> DataFrame:
    """Per profile: pairs of candidate and cell, and how many of them were searched."""
    return visits.groupBy("profile_id").agg(F.count("*").alias("pairs"), F.sum(F.col("visited").cast("long")).alias("visited"))


def drop_index(spark: SparkSession, index: VectorIndex) -> None:
    """Forget the table; its files stay in the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {index.table}")
