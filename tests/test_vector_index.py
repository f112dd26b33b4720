"""The stored index against the block join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litradar.operators import vector_index
from litradar.operators.neighbors import knn_join
from litradar.operators.vector_index import _search, build_index, indexed_knn, visited_share

rng = np.random.default_rng(11)
LIBRARY = "profile_id long, key string, weight double, embedding array<float>"


def rows_of(frame):
    return {(r.profile_id, r.ordinal, r["rank"]): (r.key, r.weight, pytest.approx(r.sim, abs=1e-9)) for r in frame.collect()}


def random_library(spark, sizes, dim=8):
    rows = []
    for p, n in sizes.items():
        m = rng.normal(size=(n, dim)).astype(np.float32)
        m[: n // 5] = m[0]  # copies
        m[-1] = 0
        rows += [(p, f"{i:05d}", i % 5 / 5, m[i].tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (3, "none", 1.0, None)], LIBRARY)


def asked(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m.astype(np.float32))], "ordinal long, embedding array<float>")


def test_same_rows_as_all_pairs(spark):
    lib = random_library(spark, {1: 300, 2: 3, 7: 41})
    cand = asked(spark, np.vstack([rng.normal(size=(30, 8)), np.zeros((1, 8))]))
    want = rows_of(knn_join(cand, lib.where("embedding IS NOT NULL"), 5))
    index = build_index(lib, cell_rows=16)
    found, _ = indexed_knn(cand.unionByName(spark.createDataFrame([(99, None)], cand.schema)), index, 5)
    assert rows_of(found) == want
    # only the wanted pairs
    pairs = spark.createDataFrame([(1, 0), (7, 3), (2, 30)], "profile_id long, ordinal long")
    some, _ = indexed_knn(cand, index, 5, wanted=pairs)
    assert rows_of(some) == {k: v for k, v in want.items() if k[:2] in {(1, 0), (7, 3), (2, 30)}}


def test_clustered_vectors_are_pruned(spark):
    centres = rng.normal(size=(12, 16)) * 4
    m = (centres[np.arange(1200) % 12] + rng.normal(size=(1200, 16)) * 0.05).astype(np.float32)
    lib = spark.createDataFrame([(1, f"{i:05d}", 1.0, m[i].tolist()) for i in range(len(m))], LIBRARY)
    cand = asked(spark, centres + rng.normal(size=(12, 16)) * 0.05)
    found, visits = indexed_knn(cand, build_index(lib, cell_rows=20), 5)
    assert rows_of(found) == rows_of(knn_join(cand, lib, 5))
    [share] = visited_share(visits).collect()
    assert share.visited < share.pairs / 2


def test_library_is_not_shuffled(spark):
    lib = random_library(spark, {1: 200})
    index = build_index(lib, cell_rows=16)
    visits = spark.createDataFrame([(0, r.cell) for r in index.cells.select("cell").collect()], "ordinal long, cell string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = _search(asked(spark, rng.normal(size=(1, 8))), visits, index, 5, 1e-12)._jdf.queryExecution().explainString(mode)
    inputs = [part.split("\n")[1] for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0] and "\n" in part]
    assert inputs and not any("items#" in line for line in inputs) and "Bucketed: true" in plan


def test_empty_library_and_no_candidates(spark):
    lib, cand = random_library(spark, {1: 10}), asked(spark, rng.normal(size=(3, 8)))
    assert indexed_knn(cand, build_index(lib.limit(0)), 5)[0].count() == 0
    assert indexed_knn(cand.limit(0), build_index(lib), 5)[0].count() == 0


def test_candidates_are_copied_once_for_a_profile(spark):
    """F16: indexed_neighbors. Where all cells are searched, groups meet them in lanes and only the best of all cells leave a task."""
    lib = random_library(spark, {1: 900, 2: 60})
    cand = asked(spark, np.vstack([rng.normal(size=(60, 8)), np.zeros((1, 8))]))
    index = build_index(lib, cell_rows=16)
    first = vector_index._visits(cand, index, 5, 1e-12, None, only_first=True)
    assert index.cells.count() > 40 and first.count() < 61 * 2 * 3
    sure = first.groupBy("profile_id", "ordinal").agg(F.lit(None).cast("double").alias("_sure"))
    met = vector_index._met(vector_index._groups(cand, first.where("place = 0").drop("place"), sure, index, 1e-12), index)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    best = vector_index._best_of_cells(5, 1e-12)
    found = met.mapInArrow(best, "profile_id long, ordinal long, key string, weight double, sim double")
    want = rows_of(knn_join(cand, lib.where("embedding IS NOT NULL"), 5))
    assert rows_of(vector_index._ranked(found, 5)) == want
    # copies may tie, so there are more than the best five, but not five of each cell
    assert found.count() < 61 * 2 * 5 * index.cells.count() / 2
