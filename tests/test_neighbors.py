"""Block joins and k-means against NumPy."""

import tracemalloc

import numpy as np
import pytest

from litradar.operators import neighbors
from litradar.operators.clusters import centroids, cluster_links, silhouettes
from litradar.operators.kmeans import choose_cluster_counts, fit_assign, search_k
from litradar.operators.neighbors import cluster_scores, knn_join, macro_scores, micro_scores, similar_clusters
from litradar.params import Clustering

rng = np.random.default_rng(7)


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def library(spark, sizes, dim=8, copies=0):
    rows, matrix = [], {}
    for p, n in sizes.items():
        m = unit(rng.normal(size=(n, dim)))
        if copies:
            m[: min(copies, n)] = m[0]
        matrix[p] = m
        rows += [(p, f"{i:05d}", float((i % 5 + 1) / 5), m[i].astype(np.float32).tolist()) for i in range(n)]
        matrix[p] = m.astype(np.float32).astype(np.float64)
    return spark.createDataFrame(rows, "profile_id long, key string, weight double, embedding array<float>"), matrix


def candidates(spark, n, dim=8):
    m = rng.normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "ordinal long, embedding array<float>"), m.astype(np.float64)


@pytest.mark.parametrize("block_rows", [20000, 13])
def test_knn_equals_all_pairs(spark, block_rows):
    lib, by_profile = library(spark, {1: 60, 2: 3, 7: 25}, copies=9)
    cand, m = candidates(spark, 40)
    got = {}
    for r in knn_join(cand, lib, 5, block_rows=block_rows).collect():
        got.setdefault((r.profile_id, r.ordinal), {})[r["rank"]] = (r.key, r.sim)
    assert len(got) == 120
    for p, vectors in by_profile.items():
        sims = unit(m) @ unit(vectors).T
        for i in range(len(m)):
            order = sorted(range(len(vectors)), key=lambda j: (-round(sims[i, j], 9), j))[:5]
            found = got[p, i]
            assert [found[k + 1][0] for k in range(len(order))] == [f"{j:05d}" for j in order]
            assert [found[k + 1][1] for k in range(len(order))] == pytest.approx([sims[i, j] for j in order], abs=1e-9)


@pytest.mark.parametrize("copies", [0, 30])
def test_tiles_hold_few_scores_and_change_nothing(monkeypatch, copies):
    """A wide library is scored tile by tile: no array of all scores, the same winners and ties."""
    monkeypatch.setattr(neighbors, "_SCORE_COLUMNS", 16)
    left, right = np.round(rng.normal(size=(50, 4)), 1), np.round(rng.normal(size=(400, 4)), 1)
    right[100 : 100 + copies] = right[7]
    right[333] = np.nan
    at, sims = neighbors._top_of(left, right.T, 5, 395, 5)
    scores = left @ right.T
    for i in range(len(left)):
        want = sorted((j for j in range(5, 395) if j != 333), key=lambda j: (-round(scores[i, j], 9), j))[:5]
        assert at[i].tolist() == want
        assert sims[i] == pytest.approx(scores[i, want], abs=1e-12)


def test_scores_of_a_wide_block_stay_small():
    """Peak memory follows the tile, not the width of the block."""
    left, right = unit(rng.normal(size=(256, 8))), unit(rng.normal(size=(60_000, 8)))
    tracemalloc.start()
    neighbors._top_of(left, right.T, 0, len(right), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.7 * 256 * len(right) * 8


def test_micro_score(spark):
    rows = [(1, 0, 0.9, 1.0), (1, 0, 0.5, 0.5), (1, 1, 0.2, 0.05)]
    frame = spark.createDataFrame(rows, "profile_id long, ordinal long, sim double, weight double")
    got = {r.ordinal: r.micro for r in micro_scores(frame).collect()}
    assert got[0] == pytest.approx((0.9 + 0.25) / (1.5 + 1e-8))
    assert got[1] == pytest.approx(0.2, abs=1e-6)


def test_macro_prefers_size_times_similarity(spark):
    clusters = spark.createDataFrame(
        [(1, 0, [1.0, 0.0], 1.0), (1, 1, [0.8, 0.6], 100.0), (2, 5, [0.0, 1.0], 0.0), (2, 6, [0.0, 1.0], 0.0)],
        "profile_id long, cluster_id long, centroid array<double>, effective_size double",
    )
    cand = spark.createDataFrame([(0, [1.0, 0.0])], "ordinal long, embedding array<float>")
    scored = cluster_scores(cand, clusters).cache()
    macro = {r.profile_id: (r.cluster_id, r.macro) for r in macro_scores(scored).collect()}
    assert macro[1] == (1, pytest.approx(0.8, abs=1e-6))
    assert macro[2] == (5, 0.0)
    assert [r.cluster_id for r in similar_clusters(scored).where("profile_id = 1").orderBy("sim_rank").collect()] == [0, 1]


def test_no_pair_join_in_the_plan(spark):
    lib, _ = library(spark, {1: 30})
    cand, _ = candidates(spark, 10)
    plan = knn_join(cand, lib, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def clustered(spark, n=120, k=4, dim=6):
    centers = unit(rng.normal(size=(k, dim)))
    m = unit(centers[np.arange(n) % k] + 0.05 * rng.normal(size=(n, dim)))
    rows = [(p, f"{i:04d}", m[i].tolist()) for p in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "profile_id long, key string, embedding array<double>"), m


def test_kmeans_finds_the_groups_in_any_blocks(spark):
    items, m = clustered(spark)
    ks = spark.createDataFrame([(1, 4), (2, 1)], "profile_id long, k long")
    p = Clustering(iterations=8)
    whole = {(r.profile_id, r.key): r.cluster_id for r in fit_assign(items, ks, p).collect()}
    cut = {(r.profile_id, r.key): r.cluster_id for r in fit_assign(items, ks, p, block_rows=17).collect()}
    assert whole == cut and len(whole) == 240
    assert {c for (q, _), c in whole.items() if q == 2} == {0}
    # every item is nearest to its own centroid
    owner = np.array([whole[1, f"{i:04d}"] for i in range(120)])
    means = unit(np.array([m[owner == c].mean(axis=0) for c in np.unique(owner)]))
    assert (np.unique(owner)[np.argmax(m @ means.T, axis=1)] == owner).all()


def test_k_search_prefers_the_largest_good_k(spark):
    items, _ = clustered(spark)
    got = {r.profile_id: r.k for r in choose_cluster_counts(items, Clustering(min_clusters=2)).collect()}
    assert set(got) == {1, 2} and all(2 <= k <= 12 for k in got.values()) and got[1] == got[2]
    scores = {(r.profile_id, r.k): r.silhouette for r in search_k(items, Clustering(min_clusters=2)).collect()}
    cut = {(r.profile_id, r.k): r.silhouette for r in search_k(items, Clustering(min_clusters=2), 17).collect()}
    assert len(scores) >= 10 and scores.keys() == cut.keys() and all(cut[x] == pytest.approx(v, abs=1e-9) for x, v in scores.items())
    tiny = items.where("profile_id = 1 AND key < '0003'")
    assert [r.k for r in choose_cluster_counts(tiny).collect()] == [1]


def test_silhouette_equals_all_pairs(spark):
    m = unit(rng.normal(size=(30, 4)))
    owner = np.arange(30) % 4
    owner[0] = 9  # a single item scores 0
    rows = [(1, str(i), int(owner[i]), m[i].tolist()) for i in range(30)]
    got = silhouettes(spark.createDataFrame(rows, "profile_id long, key string, cluster_id long, embedding array<double>")).first().silhouette
    d = 1 - m @ m.T
    values = []
    for i in range(30):
        same = [j for j in range(30) if owner[j] == owner[i] and j != i]
        if not same:
            values.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, owner == c].mean() for c in set(owner) - {owner[i]})
        values.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(values), abs=1e-9)


def test_zero_weight_cluster_uses_the_plain_centroid(spark):
    rows = [(1, 0, "a", 0.0, [1.0, 0.0]), (1, 0, "b", 0.0, [0.0, 1.0])]
    got = centroids(spark.createDataFrame(rows, "profile_id long, cluster_id long, key string, weight double, embedding array<double>")).first()
    assert got.weighted_centroid == got.centroid == pytest.approx([0.5**0.5] * 2, abs=1e-6)


def test_links(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 2, [0.8, 0.3]), (1, 3, [0.0, 1.0]), (2, 0, [1.0, 0.0])]
    links = cluster_links(spark.createDataFrame(rows, "profile_id long, cluster_id long, centroid array<double>")).collect()
    assert {(r.source_id, r.target_id) for r in links} == {(0, 1), (0, 2), (1, 2)}
