"""Order scans, caps and thresholds against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litradar.operators import ranking as rk
from litradar.operators.scan import chunked, row_numbers
from litradar.params import Fusion, Thresholds

SCHEMA = "profile_id long, ordinal long, source string, score double"


def cap_loop(rows, ratio):
    if ratio <= 0:
        return [r[1] for r in rows]
    kept, preprints = [], 0
    for row in sorted(rows, key=lambda r: (-r[3], r[1])):
        if row[2].lower() in ("arxiv", "biorxiv", "medrxiv"):
            if (preprints + 1) / (len(kept) + 1) > ratio:
                continue
            preprints += 1
        kept.append(row[1])
    return kept


def make(seed, n, share=0.7, profile=0):
    rng = random.Random(seed)
    return [(profile, i, rng.choice(["arXiv", "bioRxiv", "medrxiv"]) if rng.random() < share else "crossref", round(rng.random(), 2)) for i in range(n)]


@pytest.mark.parametrize("ratio", [0.0, 0.1, 1 / 3, 0.5, 0.7, 0.9, 1.0, 1.5])
def test_preprint_cap(spark, ratio):
    rows = make(1, 120, 0.8, 0) + make(2, 40, 1.0, 1) + make(3, 60, 0.3, 2) + make(4, 1, 1.0, 3)
    ordered = rk.order_by_score(spark.createDataFrame(rows, SCHEMA))
    got = rk.limit_preprints(ordered, ratio).groupBy("profile_id").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).collect()
    by_profile = {r.profile_id: r.o for r in got}
    for p in range(4):
        assert by_profile.get(p, []) == sorted(cap_loop([r for r in rows if r[0] == p], ratio)), p


def test_cap_over_many_chunk_counts(spark):
    rows = make(5, 300, 0.75)
    frame = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 3, 50):
        ordered = chunked(frame, ["profile_id"], rk.score_order(), parts)
        assert sorted(r.ordinal for r in rk.limit_preprints(ordered, 0.6).collect()) == sorted(cap_loop(rows, 0.6))


def test_row_numbers_of_one_huge_group(spark):
    frame = spark.range(20000).select(F.lit(1).cast("long").alias("profile_id"), F.col("id").alias("ordinal"), F.lit(0.5).alias("score"))
    ordered = chunked(frame, ["profile_id"], rk.score_order(), 8)
    # equal scores still spread over all chunks, because the order is unique
    assert ordered.groupBy("_chunk").count().count() == 8
    assert row_numbers(ordered, ["profile_id"], rk.score_order(), "n").where("n <> ordinal + 1").isEmpty()


def threshold_loop(scores, p):
    if p.mode == "fixed" or len(scores) < 2:
        return p.must_read, p.consider
    must, consider = np.percentile(scores, [p.must_read_percentile, p.consider_percentile])
    must, consider = max(must, p.min_must_read), max(consider, p.min_consider)
    return (consider + 0.01 if must <= consider else must), consider


@pytest.mark.parametrize("p", [Thresholds(), Thresholds(mode="fixed"), Thresholds(min_must_read=0.3, min_consider=0.9)])
def test_thresholds(spark, p):
    groups = {0: [0.1], 1: [0.2, 0.9], 2: [0.5] * 7, 3: [round(random.Random(1).random(), 6) for _ in range(997)], 4: [random.Random(i).random() for i in range(50)]}
    rows = [(g, i, "x", s) for g, scores in groups.items() for i, s in enumerate(scores)]
    got = {r.profile_id: (r.must_read, r.consider) for r in rk.percentile_thresholds(rk.order_by_score(spark.createDataFrame(rows, SCHEMA)), p).collect()}
    for g, scores in groups.items():
        assert got[g] == pytest.approx(threshold_loop(scores, p), abs=1e-12), g


def test_labels_follow_the_score(spark):
    rows = make(8, 200)
    ordered = rk.order_by_score(spark.createDataFrame(rows, SCHEMA))
    labeled = rk.with_labels(ordered, rk.percentile_thresholds(ordered, Thresholds(min_must_read=0, min_consider=0))).collect()
    order = {"must_read": 2, "consider": 1, "ignore": 0}
    ranks = [order[r.label] for r in sorted(labeled, key=lambda r: -r.score)]
    assert ranks == sorted(ranks, reverse=True)
    total = rk.label_distribution(spark.createDataFrame(labeled)).agg(F.sum("percent")).first()[0]
    assert total == pytest.approx(100.0)


def test_top_k_prunes_before_the_shuffle(spark):
    plan = rk.top_ranked(spark.createDataFrame(make(1, 50), SCHEMA), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        Fusion(similarity_weight=0.8, journal_weight=0.3)


def test_batches(spark):
    frame = spark.range(23).select((F.col("id") % 2).alias("g"), F.col("id"))
    got = rk.numbered_batches(frame, ["g"], [F.asc("id")], 5).groupBy("g", "batch_no").count().collect()
    assert sorted((r.g, r.batch_no, r["count"]) for r in got) == [(0, 0, 5), (0, 1, 5), (0, 2, 2), (1, 0, 5), (1, 1, 5), (1, 2, 1)]
