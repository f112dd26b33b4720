"""Hot keys are cut into parts without changing a result."""

import pytest
from pyspark.sql import functions as F

from litradar.operators import dedupe, joins
from litradar.operators.skew import hot_keys, never_null, skew_join, with_slices


def uneven(spark, n=3000):
    """A third of the rows share one key."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_skew_join_equals_plain_join(spark, how):
    left = uneven(spark)
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = {tuple(r) for r in left.join(right, ["k"], how).collect()}
    cut = {tuple(r) for r in skew_join(left, right, ["k"], how, ["id"], hot_rows=50).collect()}
    assert plain == cut and plain


def test_hot_keys_and_slices(spark):
    rows = uneven(spark)
    assert [tuple(r) for r in hot_keys(rows, ["k"], 100).collect()] == [(0, 10)]
    sizes = [r["count"] for r in with_slices(rows, ["k"], "id", 100).groupBy("k", "slice").count().collect()]
    assert max(sizes) < 160 and sum(sizes) == 3000


def test_missing_keys_are_spread(spark):
    rows = spark.range(1000).withColumn("k", F.lit(None).cast("string"))
    assert rows.select(never_null(F.col("k"), "id").alias("k")).distinct().count() == 1000


def test_titles_with_a_hot_token(spark, monkeypatch):
    keys = [f"the w{i}" for i in range(200)] + ["the"]
    frame = spark.createDataFrame([(k,) for k in keys], "tkey string")
    want = {tuple(r) for r in dedupe.overlapping_titles(frame, frame).collect()}
    monkeypatch.setattr(dedupe, "HOT_ROWS", 20)
    got = {tuple(r) for r in dedupe.overlapping_titles(frame, frame).collect()}
    assert got == want and ("the", "the w7") in got and len(got) == 201 + 2 * 200


def test_copies_of_one_text_find_their_vector(spark):
    texts = uneven(spark).select("id", F.col("k").cast("string").alias("content_hash"))
    store = spark.createDataFrame([("0", "m", [1.0], None)], "content_hash string, model string, embedding array<float>, expires_at timestamp")
    assert joins.embedding_hits(texts, store, "m", "2024-01-01 00:00:00").where("is_hit").count() == 1000
