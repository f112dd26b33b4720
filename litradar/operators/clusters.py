"""Cluster statistics, cluster links, k selection and spherical k-means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import Normalizer
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import age_days
from ..functions.scoring import dot, l2_normalize, temporal_weight
from ..params import Clustering, Decay
from .ranking import top_counts
from .skew import skew_join

GROUP = ["profile_id", "cluster_id"]


def with_weight(library: DataFrame, as_of, decay: Decay = Decay()) -> DataFrame:
    return library.withColumn("weight", temporal_weight(F.col("date_added"), as_of, decay))


def unit_embeddings(items: DataFrame) -> DataFrame:
    """Unit vectors by the JVM normaliser; element-wise lambdas are slow on long vectors."""
    vectors = items.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(vectors)
    return unit.withColumn("embedding", vector_to_array("_u")).drop("_v", "_u")


def weighted_items(library: DataFrame, as_of, decay: Decay = Decay()) -> DataFrame:
    """Library items with unit vectors, weight and age."""
    return unit_embeddings(with_weight(library, as_of, decay).withColumn("age_days", age_days(F.col("date_added"), as_of)))


def centroids(items: DataFrame) -> DataFrame:
    """Plain and weighted unit centroid per cluster; the plain one stands in when all weights are zero.

    The mean similarity of the members to the centroid is that of their mean, so the coherence
    comes out of the same aggregate.
    """
    v = F.col("embedding")
    # the weighted sum, not a weighted mean: it is defined when all weights are zero, too
    scaled = F.transform(v, lambda x: x * F.col("weight"))
    sums = items.groupBy(*GROUP).agg(
        Summarizer.metrics("mean").summary(array_to_vector(v)).alias("plain"),
        Summarizer.metrics("sum").summary(array_to_vector(scaled)).alias("weighted"),
        F.sum("weight").alias("effective_size"),
        F.count("*").alias("member_count"),
    )
    plain = l2_normalize(vector_to_array(F.col("plain.mean")), 1e-8)
    mean = F.transform(vector_to_array(F.col("weighted.sum")), lambda x: x / F.col("effective_size"))
    return sums.select(
        *GROUP, "member_count", "effective_size", plain.alias("centroid"), vector_to_array(F.col("plain.mean")).alias("_mean"),
        F.when(F.col("effective_size") > 0, l2_normalize(mean, 1e-8)).otherwise(plain).alias("weighted_centroid"),
    ).withColumn("coherence", dot(F.col("_mean"), F.col("centroid"))).drop("_mean")


def with_centroid_similarity(items: DataFrame, cluster_centroids: DataFrame) -> DataFrame:
    """Attach the similarity of each item to its own centroid."""
    return skew_join(items, cluster_centroids.select(*GROUP, "centroid"), GROUP, "inner", ["key"]).withColumn(
        "centroid_similarity", dot(F.col("embedding"), F.col("centroid"))
    ).drop("centroid")


def cluster_stats(items: DataFrame, cluster_centroids: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """One row per cluster: sizes, coherence and age figures."""
    ages = items.groupBy(*GROUP).agg(
        F.count("*").alias("member_count"),
        F.sum("weight").alias("effective_size"),
        F.avg("age_days").alias("mean_item_age_days"),
        F.floor(F.max("age_days") - F.min("age_days")).cast("long").alias("temporal_span_days"),
        (F.count_if(F.col("age_days") <= p.recent_age_days) / F.count("*")).alias("recent_ratio"),
    )
    return ages.join(cluster_centroids.select(*GROUP, "coherence"), GROUP)


def representative_items(items: DataFrame, cluster_centroids: DataFrame, n: int = 5) -> DataFrame:
    """The n members nearest their centroid (ties by key)."""
    scored = with_centroid_similarity(items, cluster_centroids)
    nearest = Window.partitionBy(*GROUP).orderBy(F.desc(F.round("centroid_similarity", 9)), "key")
    return scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= n)


def cluster_keywords(assignment: DataFrame, tags: DataFrame, n: int = 10) -> DataFrame:
    """Top tags of the members: ``assignment(profile_id, cluster_id, key)`` with ``tags(key, tag)``."""
    counted = assignment.join(tags, "key").groupBy(*GROUP, "tag").agg(F.count("*").alias("tag_count"))
    return top_counts(counted, GROUP, "tag_count", "tag", n)


def profile_summary(stats: DataFrame, items: DataFrame, min_size: int = 1) -> DataFrame:
    """Totals per profile over the clusters that are large enough, and the date range of all items."""
    valid = F.col("member_count") >= min_size
    totals = stats.groupBy("profile_id").agg(
        F.count_if(valid).alias("valid_cluster_count"),
        F.sum(F.when(valid, F.col("member_count")).otherwise(0)).alias("papers_in_valid_clusters"),
        F.sum(F.when(valid, F.col("effective_size")).otherwise(0.0)).alias("total_effective_size"),
    )
    ranges = items.groupBy("profile_id").agg(
        F.count("*").alias("total_papers"), F.min("date_added").alias("first_added"), F.max("date_added").alias("last_added")
    )
    return ranges.join(totals, "profile_id", "left")


def renumber_clusters(stats: DataFrame, min_size: int = 1) -> DataFrame:
    """New ids by size, largest first, after small clusters are dropped. At most a few dozen rows per profile."""
    by_size = Window.partitionBy("profile_id").orderBy(F.desc("member_count"), "cluster_id")
    return stats.where(F.col("member_count") >= min_size).withColumn("new_cluster_id", F.row_number().over(by_size).cast("long") - 1)


def cluster_links(clusters: DataFrame, threshold: float = 0.5, max_neighbors: int = 2) -> DataFrame:
    """Undirected links to the closest clusters of the same profile.

    A profile has at most a few dozen clusters, so the self join is bounded per profile.
    """
    unit = clusters.select("profile_id", "cluster_id", l2_normalize(F.col("centroid"), 0.0).alias("v"))
    other = unit.select("profile_id", F.col("cluster_id").alias("other_id"), F.col("v").alias("w"))
    pairs = unit.join(other, "profile_id").where("cluster_id <> other_id").select(
        "profile_id", "cluster_id", "other_id", dot(F.col("v"), F.col("w")).alias("value")
    )
    nearest = Window.partitionBy("profile_id", "cluster_id").orderBy(F.desc(F.round("value", 9)), "other_id")
    kept = pairs.where(F.col("value") > threshold).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= max_neighbors)
    return kept.groupBy(
        "profile_id", F.least("cluster_id", "other_id").alias("source_id"), F.greatest("cluster_id", "other_id").alias("target_id")
    ).agg(F.max("value").alias("value"))


def cluster_bounds(n: Column, p: Clustering = Clustering()) -> tuple[Column, Column]:
    """Smallest and largest k to try for n items; (1, 1) where no search is made."""
    root = F.floor(F.sqrt(n)).cast("long")
    limit = F.when(n < 100, F.greatest(root, F.least(F.floor(n / 5), F.lit(8)))).otherwise(F.least(F.lit(35), root))
    high = F.least(limit, F.floor(n / 2), F.lit(p.max_clusters)).cast("long")
    low = F.greatest(F.lit(p.min_clusters), F.lit(2), F.floor(F.sqrt(n) / 3)).cast("long")
    single = (n < 5) | (high < 2)
    one = F.lit(1).cast("long")
    return F.when(single, one).otherwise(F.least(low, high)), F.when(single, one).otherwise(high)


def choose_k(scores: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """``scores(profile_id, k, silhouette)`` to the largest k within the tolerance of the best score."""
    best = scores.groupBy("profile_id").agg(F.max("silhouette").alias("best"))
    near = scores.join(best, "profile_id").where(F.col("silhouette") >= F.col("best") - F.lit(tolerance) * F.abs("best"))
    return near.groupBy("profile_id").agg(F.max("k").cast("long").alias("k"), F.max_by("silhouette", "k").alias("silhouette"))


def single_cluster(library: DataFrame) -> DataFrame:
    """Assignment of tiny profiles: everything in cluster 0."""
    return library.withColumn("cluster_id", F.lit(0).cast("long"))


def silhouettes(assigned: DataFrame) -> DataFrame:
    """Mean cosine silhouette per profile, from cluster sums only.

    The mean cosine distance of a unit vector x to a cluster is 1 - x.S/n, so one
    aggregate of cluster sums replaces all pairs. ``assigned(profile_id, key, cluster_id, embedding)``.
    """
    unit = unit_embeddings(assigned.select("profile_id", "key", "cluster_id", "embedding")).withColumnRenamed("embedding", "x")
    sums = unit.groupBy(*GROUP).agg(
        Summarizer.metrics("mean").summary(array_to_vector(F.col("x"))).alias("s"), F.count("*").alias("n")
    ).select("profile_id", F.col("cluster_id").alias("other_id"), vector_to_array(F.col("s.mean")).alias("mean"), "n")
    # rows x clusters of the profile (a few dozen at most)
    d = skew_join(unit, sums, ["profile_id"], "inner", ["key"]).select(
        "profile_id", "key", (F.col("cluster_id") == F.col("other_id")).alias("own"), "n",
        (F.lit(1.0) - dot(F.col("x"), F.col("mean"))).alias("mean_distance"),
    )
    a = F.max(F.when(F.col("own") & (F.col("n") > 1), F.col("mean_distance") * F.col("n") / (F.col("n") - 1)))
    b = F.min(F.when(~F.col("own"), F.col("mean_distance")))
    per_item = d.groupBy("profile_id", "key").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per_item.where(F.col("b").isNotNull()).groupBy("profile_id").agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))
