"""Score and rank candidates for every profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import final_score, fused_similarity
from ..operators.clusters import centroids, weighted_items, with_weight
from ..operators.joins import journal_scores
from ..operators.neighbors import cluster_scores, knn_join, macro_scores, micro_scores
from ..operators.ranking import cold_start, percentile_thresholds, with_labels
from ..params import WatchSettings
from ..session import cut_lineage


def profile_clusters(library: DataFrame, as_of, s: WatchSettings = WatchSettings()) -> DataFrame:
    """Centroids for scoring from a library with a ``cluster_id``."""
    cents = centroids(weighted_items(library, as_of, s.decay))
    return cents.select("profile_id", "cluster_id", F.col("weighted_centroid").alias("centroid"), "effective_size")


def score_candidates(candidates: DataFrame, library: DataFrame, clusters: DataFrame | None, issns: DataFrame, journals: DataFrame, as_of,
                     s: WatchSettings = WatchSettings(), wanted: DataFrame | None = None) -> DataFrame:
    """Score of every candidate for every profile with a library, or of the ``wanted(profile_id, ordinal)`` pairs.

    Only narrow columns are carried; texts are attached to the rows that survive. Without
    clusters the similarity is the plain best one. Candidates without a vector are left out; see ``with_vectors``.
    """
    vectors = candidates.where("embedding IS NOT NULL").select("ordinal", "embedding")
    items = with_weight(library.select("profile_id", "key", "date_added", "embedding"), as_of, s.decay)
    near = knn_join(vectors, items, s.fusion.neighbors, wanted=wanted)
    pair = ["profile_id", "ordinal"]
    if wanted is not None:
        near = near.join(wanted.select(*pair), pair, "left_semi")
    micro = micro_scores(near)
    if clusters is None:
        joined = micro.withColumn("macro", F.lit(None).cast("double")).withColumn("cluster_id", F.lit(None).cast("long"))
    else:
        joined = micro.join(macro_scores(cluster_scores(vectors, clusters, wanted=wanted)), ["profile_id", "ordinal"], "left")
    fused = F.col("macro").isNotNull()
    journal = journal_scores(candidates, issns, journals, s.journal)
    narrow = candidates.select("ordinal", "identifier", "source", "published").join(journal, "ordinal")
    scored = joined.join(narrow, "ordinal").withColumn(
        "similarity", F.when(fused, fused_similarity(F.col("micro"), F.col("macro"), s.fusion)).otherwise(F.col("top_similarity"))
    ).withColumn("micro", F.when(fused, F.col("micro"))).drop("top_similarity")
    return scored.withColumn("score", final_score(F.col("similarity"), F.col("journal_score"), s.fusion))


def with_thresholds(scored: DataFrame, s: WatchSettings = WatchSettings()) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and the thresholds of each profile."""
    scored = cut_lineage(scored)
    thresholds = cut_lineage(percentile_thresholds(scored, s.thresholds))
    return with_labels(scored, thresholds), thresholds


def rank_cold(candidates: DataFrame, profiles: DataFrame, library: DataFrame, issns: DataFrame, journals: DataFrame,
              s: WatchSettings = WatchSettings()) -> DataFrame:
    """Rows of profiles without any library item. ``candidates`` carry ``profile_id``."""
    empty = profiles.select("profile_id").join(library.select("profile_id").distinct(), "profile_id", "left_anti")
    waiting = candidates.join(empty, "profile_id", "left_semi")
    scores = journal_scores(waiting.select("ordinal", "source").distinct(), issns, journals, s.journal)
    return cold_start(waiting.join(scores, "ordinal"))
