"""Build the research profile of every library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, embedding_text
from ..models.providers import Embedder, encode_texts
from ..operators.clusters import centroids, cluster_keywords, cluster_stats, profile_summary, renumber_clusters, representative_items, weighted_items
from ..operators.filters import with_library_abstract
from ..operators.joins import embedding_hits, embedding_misses
from ..operators.kmeans import choose_cluster_counts, fit_assign
from ..params import Clustering, Decay
from ..session import cut_lineage
from ..sources.stores import invalidate, with_expiry


def texts_to_encode(items: DataFrame) -> DataFrame:
    text = embedding_text(F.col("title"), F.col("abstract"))
    return items.withColumn("text", text).withColumn("content_hash", content_hash(F.col("text")))


def embed_items(items: DataFrame, store: DataFrame, embedder: Embedder, as_of, source_type: str, ttl_days: int | None) -> tuple[DataFrame, DataFrame]:
    """Items with vectors, and the new store rows. Only texts the store lacks are encoded.

    The new rows are materialised before use, so a later failure does not encode them again.
    """
    texts = texts_to_encode(items)
    misses = embedding_misses(texts, store, embedder.name, as_of)
    fresh = cut_lineage(encode_texts(misses, embedder))
    new_rows = with_expiry(fresh.withColumn("model", F.lit(embedder.name)).withColumn("source_type", F.lit(source_type)), as_of, ttl_days)
    hits = embedding_hits(texts, store, embedder.name, as_of).withColumnRenamed("embedding", "_stored")
    vectors = hits.join(fresh.withColumnRenamed("embedding", "_fresh"), "content_hash", "left")
    return vectors.withColumn("embedding", F.coalesce("_stored", "_fresh")).drop("_stored", "_fresh", "text"), new_rows


def describe_clusters(library: DataFrame, tags: DataFrame, as_of, p: Clustering = Clustering(), decay: Decay = Decay()) -> dict[str, DataFrame]:
    """Statistics, centroids, keywords and representative items of a library with cluster ids."""
    items = weighted_items(library, as_of, decay)
    cents = centroids(items)
    stats = cluster_stats(items, cents, p)
    return {
        "clusters": renumber_clusters(stats, p.min_cluster_size),
        "centroids": cents,
        "keywords": cluster_keywords(library.select("profile_id", "cluster_id", "key"), tags, p.keywords_per_cluster),
        "representatives": representative_items(items, cents, p.titles_per_cluster),
        "summary": profile_summary(stats, items, p.min_cluster_size),
    }


def cluster_library(library: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """Attach fitted cluster ids."""
    assigned = fit_assign(library, choose_cluster_counts(library, p), p)
    return library.join(assigned, ["profile_id", "key"])


def build_profile(items: DataFrame, tags: DataFrame, store: DataFrame, embedder: Embedder, as_of, p: Clustering = Clustering(), decay: Decay = Decay(),
                  full: bool = False) -> dict[str, DataFrame]:
    """From library items to described clusters; items without an abstract are left out.

    A full build drops the stored profile vectors first and encodes everything again.
    """
    if full:
        store = invalidate(store, F.col("source_type") == "profile")
    usable = with_library_abstract(items)
    vectors, new_rows = embed_items(usable, store, embedder, as_of, "profile", None)
    library = cut_lineage(cluster_library(cut_lineage(vectors.select("profile_id", "key", "embedding", "date_added")), p))
    return {"library": library, "new_embeddings": new_rows, **describe_clusters(library, tags, as_of, p, decay)}
