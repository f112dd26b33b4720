"""Equi-joins of works with stores and lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import journal_score
from ..params import JournalScores
from ..session import cut_lineage
from .filters import abstract_route, unexpired
from .skew import never_null, skew_join


def journal_scores(works: DataFrame, issns: DataFrame, journals: DataFrame, p: JournalScores = JournalScores()) -> DataFrame:
    """Journal score of each work: arXiv constant, else the first usable ISSN, else unknown.

    ``works(ordinal, source)``, ``issns(ordinal, pos, issn)``, ``journals(issn, impact_factor, is_cn)``.
    """
    usable = journals.select("issn", "impact_factor", "is_cn", journal_score(F.col("impact_factor"), F.col("is_cn"), p).alias("listed"))
    found = issns.join(usable.where("listed IS NOT NULL"), "issn")
    first = found.groupBy("ordinal").agg(F.min_by(F.struct("listed", "impact_factor", "is_cn"), "pos").alias("j"))
    arxiv = F.col("source") == "arxiv"
    return works.select("ordinal", "source").join(first, "ordinal", "left").select(
        "ordinal",
        F.when(arxiv, F.lit(p.arxiv)).otherwise(F.coalesce("j.listed", F.lit(p.unknown))).alias("journal_score"),
        F.when(~arxiv & ~F.coalesce("j.is_cn", F.lit(False)), F.col("j.impact_factor")).alias("impact_factor"),
        (~arxiv & F.coalesce("j.is_cn", F.lit(False))).alias("is_cn_core"),
    )


def embedding_hits(texts: DataFrame, store: DataFrame, model: str, as_of) -> DataFrame:
    """Attach stored vectors by content hash; ``is_hit`` tells where there is one."""
    live = store.where((F.col("model") == model) & unexpired(as_of)).select("content_hash", "embedding", F.lit(True).alias("_hit"))
    # copies of one text share a hash
    rows = [c for c, t in texts.dtypes if not t.startswith("map")]
    return skew_join(texts, live, ["content_hash"], "left", rows).withColumn("is_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def embedding_misses(texts: DataFrame, store: DataFrame, model: str, as_of) -> DataFrame:
    """Distinct texts that have to be encoded.

    The hashes are compared with the store first, without their texts; the whole texts are shuffled only if many of them are missing.
    """
    live = store.where((F.col("model") == model) & unexpired(as_of)).select("content_hash")
    hashes = texts.select("content_hash").distinct().join(live, "content_hash", "left_anti")
    # a missing hash is a key, too
    keyed = [F.coalesce("content_hash", F.lit("")).alias("_h"), F.col("content_hash").isNull().alias("_null")]
    wanted = cut_lineage(hashes.select(*keyed))
    missing = texts.select("content_hash", "text", *keyed).join(wanted, ["_h", "_null"], "left_semi")
    return missing.groupBy("_h", "_null").agg(F.min("content_hash").alias("content_hash"), F.min("text").alias("text")).drop("_h", "_null")


def fill_abstracts(works: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fill missing abstracts by DOI; own text stays, a fresh extraction beats the store.

    Adds ``route`` and ``abstract_from`` (own, fresh, cache or null).
    """
    c = cached.select(F.lower("doi").alias("_doi"), F.col("abstract").alias("_cached")).where("_cached <> ''")
    f = fresh.select(F.lower("doi").alias("_doi"), F.col("abstract").alias("_fresh")).where("_fresh <> ''")
    rows = [name for name, t in works.dtypes if not t.startswith("map")]
    wanted = F.when(F.col("route") == "needs_abstract", F.lower("doi"))
    routed = works.withColumn("route", abstract_route()).withColumn("_doi", never_null(wanted, *rows))
    joined = routed.join(c, "_doi", "left").join(f, "_doi", "left")
    own = F.col("route") == "has_abstract"
    return joined.withColumn(
        "abstract_from",
        F.when(own, "own").when(F.col("_fresh").isNotNull(), "fresh").when(F.col("_cached").isNotNull(), "cache"),
    ).withColumn("abstract", F.when(own, F.col("abstract")).otherwise(F.coalesce("_fresh", "_cached", "abstract"))).drop("_doi", "_cached", "_fresh")


def merged_abstracts(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both sources by DOI, fresh wins."""
    c = cached.select(F.lower("doi").alias("doi"), F.col("abstract").alias("_cached"))
    f = fresh.select(F.lower("doi").alias("doi"), F.col("abstract").alias("_fresh"))
    return c.join(f, "doi", "full").select("doi", F.coalesce("_fresh", "_cached").alias("abstract"))


def attach_store(works: DataFrame, store: DataFrame, on: str = "identifier") -> DataFrame:
    """Left join of a keyed store; works without an entry keep nulls."""
    return works.join(store, on, "left")


def missing_from_store(works: DataFrame, store: DataFrame, on: str = "identifier") -> DataFrame:
    return works.join(store.select(on), on, "left_anti")


def hash_changes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """new / changed / same / gone per key by content hash."""
    keys = ["profile_id", "key"]
    old = current.select(*keys, F.col("content_hash").alias("old_hash"), F.lit(True).alias("_old"))
    new = incoming.select(*keys, F.col("content_hash").alias("new_hash"), F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    )
    return old.join(new, keys, "full").select(*keys, status.alias("status"))


def rebuild_decision(profiles: DataFrame, state: DataFrame, signature: str) -> DataFrame:
    """Which profiles need a rebuild: artifacts missing or made with another embedding signature.

    ``profiles(profile_id, has_artifacts)``, ``state(profile_id, key, value)``.
    """
    stored = state.where("key = 'embedding_signature'").select("profile_id", F.col("value").alias("stored_signature"))
    return profiles.join(stored, "profile_id", "left").withColumn(
        "rebuild", ~F.col("has_artifacts") | ~F.col("stored_signature").eqNullSafe(F.lit(signature))
    )


def with_weights(items: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight by key, 1 where there is none."""
    w = weights.select("profile_id", "key", F.col("weight").alias("_w"))
    return items.join(w, ["profile_id", "key"], "left").withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_w")


def fill_gaps(counts: DataFrame, calendar: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every calendar row, zero where nothing was counted."""
    return calendar.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long"))


def union_works(ranked: DataFrame, interest: DataFrame) -> DataFrame:
    """Works of both sections, each identifier once per profile (the ranked one wins)."""
    both = ranked.withColumn("_section", F.lit(0)).unionByName(interest.withColumn("_section", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("profile_id", "identifier").orderBy("_section", "ordinal")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_section")
