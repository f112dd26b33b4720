"""The full recommendation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.providers import Embedder, Reranker
from ..operators.dedupe import dedupe
from ..operators.filters import recent, with_candidate_abstract
from ..operators.joins import fill_abstracts
from ..operators.ranking import limit_preprints, order_by_score, top_ranked
from ..operators.skew import skew_join
from ..params import WatchSettings
from ..session import cut_lineage
from .interest import select_interest_works
from .profile import embed_items
from .rank import with_thresholds, rank_cold, score_candidates


def fan_out(works: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per work and subscribed profile: ``subscriptions(profile_id, source)``.

    A source that has very many works is cut into as many parts as it needs.
    """
    return skew_join(works, subscriptions.select("profile_id", "source").distinct(), ["source"], "inner", ["ordinal"])


def with_vectors(works: DataFrame, store: DataFrame, embedder: Embedder, as_of, ttl_days: int) -> tuple[DataFrame, DataFrame]:
    """Fill missing vectors of works from the store or the encoder; also the new store rows."""
    missing = works.where("embedding IS NULL").select("ordinal", "title", "abstract")
    found, new_rows = embed_items(missing, store, embedder, as_of, "candidate", ttl_days)
    filled = works.join(found.select("ordinal", F.col("embedding").cast("array<float>").alias("_found")), "ordinal", "left")
    return filled.withColumn("embedding", F.coalesce(F.col("embedding").cast("array<float>"), "_found")).drop("_found"), new_rows


def _cut(labeled: DataFrame, as_of, s: WatchSettings, score: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows after the recency filter, after the preprint cap, and the list."""
    fresh = order_by_score(recent(labeled, as_of, s.limits.recent_days), score)
    capped = limit_preprints(fresh, s.limits.max_preprint_ratio, score)
    return fresh, capped, top_ranked(capped, s.limits.top_k, score) if s.limits.top_k else capped


def watch(candidates: DataFrame, library: DataFrame, known_works: DataFrame, subscriptions: DataFrame, clusters: DataFrame | None,
          issns: DataFrame, journals: DataFrame, as_of, s: WatchSettings = WatchSettings(), cached: DataFrame | None = None,
          fresh: DataFrame | None = None, store: DataFrame | None = None, embedder: Embedder | None = None, interests: DataFrame | None = None,
          reranker: Reranker | None = None) -> dict[str, DataFrame]:
    """Enrich, dedupe, rank, cut. Returns the recommendations, thresholds and funnel counts.

    ``candidates(ordinal, identifier, source, title, abstract, doi, published, embedding)``,
    ``library(profile_id, key, embedding, date_added)`` for scoring and
    ``known_works(profile_id, title, doi, url)`` for the dedupe. Candidates without a vector get one from ``store`` and
    ``embedder`` where these are given (new rows in ``new_embeddings``). Profiles without library items get a
    repeatable shuffle. With ``interests(profile_id, refined_query, exclude_keywords)`` the kept works are also
    selected by interest, as ``interest``.
    """
    out: dict[str, DataFrame] = {}
    works = candidates
    if cached is not None and fresh is not None:
        works = fill_abstracts(works, cached, fresh)
    if store is not None and embedder is not None:
        works, out["new_embeddings"] = with_vectors(works, store, embedder, as_of, s.candidate_ttl_days)
        works = cut_lineage(works)
    offered = fan_out(works.select("ordinal", "identifier", "source", "title", "doi", F.coalesce(F.col("abstract") != "", F.lit(False)).alias("has_abstract")), subscriptions)
    kept = cut_lineage(dedupe(offered, known_works, s.title_threshold).select("profile_id", "ordinal", "has_abstract"))
    usable = (kept.where("has_abstract") if s.limits.require_abstract else kept).select("profile_id", "ordinal")
    pool = with_candidate_abstract(works) if s.limits.require_abstract else works

    scored = score_candidates(pool, library, clusters, issns, journals, as_of, s, usable)
    labeled, thresholds = with_thresholds(scored, s)
    fresh_rows, capped, final = _cut(labeled, as_of, s, "score")

    # profiles without a library: the shuffle takes the place of the score order
    waiting = cut_lineage(usable.join(library.select("profile_id").distinct(), "profile_id", "left_anti"))
    if not waiting.isEmpty():
        unseen = waiting.join(works.select("ordinal", "identifier", "source", "published"), "ordinal")
        cold = rank_cold(unseen, waiting.select("profile_id").distinct(), library, issns, journals, s)
        parts = _cut(cold, as_of, s, "shuffle_key")
        fresh_rows, capped, final = (a.unionByName(b, allowMissingColumns=True) for a, b in zip((fresh_rows, capped, final), parts, strict=True))
        random = waiting.select("profile_id").distinct().select("profile_id", F.lit(0.0).alias("must_read"), F.lit(0.0).alias("consider"), F.lit("random").alias("mode"))
        thresholds = thresholds.unionByName(random)

    stages = {"offered": offered, "deduped": kept, "with_abstract": usable, "recent": fresh_rows, "capped": capped}
    marked = None
    for name, frame in stages.items():
        rows = frame.select("profile_id", F.lit(name).alias("stage"))
        marked = rows if marked is None else marked.union(rows)
    texts = works.select("ordinal", *[c for c in ("title", "abstract", "url", "doi", "venue", "authors") if c in works.columns])
    out["recommendations"] = final.join(texts, "ordinal")
    out["thresholds"] = thresholds
    out["funnel"] = marked.groupBy("profile_id", "stage").agg(F.count("*").alias("works"))
    if interests is not None and embedder is not None and reranker is not None:
        columns = ["ordinal", "identifier", "source", "title", "abstract", "embedding"]
        offered_texts = usable.join(interests.select("profile_id").distinct(), "profile_id").join(pool.select(*columns), "ordinal")
        out["interest"] = select_interest_works(offered_texts.where("embedding IS NOT NULL"), interests, embedder, reranker, issns, journals, s.interests)
    return out
