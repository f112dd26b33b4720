"""Select works for described interests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import dot, l2_norm, l2_normalize
from ..models.providers import Embedder, Reranker, encode_texts, rerank
from ..operators.filters import without_excluded
from ..operators.joins import journal_scores
from ..operators.skew import skew_join
from ..params import Interests


def recall(works: DataFrame, queries: DataFrame, max_documents: int) -> DataFrame:
    """The works of a profile most similar to its query vector.

    ``works(profile_id, ordinal, embedding)``, ``queries(profile_id, query_vector)``: one vector per
    profile, so the product is one dot per row and the limit prunes before the shuffle.
    """
    unit = queries.select("profile_id", l2_normalize(F.col("query_vector")).alias("query_vector"))
    scored = skew_join(works, unit, ["profile_id"], "inner", ["ordinal"]).withColumn(
        "similarity", dot(F.col("embedding"), F.col("query_vector")) / (l2_norm(F.col("embedding")) + F.lit(1e-12))
    ).drop("query_vector")
    nearest = Window.partitionBy("profile_id").orderBy(F.desc(F.round("similarity", 9)), "ordinal")
    return scored.withColumn("recall_rank", F.row_number().over(nearest).cast("long")).where(F.col("recall_rank") <= max_documents)


def query_vectors(interests: DataFrame, embedder: Embedder) -> DataFrame:
    """Queries are encoded as such and not kept."""
    texts = interests.select(F.col("profile_id").cast("string").alias("content_hash"), F.col("refined_query").alias("text"))
    return encode_texts(texts, embedder, "query").select(F.col("content_hash").cast("long").alias("profile_id"), F.col("embedding").alias("query_vector"))


def select_interest_works(works: DataFrame, interests: DataFrame, embedder: Embedder, reranker: Reranker, issns: DataFrame, journals: DataFrame,
                          p: Interests = Interests()) -> DataFrame:
    """Exclude, recall, rerank; the rerank score is the score.

    ``works(profile_id, ordinal, source, title, abstract, embedding)``,
    ``interests(profile_id, refined_query, exclude_keywords)``.
    """
    if p.max_documents > reranker.max_documents:
        raise ValueError(f"the reranker takes {reranker.max_documents} documents, {p.max_documents} are to be recalled")
    allowed = without_excluded(works, interests)
    recalled = recall(allowed, query_vectors(interests, embedder), p.max_documents)
    documents = recalled.join(interests.select("profile_id", F.col("refined_query").alias("query")), "profile_id").withColumn(
        "document", F.concat("title", F.lit("\n"), F.coalesce("abstract", F.lit("")))
    )
    best = rerank(documents, reranker, p.top_k)
    chosen = recalled.drop("recall_rank").join(best, ["profile_id", "ordinal"])
    scores = journal_scores(chosen.select("ordinal", "source").distinct(), issns, journals)
    return chosen.join(scores, "ordinal").select("*", F.col("rerank_score").alias("score"), F.lit("interest").alias("label"))
