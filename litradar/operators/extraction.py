"""Abstract extraction over a pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import (
    MIN_ABSTRACT, clean_texts, detect_publisher, generic_meta, is_highlights, joined_paragraphs, own_meta, rule_finds, shrink_page, state_paragraphs,
)
from ..functions.text import strip
from ..functions.clock import moment


def extract_abstracts(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Add ``publisher`` and ``abstract`` (null when no rule finds one)."""
    found = pages.withColumn("publisher", detect_publisher(F.col(url)))
    found = found.withColumn("_own", own_meta(F.col(page), F.col("publisher")))
    found = found.withColumn("_meta", F.coalesce(F.col("_own"), generic_meta(F.col(page))))
    found = found.withColumn("_finds", rule_finds(F.col(page), F.col("publisher"), F.col("_own"), F.col("_meta"))).drop("_own", "_meta")
    found = found.withColumn("_paragraphs", F.when(F.col("publisher") == "elsevier", state_paragraphs(F.col(page))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("_texts", clean_texts(F.transform("_finds", lambda f: f["raw"]))).withColumn("_state", clean_texts(F.col("_paragraphs")))
    tried = F.arrays_zip(F.transform("_finds", lambda f: f["is_meta"]).alias("is_meta"), F.col("_texts").alias("text"))
    good = F.filter(tried, lambda t: t["is_meta"] | ((F.length(t["text"]) >= MIN_ABSTRACT) & ~is_highlights(t["text"])))
    first = F.get(F.transform(good, lambda t: t["text"]), F.lit(0))
    return found.withColumn("abstract", F.coalesce(joined_paragraphs(F.col("_state")), first)).drop("_finds", "_paragraphs", "_texts", "_state")


def _by_abstract(extracted: DataFrame, condition: str) -> DataFrame:
    """Rows whose ``abstract`` meets the condition, which is tested on the finished abstract.

    A filter would be moved below the projection that makes the abstract, and all patterns would run again for each place
    that names one of their finds; it stays above a projection with a row number.
    """
    return extracted.withColumn("_no", F.monotonically_increasing_id()).where(f"{condition} AND _no >= 0").drop("_no")


def model_requests(extracted: DataFrame, page: str = "html", most_page: int | None = None, most_section: int | None = None) -> DataFrame:
    """Pages the rules missed, shrunk for the text model; ``is_cut`` where the model's limits cut something off."""
    asked = _by_abstract(extracted, "abstract IS NULL").withColumn("content", shrink_page(F.col(page)))
    if most_page is None and most_section is None:
        return asked.withColumn("is_cut", F.lit(False))
    asked = asked.withColumn("_short", shrink_page(F.col(page), most_page, most_section))
    return asked.withColumn("is_cut", F.col("_short") != F.col("content")).withColumn("content", F.col("_short")).drop("_short")


def accepted_answer(answer: str = "answer"):
    """A model answer counts unless it says NOT_FOUND or is shorter than 50 characters."""
    text = strip(F.col(answer))
    return F.when(~text.contains("NOT_FOUND") & (F.length(text) >= 50), text)


def with_answers(extracted: DataFrame, answers: DataFrame, key: str = "doi") -> DataFrame:
    """Fill missing abstracts from landed ``answers(key, answer)``; of several accepted ones for a key the smallest, a null key has none."""
    accepted = answers.select(F.col(key), accepted_answer().alias("_answer")).where("_answer IS NOT NULL")
    best = accepted.groupBy(key).agg(F.min("_answer").alias("_answer"))
    return extracted.join(best, key, "left").withColumn("abstract", F.coalesce("abstract", "_answer")).drop("_answer")


def as_store_rows(extracted: DataFrame, as_of, ttl_days: int = 30, source: str = "pages") -> DataFrame:
    """Extraction results in the shape of the abstract store."""
    now = moment(as_of)
    return _by_abstract(extracted, "abstract IS NOT NULL").select(
        F.lower("doi").alias("doi"), "abstract", "title", F.lit(source).alias("source"), now.alias("created_at"),
        (now + F.make_dt_interval(days=F.lit(ttl_days))).alias("expires_at"),
    )
