"""Row filters of the ingest, fetch, interest and report steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_before, moment, today_start
from ..functions.text import is_non_article, strip
from .selection import top_n
from .skew import skew_join

# Item types that are no bibliographic records.
NON_BIBLIOGRAPHIC = ("attachment", "annotation", "note")


def bibliographic(items: DataFrame, item_type: str = "itemType") -> DataFrame:
    return items.where(~F.coalesce(F.col(item_type), F.lit("")).isin(*NON_BIBLIOGRAPHIC))


def configured_categories(works: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose primary category is wanted; cross-listed ones go. ``categories(primary_category)``."""
    return works.join(categories.select("primary_category").distinct(), "primary_category", "left_semi")


def articles(works: DataFrame) -> DataFrame:
    """Drop journal pages and empty titles."""
    return works.where(~is_non_article(F.col("title"), F.col("venue")))


def titled(works: DataFrame) -> DataFrame:
    return works.where(F.length(strip(F.coalesce(F.col("title"), F.lit("")))) > 0)


def with_library_abstract(library: DataFrame) -> DataFrame:
    """Library rule: a blank abstract does not count."""
    return library.where(F.trim("abstract") != "")


def with_candidate_abstract(works: DataFrame) -> DataFrame:
    """Candidate rule: any non-empty text counts, blanks too."""
    return works.where(F.col("abstract") != "")


def recent(works: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Published on or after midnight of ``as_of`` minus the days; 0 or less switches it off."""
    if days <= 0:
        return works
    return works.where(F.col("published") >= days_before(today_start(as_of), days))


def fetch_window(as_of, days_back: int) -> tuple[Column, Column]:
    """First moment and end (exclusive) of the whole past days to fetch."""
    end = today_start(as_of)
    return days_before(end, days_back), end


def in_fetch_window(works: DataFrame, as_of, days_back: int, column: str = "published") -> DataFrame:
    start, end = fetch_window(as_of, days_back)
    return works.where((F.col(column) >= start) & (F.col(column) < end))


def newest_per_source(works: DataFrame, max_results: int) -> DataFrame:
    """The newest rows of each source, ties by the smaller ordinal. No task gets a whole source."""
    return top_n(works, ["source"], F.col("published").cast("timestamp"), "ordinal", max_results)


def unexpired(as_of) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > moment(as_of))


def abstract_route() -> Column:
    """Where a candidate goes in enrichment."""
    return F.when(F.col("abstract") != "", "has_abstract").when(F.col("doi") != "", "needs_abstract").otherwise("no_doi")


def without_excluded(works: DataFrame, interests: DataFrame) -> DataFrame:
    """Drop works whose title or abstract contains an exclusion keyword of the profile.

    ``works(profile_id, …)``, ``interests(profile_id, exclude_keywords)``: one row per profile.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    scalars = [name for name, kind in works.dtypes if not kind.startswith(("map", "array", "struct"))]
    joined = skew_join(works, interests.select("profile_id", "exclude_keywords"), ["profile_id"], "left", scalars).withColumn("_text", text)
    hit = F.exists(F.coalesce("exclude_keywords", F.array().cast("array<string>")), lambda k: F.col("_text").contains(F.lower(k)))
    return joined.where(~hit).drop("_text", "exclude_keywords")


def with_listed_issn(works: DataFrame, journals: DataFrame) -> DataFrame:
    """Works carrying at least one listed ISSN. ``works(ordinal, issns)``."""
    listed = works.select("ordinal", F.explode("issns").alias("issn")).join(journals.select("issn"), "issn", "left_semi")
    return works.join(listed.select("ordinal").distinct(), "ordinal", "left_semi")


def drop_tags(tags: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Long form of the tag exclusion: ``tags(key, tag)``."""
    present = tags.where("tag IS NOT NULL AND tag <> ''")
    banned = sorted({t.strip() for t in excluded if t and t.strip()})
    return present.where(~strip(F.col("tag")).isin(*banned)) if banned else present
