"""Library analytics per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_before, moment, quarter_key
from ..functions.text import empty_to_null, strip
from ..params import LibraryStats
from .ranking import top_counts

# Words that make a venue a conference.
CONFERENCE_WORDS = ("conference", "symposium", "workshop", "proceedings", "annual meeting", "congress")


def venue_type(venue: Column) -> Column:
    return F.when(F.lower(venue).rlike("|".join(CONFERENCE_WORDS)), "conference").otherwise("journal")


def venue_of(*fields: Column) -> Column:
    """First non-empty venue field."""
    return F.coalesce(*[empty_to_null(f) for f in fields])


def usable_tags(tags: DataFrame) -> DataFrame:
    """Stripped tags of more than one character."""
    return tags.withColumn("tag", strip(F.col("tag"))).where(F.length("tag") > 1)


def keyword_stats(tags: DataFrame, n: int = 50) -> DataFrame:
    """``tags(profile_id, key, tag)`` to the most frequent tags."""
    counted = usable_tags(tags).groupBy("profile_id", "tag").agg(F.count("*").alias("tag_count"))
    return top_counts(counted, ["profile_id"], "tag_count", "tag", n)


def _author_counts(authors: DataFrame) -> DataFrame:
    named = authors.withColumn("author", strip(F.col("author"))).where("author <> ''")
    # years per author are few; the set is bounded by the calendar
    return named.groupBy("profile_id", "author").agg(
        F.count("*").alias("paper_count"),
        F.array_sort(F.collect_set(F.when(F.col("year") != 0, F.col("year")))).alias("years_active"),
    )


def author_stats(authors: DataFrame, n: int = 30) -> DataFrame:
    """``authors(profile_id, key, author, year)`` to the most frequent authors with their years."""
    return top_counts(_author_counts(authors), ["profile_id"], "paper_count", "author", n)


def frequent_authors(authors: DataFrame, min_count: int = 10) -> DataFrame:
    named = authors.withColumn("author", strip(F.col("author"))).where("author <> ''")
    counts = named.groupBy("profile_id", "author").agg(F.count("*").alias("c"))
    return counts.groupBy("profile_id").agg(F.count_if(F.col("c") >= min_count).alias("frequent_author_count"))


def venue_stats(items: DataFrame, n: int = 20) -> DataFrame:
    counted = items.withColumn("venue", strip(F.col("venue"))).where("venue <> ''").groupBy("profile_id", "venue").agg(
        F.count("*").alias("paper_count")
    )
    return top_counts(counted, ["profile_id"], "paper_count", "venue", n).withColumn("venue_type", venue_type(F.col("venue")))


def quarterly_trends(items: DataFrame, as_of, years_back: int = 3) -> DataFrame:
    """Papers per quarter from January of the first year to the current quarter, zeros included."""
    now = moment(as_of)
    first = F.year(now) - F.lit(years_back - 1)
    counts = items.where((F.col("year") != 0) & (F.col("year") >= first)).groupBy(
        "profile_id", quarter_key(F.col("year"), F.col("raw_date")).alias("quarter")
    ).agg(F.count("*").alias("paper_count"))
    starts = F.sequence(F.make_date(first, F.lit(1), F.lit(1)), F.to_date(now), F.expr("INTERVAL 3 MONTHS"))
    calendar = items.select("profile_id").distinct().select("profile_id", F.explode(starts).alias("d")).select(
        "profile_id", F.concat(F.year("d").cast("string"), F.lit("-Q"), F.quarter("d").cast("string")).alias("quarter")
    )
    return calendar.join(counts, ["profile_id", "quarter"], "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0)).cast("long"))


def year_distribution(items: DataFrame, as_of, window: int = 20) -> DataFrame:
    last = F.year(moment(as_of))
    first = last - F.lit(window - 1)
    counts = items.where((F.col("year") != 0) & (F.col("year") >= first)).groupBy("profile_id", F.col("year").cast("long").alias("year")).agg(
        F.count("*").alias("paper_count")
    )
    calendar = items.select("profile_id").distinct().select("profile_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("year"))
    return calendar.join(counts, ["profile_id", "year"], "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0)).cast("long"))


def is_recent(as_of, days: int = 30) -> Column:
    """Added within the last days; by publication year where the date is missing."""
    now = moment(as_of)
    by_date = F.col("date_added") >= days_before(now, days)
    by_year = F.coalesce((F.col("year") != 0) & (F.col("year") >= F.year(now)), F.lit(False))
    return F.when(F.col("date_added").isNotNull(), by_date).otherwise(by_year)


def recent_counts(items: DataFrame, as_of, days: int = 30) -> DataFrame:
    return items.groupBy("profile_id").agg(F.count_if(is_recent(as_of, days)).alias("recent_count"))


def new_keywords(items: DataFrame, tags: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Of the ten most frequent recent tags, those seen nowhere else; at most five.

    ``items(profile_id, key, date_added, year)``, ``tags(profile_id, key, tag)``.
    """
    flagged = items.select("profile_id", "key", is_recent(as_of, days).alias("recent"))
    counted = usable_tags(tags).join(flagged, ["profile_id", "key"]).groupBy("profile_id", "tag").agg(
        F.count_if(F.col("recent")).alias("recent_count"), F.count("*").alias("total_count")
    )
    top = top_counts(counted.where("recent_count > 0"), ["profile_id"], "recent_count", "tag", 10)
    only = top.where("recent_count = total_count")
    return top_counts(only.drop("rank"), ["profile_id"], "recent_count", "tag", 5)


def collection_duration(items: DataFrame) -> DataFrame:
    """Time from first to last addition as "Y年M月", "M月D天" or "D天"."""
    span = items.groupBy("profile_id").agg(F.to_date(F.min("date_added")).alias("s"), F.to_date(F.max("date_added")).alias("e"))
    raw_days = F.dayofmonth("e") - F.dayofmonth("s")
    borrow = raw_days < 0
    days = F.when(borrow, raw_days + F.dayofmonth(F.last_day(F.add_months("e", -1)))).otherwise(raw_days)
    months_total = (F.year("e") - F.year("s")) * 12 + F.month("e") - F.month("s") - F.when(borrow, 1).otherwise(0)
    years, months = F.floor(months_total / 12), F.pmod(months_total, F.lit(12))

    def text(*parts) -> Column:
        return F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])

    return span.select(
        "profile_id",
        F.when(F.col("s").isNull(), F.lit(None).cast("string"))
        .when((years == 0) & (months == 0), text(F.greatest(F.datediff("e", "s") + 1, F.lit(1)), "天"))
        .when(years == 0, text(months, "月", days, "天"))
        .otherwise(text(years, "年", months, "月")).alias("duration"),
    )


def library_overview(items: DataFrame) -> DataFrame:
    year = F.when(F.col("year") != 0, F.col("year"))
    return items.groupBy("profile_id").agg(
        F.count("*").alias("total_papers"), F.coalesce(F.min(year), F.lit(0)).cast("long").alias("first_year"),
        F.coalesce(F.max(year), F.lit(0)).cast("long").alias("last_year"),
    )


def library_hash(items: DataFrame) -> DataFrame:
    """State of a library as 16 hex digits, from key and version of every item.

    Order-free sums of the row hashes, so a library of any size is never put into one row.
    """
    piece = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("key"), F.col("version").cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    folded = items.groupBy("profile_id").agg(
        F.count("*").alias("n"), F.sum(piece).alias("s"), F.bit_xor(piece.cast("long")).alias("x")
    )
    return folded.select(
        "profile_id", F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256), 1, 16).alias("library_hash")
    )


def abstract_coverage(items: DataFrame) -> DataFrame:
    has = F.coalesce(F.trim("abstract") != "", F.lit(False))
    return items.groupBy("profile_id").agg(F.count_if(has).alias("with_abstract"), F.count_if(~has).alias("without_abstract"))


def counts_by(works: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Fetched works per category or journal."""
    counted = works.groupBy(column).agg(F.count("*").alias("work_count"))
    return counted if n is None else counted.orderBy(F.desc("work_count"), column).limit(n)


def enrichment_stats(filled: DataFrame) -> DataFrame:
    """One row of counters from ``fill_abstracts``."""
    needs = F.col("route") == "needs_abstract"
    got = needs & F.col("abstract_from").isNotNull()
    counts = filled.agg(
        F.count("*").alias("total_candidates"), F.count_if(F.col("route") == "has_abstract").alias("with_abstract"),
        F.count_if(needs).alias("missing_abstracts"), F.count_if(F.col("route") == "no_doi").alias("skipped_no_doi"),
        F.count_if(F.col("abstract_from") == "cache").alias("cache_hits"), F.count_if(F.col("abstract_from") == "fresh").alias("fetched"),
        F.count_if(got).alias("enriched"), F.count_if(needs & F.col("abstract_from").isNull()).alias("failed"),
    )

    def rate(c: Column) -> Column:
        return F.when(F.col("total_candidates") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * c / F.col("total_candidates"))

    return counts.select("*", rate(F.col("with_abstract")).alias("original_rate"), rate(F.col("with_abstract") + F.col("enriched")).alias("final_rate"))


def library_analytics(items: DataFrame, tags: DataFrame, authors: DataFrame, as_of, p: LibraryStats = LibraryStats()) -> dict[str, DataFrame]:
    """All statistics, one frame each."""
    return {
        "overview": library_overview(items).join(collection_duration(items), "profile_id")
        .join(frequent_authors(authors, p.author_min_count), "profile_id", "left")
        .join(recent_counts(items, as_of, p.recent_days), "profile_id").join(library_hash(items), "profile_id"),
        "keywords": keyword_stats(tags, p.keywords),
        "authors": author_stats(authors, p.authors),
        "venues": venue_stats(items, p.venues),
        "quarters": quarterly_trends(items, as_of, p.years_back),
        "years": year_distribution(items, as_of, p.year_window),
        "new_keywords": new_keywords(items, tags, as_of, p.recent_days),
    }
