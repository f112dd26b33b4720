"""Readers of landed files and the registry of candidate sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import parse_date, year_of
from ..functions.text import clean_html, clean_title, content_hash, drop_blank, empty_to_null, is_non_article, keep_tags, person_name
from ..operators.filters import NON_BIBLIOGRAPHIC
from ..operators.stats import venue_of

# Shapes of the landed files.
LIBRARY_ITEM = (
    "key string, version bigint, data struct<key:string,version:bigint,itemType:string,title:string,abstractNote:string,"
    "creators:array<struct<firstName:string,lastName:string>>,tags:array<struct<tag:string>>,collections:array<string>,"
    "date:string,DOI:string,url:string,dateAdded:string,publicationTitle:string,conferenceName:string,"
    "proceedingsTitle:string,journalAbbreviation:string>"
)
ARTICLE_ITEM = (
    "DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,abstract:string,`container-title`:array<string>,"
    "created:struct<`date-time`:string>,URL:string,type:string,`is-referenced-by-count`:bigint,publisher:string,ISSN:array<string>"
)
ARTICLE_PAGE = f"message struct<`total-results`:bigint,items:array<struct<{ARTICLE_ITEM}>>>"
FEED_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_rel:string>>, `arxiv:doi` string, `arxiv:primary_category` struct<_term:string>"
)
JOURNAL_ROW = "issn string, title string, category string, impact_factor string"


def parse_library_items(items: DataFrame, excluded_tags: Sequence[str] = (), profile: Column | None = None) -> DataFrame:
    """Landed library records (one per row, shape ``LIBRARY_ITEM``) to library rows."""
    d = F.col("data")
    creators = drop_blank(F.transform(F.coalesce(d["creators"], F.array().cast("array<struct<firstName:string,lastName:string>>")),
                                      lambda c: person_name(c["firstName"], c["lastName"])))
    tags = keep_tags(F.transform(F.coalesce(d["tags"], F.array().cast("array<struct<tag:string>>")), lambda t: t["tag"]), excluded_tags)
    rows = items.where(~F.coalesce(d["itemType"], F.lit("")).isin(*NON_BIBLIOGRAPHIC)).select(
        (F.lit(0).cast("long") if profile is None else profile).alias("profile_id"),
        F.coalesce(empty_to_null(d["key"]), F.col("key")).alias("key"),
        F.coalesce(F.when(d["version"] != 0, d["version"]), F.col("version"), F.lit(0).cast("long")).alias("version"),
        F.coalesce(d["title"], F.lit("")).alias("title"), d["abstractNote"].alias("abstract"),
        creators.alias("creators"), tags.alias("tags"), F.coalesce(d["collections"], F.array().cast("array<string>")).alias("collections"),
        year_of(d["date"]).alias("year"), d["DOI"].alias("doi"), d["url"].alias("url"), parse_date(d["dateAdded"]).alias("date_added"),
        d["date"].alias("raw_date"),
        venue_of(d["publicationTitle"], d["conferenceName"], d["proceedingsTitle"], d["journalAbbreviation"]).alias("venue"),
    )
    return rows.withColumn(
        "content_hash", content_hash(F.col("title"), F.col("abstract"), F.array_join("creators", ","), F.array_join("tags", ","))
    )


def read_library_pages(spark: SparkSession, path: str, excluded_tags: Sequence[str] = ()) -> DataFrame:
    """JSON pages (a list of records per file, or one record per line)."""
    return parse_library_items(spark.read.schema(LIBRARY_ITEM).option("multiLine", True).json(path), excluded_tags)


def parse_article_items(items: DataFrame, column: str = "item") -> DataFrame:
    """Article records (struct ``ARTICLE_ITEM``) to candidates; empty titles and journal pages go."""
    i = F.col(column)
    venue = F.get(i["container-title"], F.lit(0))
    title = clean_title(F.get(i["title"], F.lit(0)))
    people = F.coalesce(i["author"], F.array().cast("array<struct<given:string,family:string>>"))
    return items.where((title != "") & ~is_non_article(title, venue)).select(
        *[c for c in items.columns if c != column],
        F.lit("crossref").alias("source"), F.coalesce(empty_to_null(i["DOI"]), i["URL"], F.lit("unknown")).alias("identifier"),
        title.alias("title"), clean_html(i["abstract"]).alias("abstract"),
        drop_blank(F.transform(people, lambda p: person_name(p["given"], p["family"]))).alias("authors"),
        i["DOI"].alias("doi"), i["URL"].alias("url"), parse_date(i["created"]["date-time"]).alias("published"), venue.alias("venue"),
        F.create_map(F.lit("is-referenced-by"), F.coalesce(i["is-referenced-by-count"], F.lit(0)).cast("double")).alias("metrics"),
        i["type"].alias("work_type"), F.coalesce(i["ISSN"], F.array().cast("array<string>")).alias("issns"),
    )


def read_article_pages(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(ARTICLE_PAGE).option("multiLine", True).json(path)
    return parse_article_items(pages.select(F.explode("message.items").alias("item")))


def parse_feed_entries(entries: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Feed entries to candidates; with ``categories`` only rows whose primary category is among them."""
    title = clean_title(F.col("title"))
    category = F.col("arxiv:primary_category")["_term"]
    links = F.coalesce(F.col("link"), F.array().cast("array<struct<_href:string,_rel:string>>"))
    page_link = F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    kept = entries.where(title != "")
    if categories is not None:
        kept = kept.where(F.coalesce(category.isin(*categories), F.lit(False)))
    return kept.select(
        F.lit("arxiv").alias("source"), F.coalesce(empty_to_null(F.col("id")), title).alias("identifier"), title.alias("title"),
        empty_to_null(clean_title(F.col("summary"))).alias("abstract"),
        F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("authors"),
        F.col("arxiv:doi").alias("doi"), page_link.alias("url"), parse_date(F.col("published")).alias("published"),
        F.lit("arXiv").alias("venue"), category.alias("primary_category"),
    )


def read_preprint_feed(spark: SparkSession, path: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Atom feed files."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(FEED_ENTRY).load(path)
    return parse_feed_entries(entries, categories)


def parse_journals(rows: DataFrame) -> DataFrame:
    """Journal list rows: blank ISSN dropped, ``NA`` or blank factor null, CN flag from the category."""
    factor = F.trim("impact_factor")
    return rows.select(
        F.trim("issn").alias("issn"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("")).alias("category"),
        F.when(~factor.isin("NA", ""), factor.try_cast("double")).alias("impact_factor"),
        F.coalesce(F.col("category").contains("(CN)"), F.lit(False)).alias("is_cn"),
    ).where("issn <> ''")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    return parse_journals(spark.read.schema(JOURNAL_ROW).option("header", True).csv(path))


Reader = Callable[[SparkSession, str], DataFrame]


class SourceRegistry:
    """Named candidate readers."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}

    def register(self, name: str, reader: Reader) -> None:
        self._readers[name] = reader

    def get(self, name: str) -> Reader:
        return self._readers[name]

    def enabled(self, names: Iterable[str]) -> list[str]:
        wanted = set(names)
        return [n for n in self._readers if n in wanted]

    def read(self, spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
        """Union of the sources with a path, and the names of those that could not be opened."""
        frames, failed = [], []
        for priority, name in enumerate(self.enabled(paths)):
            try:
                frames.append(self._readers[name](spark, paths[name]).withColumn("source_priority", F.lit(priority)))
            except AnalysisException:
                failed.append(name)
        return union_sources(frames), failed


def union_sources(frames: Sequence[DataFrame]) -> DataFrame | None:
    """Columns are matched by name; those a source lacks are null."""
    merged = None
    for frame in frames:
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return merged


def default_registry() -> SourceRegistry:
    registry = SourceRegistry()
    registry.register("arxiv", read_preprint_feed)
    registry.register("crossref", read_article_pages)
    return registry
