"""Feed, note payload and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import in_zone, moment, rfc822
from ..functions.feed import content, description, escape_xml, publication_date, score_text

def _item_fields(as_of) -> list[Column]:
    col = F.col
    return [
        col("title"), F.when(col("url") != "", col("url")).alias("link"), col("identifier").alias("guid"),
        publication_date(col("published"), as_of).alias("pubDate"), col("authors").alias("creators"),
        F.when(col("source") == "arxiv", "preprint").alias("type"), F.when(col("venue") != "", col("venue")).alias("publicationName"),
        F.when(col("doi") != "", col("doi")).alias("doi"),
        description(col("abstract"), col("published"), col("venue"), col("score"), col("label")).alias("description"),
        content(col("authors"), col("venue"), col("doi"), col("score"), col("label"), col("abstract")).alias("content"),
    ]


def feed_items(works: DataFrame, as_of) -> DataFrame:
    """One row per feed item."""
    return works.select("profile_id", "rank", *_item_fields(as_of))


# Element names of a feed item, in order.
FEED_ELEMENTS = (
    ("title", "title"), ("link", "link"), ("guid", "guid"), ("pubDate", "pubDate"), ("dc:creator", "creators"), ("dc:type", "type"),
    ("prism:publicationName", "publicationName"), ("prism:doi", "doi"), ("description", "description"), ("content:encoded", "content"),
)
FEED_NAMESPACES = (
    'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/" '
    'xmlns:content="http://purl.org/rss/1.0/modules/content/"'
)


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escape_xml(value), F.lit(f"</{name}>"))


def _item_xml() -> Column:
    def part(name: str, column: str) -> Column:
        if column == "creators":
            return F.array_join(F.transform(column, lambda author: _element(name, author)), "")
        return _element(name, F.col(column))

    parts = [part(name, column) for name, column in FEED_ELEMENTS]
    return F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>"))


def feed_xml(items: DataFrame) -> DataFrame:
    """The XML text of each item; absent parts are left out, each author has an element."""
    return items.select("profile_id", "rank", _item_xml().alias("item_xml"))


def _feed_head(as_of, title: str, link: str, about: str) -> Column:
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="utf-8"?><rss version="2.0" {FEED_NAMESPACES}><channel>'),
        _element("title", F.lit(title)), _element("link", F.lit(link)), _element("description", F.lit(about)),
        _element("lastBuildDate", rfc822(moment(as_of))),
    )


def feed_documents(works: DataFrame, as_of, most_items: int, title: str = "Literature feed", link: str = "https://example.com",
                   about: str = "Recommended papers") -> DataFrame:
    """One feed document per profile with its first ``most_items`` works; ``write_feeds`` has no such limit."""
    first = Window.partitionBy("profile_id").orderBy("rank")
    works = works.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most_items).drop("_n")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_xml"))), lambda x: x["item_xml"]), "")
    return feed_xml(feed_items(works, as_of)).groupBy("profile_id").agg(listed.alias("items")).select(
        "profile_id", F.concat(_feed_head(as_of, title, link, about), F.col("items"), F.lit("</channel></rss>")).alias("value")
    )


def feed_lines(works: DataFrame, as_of, title: str, link: str, about: str) -> DataFrame:
    """The lines ``profile_id, value`` of all feeds, each feed in one task and in order.

    Works are sorted as they are; their XML, which holds an abstract twice, is made line by line afterwards.
    """
    fields = ("title", "url", "identifier", "published", "authors", "source", "venue", "doi", "abstract", "score", "label")
    rows = works.select("profile_id", F.lit(1).alias("part"), "rank", *fields)
    edges = works.select("profile_id").distinct().select("profile_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"))
    ordered = rows.unionByName(edges, allowMissingColumns=True).repartition("profile_id").sortWithinPartitions("profile_id", "part", "rank")
    item = F.regexp_replace(_item_xml(), "\n", "&#10;")
    value = F.when(F.col("part") == 0, _feed_head(as_of, title, link, about)).when(F.col("part") == 2, F.lit("</channel></rss>")).otherwise(item)
    return ordered.select("profile_id", "part", *_item_fields(as_of)).select("profile_id", value.alias("value"))


def write_feeds(works: DataFrame, path: str, as_of, title: str = "Literature feed", link: str = "https://example.com", about: str = "Recommended papers") -> None:
    """One folder with an XML file per profile, a line per item: a feed of any length is sorted and written, never held."""
    feed_lines(works, as_of, title, link, about).write.mode("overwrite").partitionBy("profile_id").text(path)


def note_payload(works: DataFrame, collection: str, tag: str = "recommendation", note: Column | None = None) -> DataFrame:
    """JSON notes for the library service; only the payload, nothing is sent."""
    text = F.concat(F.lit("Recommended due to score "), score_text(F.col("score"))) if note is None else note
    body = F.struct(
        F.lit("note").alias("itemType"), text.alias("note"),
        F.array(F.struct(F.lit(tag).alias("tag")), F.struct(F.col("label").alias("tag"))).alias("tags"), F.array(F.lit(collection)).alias("collections"),
    )
    return works.select("profile_id", "ordinal", F.to_json(body).alias("payload"))


def report_works(works: DataFrame, zone: str = "UTC") -> DataFrame:
    """Works of the report with times in the display zone."""
    return works.withColumn("published_local", in_zone(F.col("published"), zone))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
