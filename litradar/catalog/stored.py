"""Round trips through stores and streams in the session's shared folder, and the build of a profile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures.views import AS_OF, LIBRARY_AS_OF, oracle, table, view
from ..models.providers import HashingEmbedder
from ..operators import clusters as cl
from ..operators.filters import with_library_abstract
from ..plans.profile import build_profile, cluster_library, embed_items, texts_to_encode
from ..plans.rank import with_thresholds
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks, stores
from ..sources.checked import article_source, preprint_source, read_checked
from ..streaming.feed import watch_feed
from ..streaming.sync import first_sightings, score_feed
from .base import entry
from .library import _works
from .rows import _ALIKE, _OFFERS, _TITLED, _recursive, offered_works
from .scores import _EVENT_SCORES, _event_scores, _thresholds_sql
from .title_sql import loop_steps


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _landed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as files that a stream picks up."""
    rows, folder = table(spark, sf, name), _folder(spark, "landing")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def _dated_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items of a profile, written once: the view's join shuffles whole texts."""
    items = view(spark, sf, "document_item").select("profile_id", "key", "source", "title", "abstract")
    return cut_lineage(items).withColumn("date_added", F.lit("2001-08-01 00:00:00").cast("timestamp"))


def _at(day: int):
    return F.lit(f"2024-02-{day:02d} 00:00:00").cast("timestamp")


@entry("summary_round_trip", "S11", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'again ' || source ELSE source END AS bullets, 'new' AS signature FROM documents WHERE lang <> 'fr'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = stores.summary_store(spark, _folder(spark, "summaries"))
    docs = table(spark, sf, "documents")
    paper = F.col("doc_id").cast("string").alias("paper_id")
    store.append(docs.select(paper, F.lit("old").alias("signature"), F.col("lang").alias("bullets"), _at(1).alias("generated_at")))
    first = docs.where("lang <> 'fr'").select(paper, F.lit("new").alias("signature"), F.col("source").alias("bullets"), _at(2).alias("generated_at"))
    store.append(first)
    store.append(docs.where("lang <> 'fr' AND doc_id % 2 = 0").select(paper, F.lit("new").alias("signature"), F.concat(F.lit("again "), "source").alias("bullets"), _at(3).alias("generated_at")))
    store.append(first)  # a replayed batch changes nothing
    # another prompt or model is another signature: what was stored under the old one is not read
    return store.current().where("signature = 'new'").select("paper_id", "bullets", "signature")


@entry("translation_round_trip", "S12", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'zh-CN' AS target_language, lang || CASE WHEN doc_id % 3 = 0 THEN ' better' ELSE '' END AS translated_title
FROM documents WHERE source IN ('src1', 'src2', 'src3')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = stores.translation_store(spark, _folder(spark, "translations"))
    docs = table(spark, sf, "documents")
    key = [F.col("doc_id").cast("string").alias("paper_id"), F.lit("zh-CN").alias("target_language")]
    store.append(docs.select(*key, F.col("source").alias("original_title"), F.col("lang").alias("translated_title"), _at(1).alias("generated_at")))
    store.append(docs.where("doc_id % 3 = 0").select(*key, F.concat("lang", F.lit(" better")).alias("translated_title"), _at(2).alias("generated_at")))
    store.append(docs.select(key[0], F.lit("de").alias("target_language"), F.lit("other").alias("translated_title"), _at(3).alias("generated_at")))
    asked = docs.where("source IN ('src1', 'src2', 'src3')").select(*key)
    return store.lookup(asked).select("paper_id", "target_language", "translated_title")


@entry("analysis_round_trip", "S13", oracle("library_item", """
SELECT profile_id, kind, CASE WHEN kind = 'analysis' THEN CAST(count(*) AS VARCHAR) ELSE CAST(count(DISTINCT venue) AS VARCHAR) END AS content
FROM library_item CROSS JOIN (SELECT unnest(['analysis', 'clusters']) AS kind) GROUP BY profile_id, kind"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = stores.analysis_store(spark, _folder(spark, "analysis"))
    items = view(spark, sf, "library_item")
    kinds = {"analysis": F.count("*"), "clusters": F.count_distinct("venue")}
    for signature, day, part in (("first", 1, items.where("year < 1998")), ("second", 2, items), ("second", 3, items)):
        for kind, value in kinds.items():
            found = part.groupBy("profile_id").agg(value.cast("string").alias("content"))
            store.append(found.select("profile_id", F.lit(signature).alias("signature"), F.lit(kind).alias("kind"), "content", _at(day).alias("generated_at")))
    # a changed library has another signature
    wanted = items.select("profile_id").distinct().withColumn("signature", F.lit("second")).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return store.lookup(wanted).select("profile_id", "kind", "content")


@entry("state_round_trip", "S14", oracle("library_item", """
SELECT profile_id, 'high_water' AS key, CAST(max(version) AS VARCHAR) AS value FROM library_item GROUP BY 1 UNION ALL
SELECT profile_id, 'signature', 's' || CAST(profile_id AS VARCHAR) FROM (SELECT DISTINCT profile_id FROM library_item) WHERE profile_id <> 3"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = stores.state_store(spark, _folder(spark, "state"))
    items = view(spark, sf, "library_item")
    store.append(items.select("profile_id", F.lit("high_water").alias("key"), F.col("version").cast("string").alias("value"), F.timestamp_micros("version").alias("changed_at")))
    profiles = items.select("profile_id").distinct()
    mark = [F.lit("signature").alias("key"), F.concat(F.lit("s"), F.col("profile_id").cast("string")).alias("value")]
    store.append(profiles.select("profile_id", *mark, _at(1).alias("changed_at")))
    store.append(profiles.where("profile_id = 3").select("profile_id", *mark, _at(2).alias("changed_at")), deleted=True)
    return store.current().select("profile_id", "key", "value")


@entry("streamed_feed", "T4 A23 C15", _EVENT_SCORES + _thresholds_sql("e") + """
SELECT e.profile_id, ordinal, CASE WHEN score >= must_read THEN 'must_read' WHEN score >= consider THEN 'consider' ELSE 'ignore' END AS label FROM e JOIN th USING (profile_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The events come as a file stream; a trigger's candidates are one batch."""
    stream = _landed(spark, sf, "events")
    output = _folder(spark, "feed")

    def score(batch: DataFrame) -> DataFrame:
        return with_thresholds(_event_scores(batch))[0].select("profile_id", "ordinal", "label")

    score_feed(stream, score, output, _folder(spark, "feed-checkpoint")).awaitTermination()
    return spark.read.parquet(output).select("profile_id", "ordinal", "label")


_LATER = 1_000_000_000


@entry("deduped_feed", "T4 J1 J2 J3 J4 A23 C15", _recursive(oracle("page_work document_item", f"""{_ALIKE}{_TITLED},
u AS MATERIALIZED (SELECT profile_id, o.ordinal % 2 * {_LATER} + o.ordinal AS ordinal, identifier, doi, k FROM o ANTI JOIN known USING (profile_id, k)
  WHERE NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.doi) = lower(o.doi))
    AND NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.url) = lower(o.identifier))){loop_steps("u", "kept")},
e AS (SELECT kept.profile_id * 2 + kept.ordinal // {_LATER} AS profile_id, kept.ordinal % {_LATER} AS ordinal, round(value / 100.0, 4) AS score FROM kept JOIN events ON event_id = kept.ordinal % {_LATER}),
n AS (SELECT profile_id, count(*) AS n FROM e GROUP BY 1){_thresholds_sql("e")}
SELECT e.profile_id // 2 AS profile_id, ordinal, e.profile_id % 2 AS trigger, CASE WHEN score >= CASE WHEN n < 2 THEN 0.75 ELSE must_read END THEN 'must_read' WHEN score >= CASE WHEN n < 2 THEN 0.55 ELSE consider END THEN 'consider' ELSE 'ignore' END AS label
FROM e JOIN th USING (profile_id) JOIN n USING (profile_id)""")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Offered works land in two parts; the second trigger meets the output of the first."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), F.round(F.col("value") / 100, 4).alias("score"), F.col("ts").cast("timestamp").alias("published"))
    works = cut_lineage(offered_works(spark, sf).select("profile_id", "ordinal", "identifier", "doi", "title", "source").join(events, "ordinal"))
    library = cut_lineage(view(spark, sf, "document_item").select("profile_id", "title", "doi", "url"))
    landing, folder, checkpoint = (_folder(spark, n) for n in ("landing", "watched-feed", "watched-checkpoint"))
    for part in (0, 1):
        works.where(F.col("ordinal") % 2 == part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(works.schema).parquet(landing)
        watch_feed(stream, library, lambda kept: with_thresholds(kept)[0], folder, checkpoint).awaitTermination()
    return spark.read.parquet(f"{folder}/output").select("profile_id", "ordinal", F.col("batch_id").cast("long").alias("trigger"), "label")


@entry("checked_sources", "S15 S2 S3", oracle("page_work", """
SELECT CASE WHEN url LIKE 'https:%' THEN 'arxiv' ELSE 'crossref' END AS source, identifier, ordinal % 10 = 3 AS is_broken FROM page_work WHERE title <> ''"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Works land as article pages and as feed entries; each tenth record is cut off or has a bare ampersand."""
    works = view(spark, sf, "page_work").where("title <> ''")
    broken = F.col("ordinal") % 10 == 3
    articles, feed = _folder(spark, "articles"), _folder(spark, "feed-entries")
    item = F.struct(F.col("identifier").alias("DOI"), F.array(F.concat(F.lit("About "), F.regexp_replace("title", "[^A-Za-z ]", "x"), F.lit(" and more"))).alias("title"), F.col("url").alias("URL"))
    page = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    works.where("url NOT LIKE 'https:%'").select(F.when(broken, F.substring(page, F.lit(1), F.length(page) - 3)).otherwise(page).alias("value")).write.text(articles)
    entry_xml = F.concat(F.lit("<entry><id>"), "identifier", F.lit("</id><title>a work"), F.when(broken, " & more").otherwise(""), F.lit("</title></entry>"))
    works.where("url LIKE 'https:%'").select(entry_xml.alias("value")).write.text(feed)
    got = read_checked(spark, [preprint_source(), article_source(multi_line=False)], {"arxiv": feed, "crossref": articles})
    name = F.coalesce(F.nullif(F.regexp_extract("record", "<id>([^<]*)", 1), F.lit("")), F.regexp_extract("record", '"DOI":"([^"]*)', 1))
    return got.works.select("source", "identifier", F.lit(False).alias("is_broken")).union(got.quarantine.select("source", name, F.lit(True)))


@entry("sighted_users", "T3", "SELECT DISTINCT user_id FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    stream = _landed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    output = _folder(spark, "sightings")
    firsts = first_sightings(stream, "user_id", "ts", 60).select("user_id")
    firsts.writeStream.format("parquet").option("path", output).option("checkpointLocation", _folder(spark, "sightings-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(output)


@entry("written_feeds", "S17", """
SELECT doc_id % 4 AS profile_id, CAST(doc_id AS VARCHAR) AS guid, lang || ' ' || source AS title FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of all works, as files that are read again."""
    path = _folder(spark, "feeds")
    sinks.write_feeds(_works(spark, sf), path, AS_OF)
    lines = spark.read.schema("value string, profile_id long").text(path).where("value LIKE '<item>%'")
    return lines.select("profile_id", F.regexp_extract("value", "<guid>([^<]*)</guid>", 1).alias("guid"), F.regexp_extract("value", "<title>([^<]*)</title>", 1).alias("title"))


@entry("feed_documents", "S17", """
WITH r AS (SELECT doc_id % 4 AS profile_id, doc_id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS n, lang || ' ' || source AS title FROM documents)
SELECT profile_id, count(*) AS items, string_agg(title, '|' ORDER BY doc_id) AS titles, TRUE AS closed FROM r WHERE n <= 25 GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    feeds = sinks.feed_documents(_works(spark, sf), AS_OF, 25)
    titles = F.regexp_extract_all("value", F.lit("<item><title>([^<]*)</title>"), F.lit(1))
    return feeds.select("profile_id", F.size(titles).cast("long").alias("items"), F.array_join(titles, "|").alias("titles"), F.col("value").endswith("</channel></rss>").alias("closed"))


@entry("profile_build", "P1 A19 A21 A18 S9", oracle("document_item", """
, u AS (SELECT * FROM document_item WHERE trim(coalesce(abstract, '')) <> '')
SELECT profile_id, count(*) AS total_papers, count(*) AS papers_in_valid_clusters, (SELECT count(DISTINCT coalesce(title, '') || chr(0) || abstract) FROM u) AS new_embeddings FROM u GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = _dated_items(spark, sf)
    tags = items.select("key", F.col("source").alias("tag"))
    out = build_profile(items, tags, spark.createDataFrame([], stores.EMBEDDING), HashingEmbedder(), LIBRARY_AS_OF)
    encoded = F.lit(out["new_embeddings"].count()).cast("long")
    return out["summary"].select("profile_id", "total_papers", "papers_in_valid_clusters", encoded.alias("new_embeddings"))


@entry("fit_checks", "A19 A21 A22", oracle("library", """
SELECT profile_id, count(*) AS items, count(DISTINCT key) AS keys, TRUE AS near_own_centroid, TRUE AS k_in_bounds FROM library GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every item is in one cluster, nearly all are nearest to the centroid of their own (all, once the rounds have settled), and k is allowed."""
    library = cut_lineage(cluster_library(view(spark, sf, "library").drop("cluster_id")))
    items = cl.unit_embeddings(library)
    cents = cl.centroids(items.withColumn("weight", F.lit(1.0))).select("profile_id", F.col("cluster_id").alias("other"), "centroid")
    near = items.join(cents, "profile_id").groupBy("profile_id", "key", "cluster_id").agg(F.max_by("other", cl.dot(F.col("embedding"), F.col("centroid"))).alias("nearest"))
    sums = near.groupBy("profile_id").agg(F.count("*").alias("items"), F.count_distinct("key").alias("keys"), F.avg((F.col("nearest") == F.col("cluster_id")).cast("int")).alias("_share"), F.count_distinct("cluster_id").alias("_k"))
    _, high = cl.cluster_bounds(F.col("items"))
    return sums.select("profile_id", "items", "keys", (F.col("_share") >= 0.95).alias("near_own_centroid"), (F.col("_k") <= high).alias("k_in_bounds"))


@entry("profile_rebuild", "P1 T2 S9", oracle("document_item", """
, u AS (SELECT *, coalesce(title, '') || chr(0) || abstract AS t FROM document_item WHERE trim(coalesce(abstract, '')) <> '')
SELECT profile_id, count(*) AS total_papers, 0::BIGINT AS missing, (SELECT count(DISTINCT t) FROM u WHERE length(abstract) % 2 = 0) AS encoded_again FROM u GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A full build with a store of all texts, some of them stored for candidates: only the profile's own vectors are encoded again."""
    items = _dated_items(spark, sf)
    usable = with_library_abstract(items)
    _, rows = embed_items(usable, spark.createDataFrame([], stores.EMBEDDING), HashingEmbedder(), LIBRARY_AS_OF, "profile", None)
    odd = texts_to_encode(usable).where(F.length("abstract") % 2 == 1).select("content_hash", F.lit("candidate").alias("_kind")).distinct()
    kind = F.coalesce("_kind", "source_type")
    store = cut_lineage(rows.join(odd, "content_hash", "left").withColumn("source_type", kind).drop("_kind").withColumn("source_id", F.lit(None).cast("string")))
    _, missing = embed_items(usable, store, HashingEmbedder(), LIBRARY_AS_OF, "profile", None)
    out = build_profile(items, items.select("key", F.col("source").alias("tag")), store, HashingEmbedder(), LIBRARY_AS_OF, full=True)
    counts = [F.lit(f.count()).cast("long").alias(name) for f, name in ((missing, "missing"), (out["new_embeddings"], "encoded_again"))]
    return out["summary"].select("profile_id", "total_papers", *counts)
