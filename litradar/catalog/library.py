"""Library analytics, page extraction, model-backed steps and outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures.views import AS_OF, LIBRARY_AS_OF, oracle, query, table, view
from ..functions import prompts
from ..functions.pages import LEAD_DESCRIPTION, LEAD_SECTION
from ..models import services
from ..models.providers import EchoCompleter, HashingEmbedder, OverlapReranker, complete_prompts, encode_texts, rerank
from ..operators import extraction, stats
from ..plans import interest as interest_plan
from ..plans.enrich import enrich
from ..session import cut_lineage, spread_scan
from ..sources import sinks
from .base import ORACLE, collapse_sql, entry, rounded, strip_sql, stripped_sql, unescape_sql

_ITEMS = "library_item"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, _ITEMS)


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("profile_id", "key").join(view(spark, sf, "item_tag"), "key")


def _authors(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("profile_id", "key", "year").join(view(spark, sf, "item_author"), "key")


_RECENT = f"coalesce(CASE WHEN date_added IS NOT NULL THEN date_added >= TIMESTAMP '{LIBRARY_AS_OF}' - INTERVAL 40 DAY ELSE year >= 2001 END, FALSE)"


@entry("keyword_stats", "A1 W6", oracle("library_item item_tag", """
, c AS (SELECT i.profile_id, trim(t.tag) AS tag, count(*) AS tag_count FROM library_item i JOIN item_tag t ON t.key = i.key WHERE length(trim(t.tag)) > 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY tag_count DESC, tag) AS rank FROM c) SELECT * FROM r WHERE rank <= 50"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.keyword_stats(_tags(spark, sf))


@entry("author_stats", "A2 W6", oracle("library_item item_author", """
, c AS (SELECT i.profile_id, a.author, count(*) AS paper_count, array_to_string(list_sort(list(DISTINCT i.year)), ',') AS years_active
        FROM library_item i JOIN item_author a ON a.key = i.key GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY paper_count DESC, author) AS rank FROM c) SELECT * FROM r WHERE rank <= 30"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.author_stats(_authors(spark, sf)).withColumn("years_active", F.array_join("years_active", ","))


@entry("frequent_authors", "A3", oracle("library_item item_author", """
, c AS (SELECT i.profile_id, a.author, count(*) AS n FROM library_item i JOIN item_author a ON a.key = i.key GROUP BY ALL)
SELECT profile_id, count(*) FILTER (WHERE n >= 10) AS frequent_author_count FROM c GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frequent_authors(_authors(spark, sf))


_VENUES = "SELECT profile_id, key, CASE venue WHEN 'BUILDING' THEN ' Proceedings of BUILDING ' WHEN 'MACHINERY' THEN '' ELSE venue END AS venue FROM library_item"


@entry("venue_stats", "A4 C19 W6", oracle("library_item", f"""
, v AS (SELECT profile_id, trim(venue) AS venue FROM ({_VENUES})), c AS (SELECT profile_id, venue, count(*) AS paper_count FROM v WHERE venue <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY paper_count DESC, venue) AS rank FROM c)
SELECT *, CASE WHEN lower(venue) LIKE '%proceedings%' THEN 'conference' ELSE 'journal' END AS venue_type FROM r WHERE rank <= 20"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    _items(spark, sf).createOrReplaceTempView("library_item")
    return stats.venue_stats(spark.sql(_VENUES))


@entry("quarterly_trends", "A5 J12 C12", oracle("library_item", f"""
, q AS (SELECT profile_id, CAST(year AS VARCHAR) || '-Q' || CAST((CAST(split_part(raw_date, '-', 2) AS BIGINT) - 1) // 3 + 1 AS VARCHAR) AS quarter, count(*) AS n FROM library_item WHERE year >= 1999 GROUP BY ALL),
k AS (SELECT p.profile_id, y.y, g.q FROM (SELECT DISTINCT profile_id FROM library_item) p, generate_series(1999, 2001) AS y(y), generate_series(1, 4) AS g(q) WHERE NOT (y.y = 2001 AND g.q > 3)),
c AS (SELECT profile_id, CAST(y AS VARCHAR) || '-Q' || CAST(q AS VARCHAR) AS quarter FROM k)
SELECT c.profile_id, c.quarter, coalesce(q.n, 0) AS paper_count FROM c LEFT JOIN q ON q.profile_id = c.profile_id AND q.quarter = c.quarter"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quarterly_trends(_items(spark, sf), LIBRARY_AS_OF)


@entry("year_distribution", "A6 J12", oracle("library_item", """
, k AS (SELECT p.profile_id, y.y AS year FROM (SELECT DISTINCT profile_id FROM library_item) p, generate_series(1982, 2001) AS y(y))
SELECT k.profile_id, k.year, count(i.key) AS paper_count FROM k LEFT JOIN library_item i ON i.profile_id = k.profile_id AND i.year = k.year GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.year_distribution(_items(spark, sf), LIBRARY_AS_OF)


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Library items, some without a date of addition."""
    return _items(spark, sf).withColumn("date_added", F.when(F.col("venue") != "BUILDING", F.col("date_added")))


_DATED = "(SELECT profile_id, key, year, CASE WHEN venue = 'BUILDING' THEN NULL ELSE date_added END AS date_added FROM library_item)"


@entry("recent_counts", "A7", oracle("library_item", f"SELECT profile_id, count(*) FILTER (WHERE {_RECENT}) AS recent_count FROM {_DATED} GROUP BY 1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recent_counts(_dated(spark, sf), LIBRARY_AS_OF, 40)


@entry("new_keywords", "A7 W6", oracle("library_item item_tag", f"""
, g AS (SELECT i.profile_id, t.tag || '-' || CASE WHEN {_RECENT} THEN 'r' ELSE i.year::VARCHAR END AS tag, {_RECENT} AS r FROM {_DATED} i JOIN item_tag t ON t.key = i.key),
c AS (SELECT profile_id, tag, count(*) FILTER (WHERE r) AS recent_count, count(*) AS total_count FROM g GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY recent_count DESC, tag) AS n FROM c WHERE recent_count > 0),
b AS (SELECT profile_id, tag, recent_count, total_count, row_number() OVER (PARTITION BY profile_id ORDER BY recent_count DESC, tag) AS rank FROM a WHERE n <= 10 AND recent_count = total_count)
SELECT * FROM b WHERE rank <= 5"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = _dated(spark, sf)
    mark = F.when(stats.is_recent(LIBRARY_AS_OF, 40), "r").otherwise(F.col("year").cast("string"))
    tags = items.select("profile_id", "key", mark.alias("m")).join(view(spark, sf, "item_tag"), "key").select("profile_id", "key", F.concat("tag", F.lit("-"), "m").alias("tag"))
    return stats.new_keywords(items, tags, LIBRARY_AS_OF, 40)


@entry("collection_durations", "A8", oracle("library_item", """
, g AS (SELECT profile_id * 100000 + version % 997 AS profile_id, date_added FROM library_item), s AS (SELECT profile_id, CAST(min(date_added) AS DATE) AS s, CAST(max(date_added) AS DATE) AS e FROM g GROUP BY 1),
b AS (SELECT *, day(e) - day(s) AS rd, (year(e) - year(s)) * 12 + month(e) - month(s) AS rm FROM s),
c AS (SELECT *, CASE WHEN rd < 0 THEN rd + day(last_day(e - INTERVAL 1 MONTH)) ELSE rd END AS d, CASE WHEN rd < 0 THEN rm - 1 ELSE rm END AS m FROM b)
SELECT profile_id, CASE WHEN m = 0 THEN CAST(greatest(datediff('day', s, e) + 1, 1) AS VARCHAR) || '天' WHEN m < 12 THEN CAST(m AS VARCHAR) || '月' || CAST(d AS VARCHAR) || '天'
  ELSE CAST(m // 12 AS VARCHAR) || '年' || CAST(m % 12 AS VARCHAR) || '月' END AS duration FROM c"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).withColumn("profile_id", F.col("profile_id") * 100000 + F.col("version") % 997)
    return stats.collection_duration(items)


@entry("library_overview", "A9 P7", oracle("library_item", """
SELECT profile_id, count(*) AS total_papers, min(year) AS first_year, max(year) AS last_year FROM library_item GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.library_overview(_items(spark, sf))


@entry("library_hashes", "A10", oracle("library_item", """
, h AS (SELECT profile_id, ('0x' || substr(sha256(key || ':' || CAST(version AS VARCHAR)), 1, 15))::BIGINT AS p FROM library_item)
SELECT profile_id, substr(sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(p) AS VARCHAR) || ':' || CAST(bit_xor(p) AS VARCHAR)), 1, 16) AS library_hash FROM h GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.library_hash(_items(spark, sf))


@entry("journal_counts", "A12", """
SELECT c_mktsegment AS venue, count(*) AS work_count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counts_by(_items(spark, sf), "venue", 20)


@entry("library_analytics", "P7", oracle("library_item item_author", f"""
, a AS (SELECT profile_id, count(*) FILTER (WHERE n >= 10) AS frequent_author_count FROM
        (SELECT i.profile_id, x.author, count(*) AS n FROM library_item i JOIN item_author x ON x.key = i.key GROUP BY ALL) GROUP BY 1)
SELECT i.profile_id, count(*) AS total_papers, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (WHERE date_added >= TIMESTAMP '{LIBRARY_AS_OF}' - INTERVAL 30 DAY) AS recent_count,
  any_value(frequent_author_count) AS frequent_author_count FROM library_item i JOIN a ON a.profile_id = i.profile_id GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    frames = stats.library_analytics(_items(spark, sf), _tags(spark, sf), _authors(spark, sf), LIBRARY_AS_OF)
    return frames["overview"].drop("duration", "library_hash")


# frame, its query alone, what is counted, how often
_FRAMES = (("keywords", "keyword_stats", "tag", "tag_count"), ("authors", "author_stats", "author", "paper_count"),
           ("quarters", "quarterly_trends", "quarter", "paper_count"), ("years", "year_distribution", "year", "paper_count"))


@entry("library_analytics_frames", "P7 A1 A2 A5 A6", " UNION ALL ".join(
    f"SELECT '{frame}' AS frame, profile_id, CAST({name} AS VARCHAR) AS name, CAST({amount} AS BIGINT) AS amount FROM ({ORACLE[alone]})" for frame, alone, name, amount in _FRAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that share their inputs, out of one call, in long form."""
    frames = stats.library_analytics(_items(spark, sf), _tags(spark, sf), _authors(spark, sf), LIBRARY_AS_OF)
    parts = [frames[frame].select(F.lit(frame).alias("frame"), "profile_id", F.col(name).cast("string").alias("name"), F.col(amount).cast("long").alias("amount"))
             for frame, _, name, amount in _FRAMES]
    return reduce(DataFrame.unionByName, parts)


# --- pages ---

_EXTRACTED_SQL = f"""
, t AS (SELECT d.doc_id, lang, text, {strip_sql("replace(replace(text, chr(34), ' '), chr(39), ' ')")} AS quoted FROM documents d),
c AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN CASE WHEN length(quoted) >= 100 THEN {collapse_sql(f"regexp_replace(regexp_replace({unescape_sql('quoted')}, '<[^>]+>', ' ', 'g'), '^\\s*(?i:abstract)\\s*:?\\s*', '')")} END
  ELSE {collapse_sql(f"regexp_replace(regexp_replace({unescape_sql('text')}, '<[^>]+>', ' ', 'g'), '^\\s*(?i:abstract)\\s*:?\\s*', '')")} END AS plain,
  CASE WHEN lang = 'en' THEN FALSE ELSE TRUE END AS selected FROM t)
SELECT doc_id, CASE WHEN selected AND lang = 'fr' AND length('Abstract : ' || plain) >= 100 AND length(plain) >= 100 THEN plain
  WHEN selected AND lang = 'fr' THEN NULL WHEN selected AND length(plain) < 100 THEN NULL ELSE plain END AS abstract FROM c"""


@entry("extracted_abstracts", "X1 X2 X4 X5 C20", oracle("publisher_page", _EXTRACTED_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_abstracts(spread_scan(view(spark, sf, "publisher_page"))).select("doc_id", "abstract")


# landed answers: refusals, twice the text between white space, and short ones
_ANSWERS = "SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'NOT_FOUND ' || text WHEN 1 THEN '  ' || text || ' ' || text || ' ' ELSE left(text, 49) END AS answer FROM documents"


@entry("answered_pages", "X7 X1", oracle("publisher_page", ", e AS (" + _EXTRACTED_SQL.replace("\n, t AS", "WITH t AS", 1) + f"""),
w AS (SELECT doc_id, {strip_sql("answer")} AS answer FROM ({_ANSWERS}))
SELECT e.doc_id, coalesce(e.abstract, CASE WHEN NOT contains(w.answer, 'NOT_FOUND') AND length(w.answer) >= 50 THEN w.answer END) AS abstract,
  e.abstract IS NULL AS asked FROM e LEFT JOIN w ON w.doc_id = e.doc_id"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rules first, and landed answers for the pages they miss."""
    extracted = extraction.extract_abstracts(spread_scan(view(spark, sf, "publisher_page"))).select("doc_id", "abstract", F.col("abstract").isNull().alias("asked"))
    return extraction.with_answers(extracted, query(spark, sf, _ANSWERS), "doc_id").select("doc_id", "abstract", "asked")


@entry("state_abstracts", "X3", """
SELECT doc_id, CASE WHEN length(p) >= 100 THEN p END AS abstract FROM (SELECT doc_id, 'First ' || source || ' ' || lang || repeat(' word', n_chars % 40) || chr(10) || 'Second ' || lang AS p FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    words = F.concat("source", F.lit(" "), "lang", F.repeat(F.lit(" word"), (F.col("n_chars") % 40).cast("int")))
    return _state_abstracts(table(spark, sf, "documents"), words)


def _state_abstracts(documents: DataFrame, words: Column) -> DataFrame:
    """Abstracts out of pages whose embedded state holds ``words`` as first paragraph."""
    first = F.concat(F.lit('{"#name":"simple-para","_":"First '), words, F.lit('"},{"#name":"para","_":"Second '), "lang", F.lit('"}'))
    block = F.concat(F.lit('{"$$":['), first, F.lit('],"$":{"view":"all","class":"author"},"#name":"abstract"}'))
    other = F.lit('{"$$":[{"#name":"para","_":"A highlight"}],"$":{"view":"all","class":"author-highlights"},"#name":"abstract"},')
    page = F.concat(F.lit('<script>window.__PRELOADED_STATE__ = {"abstracts":{"content":['), other, block, F.lit("]}};</script>"))
    pages = documents.select("doc_id", F.lit("https://www.sciencedirect.com/x").alias("url"), page.alias("html"))
    return extraction.extract_abstracts(pages).select("doc_id", "abstract")


# a whole text as it may stand in the state: quotes, brackets and markup are blanks
_STATE_TEXT = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9.,]', ' '{0}), ' +', ' '{0}))"


@entry("state_texts", "X3", f"""
SELECT doc_id, CASE WHEN length(p) >= 100 THEN p END AS abstract FROM (SELECT doc_id, 'First ' || {_STATE_TEXT.format(", 'g'")} || chr(10) || 'Second ' || lang AS p FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """As ``state_abstracts`` with whole texts as paragraphs."""
    return _state_abstracts(table(spark, sf, "documents"), F.expr(_STATE_TEXT.format("")))


@entry("page_requests", "X6 X7", f"SELECT page_id, sha256({stripped_sql('html')}) AS content, FALSE AS is_cut FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extraction.extract_abstracts(spread_scan(table(spark, sf, "pages")))
    return extraction.model_requests(extracted).select("page_id", F.sha2("content", 256).alias("content"), "is_cut")


# pages around each document of which a model gets only a part: a description in either order of the attributes, a section, or the page
_QUOTED = "replace(replace(text, chr(34), ' '), chr(39), ' ')"
_FLAT = "replace(replace(text, '<', ' '), '>', ' ')"


@entry("shrunk_pages", "X6", f"""
WITH t AS (SELECT doc_id, lang, {strip_sql(_QUOTED)} AS quoted, {collapse_sql(_FLAT)} AS flat, {_FLAT} AS plain, {_QUOTED} AS raw FROM documents),
c AS (SELECT *, CASE WHEN lang IN ('en', 'fr') AND length(quoted) > 200 AND NOT starts_with(quoted, 'IEEE') THEN '{LEAD_DESCRIPTION}' || quoted
  WHEN lang = 'de' AND length(flat) > 100 AND NOT contains(lower(flat), 'show more') THEN '{LEAD_SECTION}' || flat END AS part,
  CASE lang WHEN 'en' THEN '<meta property="og:description" content="' || raw || '">' WHEN 'fr' THEN '<meta content="' || raw || '" property="og:description">'
    WHEN 'de' THEN '<h2>Abstract</h2>' || plain || '</div>' ELSE '<p>' || plain || '</p>' END AS html FROM t)
SELECT doc_id, left(coalesce(part, {stripped_sql('html')}), 1500) AS content, length(coalesce(part, {stripped_sql('html')})) > 1500 AND lang NOT IN ('en', 'fr') OR
  lang IN ('en', 'fr') AND part IS NULL AND length({stripped_sql('html')}) > 1500 AS is_cut FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    quoted, flat = F.translate("text", "\"'", "  "), F.translate("text", "<>", "  ")
    lang = F.col("lang")
    html = F.when(lang == "en", F.concat(F.lit('<meta property="og:description" content="'), quoted, F.lit('">'))).when(
        lang == "fr", F.concat(F.lit('<meta content="'), quoted, F.lit('" property="og:description">'))).when(
        lang == "de", F.concat(F.lit("<h2>Abstract</h2>"), flat, F.lit("</div>"))).otherwise(F.concat(F.lit("<p>"), flat, F.lit("</p>")))
    pages = table(spark, sf, "documents").select("doc_id", html.alias("html"), F.lit(None).cast("string").alias("abstract"))
    asked = extraction.model_requests(pages, most_page=1500, most_section=1500 - len(LEAD_SECTION))
    return asked.select("doc_id", F.left("content", F.lit(1500)).alias("content"), "is_cut")


@entry("stored_extractions", "X8 S9 S10", """
SELECT '10.1/x' || CAST(doc_id AS VARCHAR) AS doi, source AS title, text AS abstract, 1709337600000000 AS expires_us FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.concat(F.lit("10.1/X"), F.col("doc_id").cast("string")).alias("doi"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    return extraction.as_store_rows(found, AS_OF).select("doi", "title", "abstract", F.unix_micros("expires_at").alias("expires_us"))


@entry("enriched_works", "P6 X7 J6 A13")
def _(spark: SparkSession, sf: str) -> DataFrame:
    doi = F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))
    works = table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), doi.alias("doi"), F.when(F.col("source") == "src1", F.col("text")).alias("abstract"))
    pages = spread_scan(view(spark, sf, "publisher_page")).select(doi.alias("doi"), F.lit("").alias("title"), "url", "html")
    store = works.where("abstract IS NOT NULL").select("doi", "abstract", F.lit(None).cast("timestamp").alias("expires_at"))
    return enrich(works, store, pages, AS_OF, EchoCompleter())["candidates"].select("ordinal", "route", "abstract_from", "abstract")


# --- models ---

@entry("encoded_texts", "U1 C17")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), "text")
    vectors = encode_texts(texts, HashingEmbedder())
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("content_hash", F.size("embedding").cast("long").alias("dimensions"), rounded(norm, 4).alias("squared_norm"))


def _interests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("profile_id"), F.col("text").alias("description"))


@entry("encoded_queries", "U2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = _interests(spark, sf).withColumnRenamed("description", "refined_query")
    return interest_plan.query_vectors(queries, HashingEmbedder()).select("profile_id", F.size("query_vector").cast("long").alias("dimensions"))


@entry("completed_prompts", "U4")
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Title: "), F.col("source"), F.lit("\n"), F.col("text")).alias("prompt"))
    return complete_prompts(asked, EchoCompleter(), ["doc_id"]).select("doc_id", "answer", "tokens_used")


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')), lambda q: q <> '')"


@entry("reranked_works", "U3 W8", f"""
WITH q AS (SELECT item_id AS profile_id, text AS query FROM benchmark), d AS (SELECT conv_id % 40 AS profile_id, conv_id * 100 + turn AS ordinal, text FROM conversations),
w AS (SELECT d.profile_id, ordinal, {_WORDS.format("query")} AS a, {_WORDS.format("text")} AS b FROM d JOIN q ON q.profile_id = d.profile_id),
s AS (SELECT profile_id, ordinal, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) END AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, ordinal) AS rank FROM s)
SELECT profile_id, ordinal, rank, round(score, 6)::DOUBLE AS rerank_score FROM r WHERE rank <= 5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("profile_id"), F.col("text").alias("query"))
    documents = table(spark, sf, "conversations").select((F.col("conv_id") % 40).alias("profile_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"), F.col("text").alias("document"))
    return rerank(documents.join(queries, "profile_id"), OverlapReranker(), 5, split=True).withColumn("rerank_score", rounded("rerank_score"))


_RECALL = """
, q AS (SELECT profile_id, embedding::DOUBLE[] AS q FROM library l JOIN (SELECT profile_id AS p, min(key) AS k FROM library GROUP BY 1) m ON m.p = l.profile_id AND m.k = l.key),
c AS (SELECT ordinal, embedding::DOUBLE[] AS v FROM candidate),
s AS (SELECT q.profile_id, ordinal, list_dot_product(v, q) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(q, q)) + 1e-12)) AS similarity FROM c, q),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(similarity, 9) DESC, ordinal) AS recall_rank FROM s)"""


@entry("recalled_works", "W7", oracle("library candidate", _RECALL + """
SELECT profile_id, ordinal, recall_rank, round(similarity, 6)::DOUBLE AS similarity FROM r WHERE recall_rank <= 100"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.watch import fan_out

    library = view(spark, sf, "library")
    queries = library.groupBy("profile_id").agg(F.min_by("embedding", "key").alias("query_vector"))
    follows = library.select("profile_id").distinct().select("profile_id", F.explode(F.array(F.lit("arxiv"), F.lit("crossref"))).alias("source"))
    works = fan_out(view(spark, sf, "candidate").select("ordinal", "source", "embedding"), follows)
    return interest_plan.recall(works, queries, 100).select("profile_id", "ordinal", "recall_rank", rounded("similarity").alias("similarity"))


@entry("refined_interests", "U8 C21", f"""
SELECT item_id AS profile_id, {strip_sql("text")} AS refined_query, 0::BIGINT AS n_excluded FROM benchmark WHERE NOT contains(text, chr(10) || chr(10))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    refined = services.refine_interests(_interests(spark, sf), EchoCompleter())
    return refined.select("profile_id", "refined_query", F.size("exclude_keywords").cast("long").alias("n_excluded"))


def _works(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as works of four profiles."""
    return table(spark, sf, "documents").select(
        (F.col("doc_id") % 4).alias("profile_id"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("identifier"),
        F.when(F.col("lang") == "en", "arxiv").otherwise("crossref").alias("source"), F.concat("lang", F.lit(" "), "source").alias("title"), F.col("text").alias("abstract"),
        F.array("source", "lang").alias("authors"), F.when(F.col("lang") != "fr", F.col("lang")).alias("venue"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"),
        F.lit("").alias("url"), (F.col("n_chars") / 64).alias("score"), F.lit("consider").alias("label"), F.col("doc_id").alias("rank"),
        F.lit(AS_OF).cast("timestamp").alias("published"),
    )


@entry("summarized_works", "U5 C21 C24 S11", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'methodology: ' || left(lang || ' ' || source, 40) AS methodology, 'background: ' || left(lang || ' ' || source, 40) AS background, 'ok' AS status
FROM documents WHERE lang <> 'es'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = _works(spark, sf)
    stored = works.where("title LIKE 'es %'").select(F.col("identifier").alias("paper_id"))
    return services.summarize(works, stored, EchoCompleter(), AS_OF).select("paper_id", "bullets.methodology", "detailed.background", "status")


@entry("translated_titles", "U6 W11 J10 E4", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, lang || ' ' || source AS original_title, '译 ' || lang || ' ' || source AS translated_title FROM documents WHERE lang <> 'es'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = _works(spark, sf)
    stored = works.where("title LIKE 'es %'").select(F.col("identifier").alias("paper_id"), F.lit("zh-CN").alias("target_language"))
    return services.translate(works, stored, EchoCompleter(), AS_OF).select("paper_id", "original_title", "translated_title")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("profile_id"), F.substring("source", 4, 9).cast("long").alias("cluster_id"), "lang")
    return d.groupBy("profile_id", "cluster_id").agg(
        F.count("*").alias("member_count"), F.array_sort(F.collect_set("lang")).alias("titles"), F.array(F.min("lang")).alias("keywords"),
        F.when(F.col("cluster_id") == 3, "聚类 3").when(F.col("cluster_id") == 4, "named").alias("label"),
    )


@entry("labeled_clusters", "U7 C22 E4", """
WITH g AS (SELECT DISTINCT doc_id % 4 AS profile_id, CAST(substr(source, 4) AS BIGINT) AS cluster_id FROM documents)
SELECT profile_id, cluster_id, '主题 ' || CAST(row_number() OVER (PARTITION BY profile_id ORDER BY cluster_id) AS VARCHAR) AS label FROM g WHERE cluster_id <> 4""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return services.label_clusters(_clusters(spark, sf), EchoCompleter())


@entry("classified_domains", "U9 A26 W12", """
SELECT doc_id % 4 AS profile_id, '综合' AS domain, least(count(*), 200) AS paper_count, round(least(count(*), 200) * 100.0 / count(*), 6)::DOUBLE AS percentage FROM documents GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = _works(spark, sf).withColumnsRenamed({"identifier": "key", "authors": "tags"})
    return services.classify_domains(items, EchoCompleter()).select("profile_id", "domain", "paper_count", rounded("percentage").alias("percentage"))


@entry("domain_shares", "A26 C21", """
SELECT doc_id AS profile_id, source AS domain, 7::BIGINT AS paper_count, round(7 * 100.0 / n_chars, 6)::DOUBLE AS percentage FROM documents WHERE lang = 'en' AND n_chars > 0
UNION ALL SELECT doc_id, source, 7, 0.0 FROM documents WHERE lang = 'en' AND n_chars = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    answer = F.when(F.col("lang") == "en", F.concat(F.lit('```json\n{"domains": [{"domain": "'), "source", F.lit('", "paper_count": 7}]}\n```'))).otherwise(F.col("text"))
    replies = d.select(F.col("doc_id").alias("profile_id"), answer.alias("answer"))
    totals = d.select(F.col("doc_id").alias("profile_id"), F.col("n_chars").alias("total_papers"))
    return services.domain_shares(replies, totals).select("profile_id", "domain", "paper_count", rounded("percentage").alias("percentage"))


@entry("library_insights", "U9 C24 P7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    frames = stats.library_analytics(_items(spark, sf), _tags(spark, sf), _authors(spark, sf), LIBRARY_AS_OF)
    items = _items(spark, sf).select("profile_id", "key", F.col("venue").alias("title"), F.array("venue").alias("tags"))
    return services.generate_insights(frames, services.classify_domains(items, EchoCompleter()), EchoCompleter())


@entry("section_overviews", "U10 W12 C21", """
SELECT doc_id % 4 AS profile_id, 'similarity' AS section_type, count(*) AS paper_count FROM documents GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return services.summarize_section(_works(spark, sf), "similarity", EchoCompleter()).select("profile_id", "section_type", "paper_count")


@entry("overview_prompt_sizes", "U10 W12 C24", f"""
WITH r AS (SELECT doc_id % 4 AS profile_id, doc_id, lang || ' ' || source AS title, text, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id % 4) AS total FROM documents),
l AS (SELECT profile_id, total, string_agg(CAST(n AS VARCHAR) || '. ' || title || chr(10) || '   摘要片段：' || left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY n) AS papers
      FROM r WHERE n <= 10 GROUP BY ALL)
SELECT profile_id, sha256(replace(replace(replace('{prompts.SECTION_OVERVIEW.replace("'", "''")}', '{{paper_count}}', CAST(total AS VARCHAR)), '{{section_type}}', '相似度推荐'), '{{papers_list}}',
  papers || CASE WHEN total > 10 THEN chr(10) || chr(10) || '...还有 ' || CAST(total - 10 AS VARCHAR) || ' 篇论文' ELSE '' END)) AS prompt_hash FROM l""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return services.overview_prompts(_works(spark, sf), "similarity").select("profile_id", F.sha2("prompt", 256).alias("prompt_hash"))


@entry("interest_works", "P4 F9 U2 W7 U3 W8 J7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = _works(spark, sf)
    texts = works.select(F.col("identifier").alias("content_hash"), F.col("abstract").alias("text"))
    vectors = encode_texts(texts, HashingEmbedder()).withColumnRenamed("content_hash", "identifier")
    # every benchmark text is the interest of a profile of its own; works are dealt over them
    described = cut_lineage(_interests(spark, sf).select("profile_id", "description"))
    works = works.withColumn("profile_id", F.col("ordinal") % F.greatest(F.lit(described.count()), F.lit(1)))
    refined = services.refine_interests(described, EchoCompleter())
    chosen = interest_plan.select_interest_works(works.join(vectors, "identifier").drop("score", "label", "rank"), refined, HashingEmbedder(), OverlapReranker(),
                                                 view(spark, sf, "candidate_issn"), view(spark, sf, "journal"))
    return chosen.select("profile_id", "ordinal", "rank", rounded("score").alias("score"), rounded("journal_score").alias("journal_score"), "label")


# --- outputs ---

@entry("feed_items", "S17 C25 C7", """
WITH w AS (SELECT doc_id % 4 AS profile_id, doc_id AS rank, lang || ' ' || source AS title, lang, source, text, CASE WHEN lang <> 'fr' THEN lang END AS venue, '10.1/' || CAST(doc_id AS VARCHAR) AS doi, printf('%.3f', n_chars / 64.0) AS score, doc_id FROM documents),
h AS (SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM w),
i AS (SELECT profile_id, rank, title, CAST(doc_id AS VARCHAR) AS guid, source, lang, venue, doi,
  CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || 'Published: 2024-02-01T00:00:00+00:00' || chr(10) || 'Venue: ' || coalesce(venue, 'Unknown') || chr(10) || 'Score: ' || score || ' (consider)' AS description,
  '<p><strong>Authors:</strong> ' || source || '; ' || lang || '</p>' || chr(10) || CASE WHEN venue IS NOT NULL THEN '<p><strong>Journal:</strong> ' || venue || '</p>' || chr(10) ELSE '' END
  || '<p><strong>DOI:</strong> <a href="https://doi.org/' || doi || '">' || doi || '</a></p>' || chr(10) || '<p><strong>Relevance:</strong> ' || score || ' (consider)</p>' || CASE WHEN text <> '' THEN chr(10) || '<p>' || safe || '</p>' ELSE '' END AS content FROM h)
SELECT profile_id, rank, '<item><title>' || title || '</title><guid>' || guid || '</guid><pubDate>Thu, 01 Feb 2024 00:00:00 +0000</pubDate><dc:creator>' || source || '</dc:creator><dc:creator>' || lang || '</dc:creator>'
  || CASE WHEN lang = 'en' THEN '<dc:type>preprint</dc:type>' ELSE '' END || CASE WHEN venue IS NOT NULL THEN '<prism:publicationName>' || venue || '</prism:publicationName>' ELSE '' END
  || '<prism:doi>' || doi || '</prism:doi><description>' || replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</description><content:encoded>'
  || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</content:encoded></item>' AS item_xml FROM i""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.feed_xml(sinks.feed_items(_works(spark, sf), AS_OF))


@entry("note_payloads", "S18", """
SELECT doc_id % 4 AS profile_id, doc_id AS ordinal, '{"itemType":"note","note":"Recommended due to score ' || printf('%.3f', n_chars / 64.0)
  || '","tags":[{"tag":"recommendation"},{"tag":"consider"}],"collections":["Suggested"]}' AS payload FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.note_payload(_works(spark, sf), "Suggested")


@entry("report_works", "S20 C7", """
SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS published_local FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("published"))
    return sinks.report_works(works, "Asia/Shanghai").select("event_id", F.date_format("published_local", "yyyy-MM-dd HH:mm:ss").alias("published_local"))
