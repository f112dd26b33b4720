"""Filters, joins, stores and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures.views import AS_OF, oracle, query, table, view
from ..functions import text
from ..operators import dedupe, filters, joins, stats
from ..sources import readers, stores
from .base import entry, rounded, strip_sql
from .title_sql import loop_steps, similar_steps

_TYPED = """
SELECT doc_id, CASE lang WHEN 'fr' THEN 'attachment' WHEN 'de' THEN 'note' WHEN 'es' THEN NULL ELSE 'journalArticle' END AS "itemType" FROM documents"""


@entry("bibliographic_items", "F1", f"""
WITH t AS ({_TYPED}) SELECT doc_id, "itemType" AS item_type FROM t WHERE coalesce("itemType", '') NOT IN ('attachment', 'annotation', 'note')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    typed = query(spark, sf, _TYPED.replace('"itemType"', "`itemType`"))
    return filters.bibliographic(typed).withColumnRenamed("itemType", "item_type")


_TAGS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN CONCAT(' ', p_brand, ' ') WHEN l_tax > 0.07 THEN '' ELSE p_brand END AS tag, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey"


@entry("kept_tags", "F2", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice, tag FROM ({_TAGS}) WHERE tag <> '' AND trim(tag) NOT IN ('Brand#1', 'Brand#12')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.drop_tags(query(spark, sf, _TAGS), ["Brand#1 ", "Brand#12", " "])
    return kept.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "tag")


@entry("configured_categories", "F3 A12", """
WITH c AS (SELECT p_type FROM part GROUP BY p_type HAVING avg(p_size) > 25)
SELECT p_type AS primary_category, count(*) AS work_count FROM part WHERE p_type IN (SELECT p_type FROM c) GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "part").withColumnRenamed("p_type", "primary_category")
    wanted = works.groupBy("primary_category").agg(F.avg("p_size").alias("size")).where("size > 25")
    return stats.counts_by(filters.configured_categories(works, wanted), "primary_category")


_TITLES = """
SELECT doc_id, source AS venue, CASE source WHEN 'src1' THEN ' Table of Contents ' WHEN 'src2' THEN 'Errata' WHEN 'src3' THEN 'IEEE Transactions on Robotics'
  WHEN 'src4' THEN 'IEEE Transactions on Robotics 12' WHEN 'src5' THEN 'Guidelines: information for authors' WHEN 'src6' THEN 'SRC6' WHEN 'src7' THEN ''
  WHEN 'src8' THEN 'IEEE Signal Magazine' WHEN 'src9' THEN 'Corrections' WHEN 'src10' THEN '  ' ELSE SPLIT_PART(text, CHR(10), 1) END AS title FROM documents"""


@entry("article_titles", "F4", f"""
SELECT doc_id, title FROM ({_TITLES}) WHERE title <> '' AND NOT regexp_matches(trim(title), '(?i)^table of contents$|^masthead$|^editorial board$|^errat(a|um)$|^correction(s)?$|^retraction$|^connect\\. support\\. inspire\\.$|information for authors|publication information|author guidelines|instructions for authors|guide for authors|^ieee transactions on [a-z\\s]+$|^ieee journal of [a-z\\s]+$|^proceedings of the ieee$|^ieee [a-z\\s]+ magazine$')
  AND lower({strip_sql("title")}) <> lower(venue)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.articles(query(spark, sf, _TITLES)).select("doc_id", "title")


@entry("titled_works", "F5", f"""
SELECT doc_id, title FROM ({_TITLES}) WHERE length({strip_sql("title")}) > 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.titled(query(spark, sf, _TITLES)).select("doc_id", "title")


_ABSTRACTS = "SELECT doc_id % 4 AS profile_id, doc_id, CASE lang WHEN 'fr' THEN '  ' WHEN 'de' THEN NULL WHEN 'es' THEN '' ELSE text END AS abstract FROM documents"


@entry("library_with_abstract", "F6", f"SELECT profile_id, doc_id, abstract FROM ({_ABSTRACTS}) WHERE trim(abstract) <> ''")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_library_abstract(query(spark, sf, _ABSTRACTS)).select("profile_id", "doc_id", "abstract")


@entry("abstract_coverage", "A27", f"""
SELECT profile_id, count(*) FILTER (WHERE trim(abstract) <> '') AS with_abstract, count(*) FILTER (WHERE coalesce(trim(abstract), '') = '') AS without_abstract
FROM ({_ABSTRACTS}) GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.abstract_coverage(query(spark, sf, _ABSTRACTS))


@entry("candidates_with_abstract", "F7", f"SELECT doc_id, abstract FROM ({_ABSTRACTS}) WHERE abstract <> ''")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_candidate_abstract(query(spark, sf, _ABSTRACTS)).select("doc_id", "abstract")


@entry("recent_works", "F8", """
SELECT event_id FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "events").withColumn("published", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")))
    return filters.recent(works, "2024-01-20 15:30:00", 7).select("event_id")


_INTEREST = "SELECT b.item_id % 4 AS profile_id, MIN(UPPER(SPLIT_PART(b.text, ' ', 2))) AS a, MIN(LOWER(SPLIT_PART(b.text, ' ', 7))) AS b FROM benchmark b GROUP BY b.item_id % 4"


@entry("excluded_by_keyword", "F9", oracle("document_item", f"""
, i AS ({_INTEREST})
SELECT d.profile_id, d.key FROM document_item d JOIN i ON i.profile_id = d.profile_id
WHERE NOT (contains(lower(d.title || ' ' || d.abstract), lower(i.a)) OR contains(lower(d.title || ' ' || d.abstract), lower(i.b)))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    interests = query(spark, sf, _INTEREST).select("profile_id", F.array("a", "b").alias("exclude_keywords"))
    return filters.without_excluded(view(spark, sf, "document_item"), interests).select("profile_id", "key")


@entry("fetch_window", "F10", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.in_fetch_window(table(spark, sf, "events"), F.lit("2024-01-20 15:30:00").cast("timestamp_ntz"), 7, "ts").select("event_id")


@entry("newest_per_source", "F11", """
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 500""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("source"), F.col("ts").alias("published"))
    return filters.newest_per_source(works, 500).select(F.col("ordinal").alias("event_id"), F.col("source").alias("event_type"))


_ROUTED = "SELECT doc_id, CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN NULL ELSE text END AS abstract, CASE source WHEN 'src1' THEN '' WHEN 'src2' THEN NULL ELSE CONCAT('10.1/', source) END AS doi FROM documents"


@entry("abstract_routes", "F13", f"""
SELECT doc_id, CASE WHEN abstract <> '' THEN 'has_abstract' WHEN doi <> '' THEN 'needs_abstract' ELSE 'no_doi' END AS route FROM ({_ROUTED})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return query(spark, sf, _ROUTED).select("doc_id", filters.abstract_route().alias("route"))


@entry("listed_issn_works", "F15", oracle("journal candidate_issn", """
SELECT DISTINCT c.ordinal FROM candidate_issn c JOIN journal j ON j.issn = c.issn WHERE j.is_cn"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = view(spark, sf, "candidate_issn").groupBy("ordinal").agg(F.collect_set("issn").alias("issns"))
    return filters.with_listed_issn(works, view(spark, sf, "journal").where("is_cn")).select("ordinal")


# --- joins ---

_OFFERS = """
SELECT p.profile_id, w.ordinal, w.identifier, w.title, UPPER(w.doi) AS doi, CASE WHEN w.url LIKE 'https:%' THEN 'arxiv' ELSE 'crossref' END AS source
FROM page_work w JOIN (SELECT DISTINCT profile_id, source FROM (SELECT profile_id, 'arxiv' AS source FROM document_item UNION ALL SELECT profile_id, 'crossref' FROM document_item WHERE lang = 'en') s) p
  ON p.source = CASE WHEN w.url LIKE 'https:%' THEN 'arxiv' ELSE 'crossref' END"""


def offered_works(spark: SparkSession, sf: str) -> DataFrame:
    """Page works for the profiles that follow their source."""
    from ..plans.watch import fan_out

    works = view(spark, sf, "page_work").withColumn("source", F.when(F.col("url").like("https:%"), "arxiv").otherwise("crossref")).withColumn("doi", F.upper("doi"))
    items = view(spark, sf, "document_item")
    follows = items.select("profile_id", F.lit("arxiv").alias("source")).union(items.where("lang = 'en'").select("profile_id", F.lit("crossref")))
    return fan_out(works.drop("html", "url"), follows)


@entry("offered_works", "S15 E1", oracle("page_work document_item", f", o AS ({_OFFERS}) SELECT profile_id, ordinal, source FROM o"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return offered_works(spark, sf).select("profile_id", "ordinal", "source")


@entry("without_known_dois", "J1", oracle("page_work document_item", f"""
, o AS ({_OFFERS}) SELECT o.profile_id, o.ordinal FROM o WHERE NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.doi) = lower(o.doi))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.without_known_dois(offered_works(spark, sf), view(spark, sf, "document_item")).select("profile_id", "ordinal")


@entry("without_known_urls", "J2", oracle("page_work document_item", f"""
, o AS ({_OFFERS}) SELECT o.profile_id, o.ordinal FROM o WHERE NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.url) = lower(o.identifier))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.without_known_urls(offered_works(spark, sf), view(spark, sf, "document_item")).select("profile_id", "ordinal")


_KEY_SQL = "array_to_string(list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(trim({0}), '\\s+', ' ', 'g')), ' '), lambda q: q <> ''))), ' ')"


@entry("overlapping_titles", "C3 J3", oracle("page_work document_item", f"""
, a AS (SELECT DISTINCT {_KEY_SQL.format("title")} AS k FROM page_work), b AS (SELECT DISTINCT {_KEY_SQL.format("title")} AS k FROM document_item),
p AS (SELECT a.k AS left_key, b.k AS right_key, string_split(a.k, ' ') AS x, string_split(b.k, ' ') AS y FROM a, b WHERE a.k <> '' AND b.k <> ''),
q AS (SELECT *, list_intersect(x, y) AS s FROM p WHERE list_has_any(x, y)),
r AS (SELECT *, length(array_to_string(s, ' ')) AS ls, length(left_key) AS la, length(right_key) AS lb FROM q)
SELECT left_key, right_key FROM r WHERE len(s) = len(x) OR len(s) = len(y) OR (100 - 100 * (la - ls)::DOUBLE / (ls + la)) / 100 >= 0.9 OR (100 - 100 * (lb - ls)::DOUBLE / (ls + lb)) / 100 >= 0.9"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.overlapping_titles(dedupe.title_keys(view(spark, sf, "page_work")), dedupe.title_keys(view(spark, sf, "document_item")))


_ALIKE = f"""
, a AS (SELECT DISTINCT {_KEY_SQL.format("title")} AS k FROM page_work), b AS (SELECT DISTINCT {_KEY_SQL.format("title")} AS k FROM document_item),
p AS (SELECT a.k AS left_key, b.k AS right_key FROM a, b WHERE a.k <> '' AND b.k <> ''){similar_steps("p", "alike")}"""


@entry("similar_titles", "C3 J3", oracle("page_work document_item", f"{_ALIKE} SELECT left_key, right_key FROM alike"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.similar_titles(dedupe.title_keys(view(spark, sf, "page_work")), dedupe.title_keys(view(spark, sf, "document_item")))


_TITLED = f""", o AS (SELECT *, {_KEY_SQL.format("title")} AS k FROM ({_OFFERS})), d AS (SELECT DISTINCT profile_id, {_KEY_SQL.format("title")} AS k FROM document_item),
known AS (SELECT DISTINCT d.profile_id, left_key AS k FROM alike JOIN d ON d.k = right_key)"""


@entry("without_known_titles", "J3", oracle("page_work document_item", f"""{_ALIKE}{_TITLED}
SELECT profile_id, ordinal FROM o ANTI JOIN known USING (profile_id, k)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.without_known_titles(offered_works(spark, sf), view(spark, sf, "document_item")).select("profile_id", "ordinal")


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@entry("first_of_batch", "J4", _recursive(oracle("page_work document_item", f"""
, o AS (SELECT *, {_KEY_SQL.format("title")} AS k FROM ({_OFFERS})){loop_steps("o", "kept")} SELECT profile_id, ordinal FROM kept""")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_of_batch(offered_works(spark, sf)).select("profile_id", "ordinal")


@entry("first_by_title", "J4", oracle("document_item", f"""
, k AS (SELECT version AS ordinal, {_KEY_SQL.format("title")} AS k FROM document_item)
SELECT min(ordinal) AS ordinal FROM k WHERE k <> '' GROUP BY k UNION ALL SELECT ordinal FROM k WHERE k = ''"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    items = view(spark, sf, "document_item").select(
        F.lit(0).cast("long").alias("profile_id"), F.col("version").alias("ordinal"), F.col("key").alias("identifier"), none.alias("doi"), "title"
    )
    return dedupe.first_of_batch(items, fuzzy_titles=False).select("ordinal")


@entry("dedupe", "P5", _recursive(oracle("page_work document_item", f"""{_ALIKE}{_TITLED},
u AS MATERIALIZED (SELECT o.* FROM o ANTI JOIN known USING (profile_id, k)
  WHERE NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.doi) = lower(o.doi))
    AND NOT EXISTS (SELECT 1 FROM document_item d WHERE d.profile_id = o.profile_id AND lower(d.url) = lower(o.identifier))){loop_steps("u", "kept")}
SELECT profile_id, ordinal FROM kept""")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.dedupe(offered_works(spark, sf), view(spark, sf, "document_item")).select("profile_id", "ordinal")


_STORE = """
SELECT CAST(e.vec_id AS STRING) AS content_hash, CASE WHEN e.label < 5 THEN 'm1' ELSE 'm2' END AS model, e.embedding,
       CASE WHEN ev.event_type = 'view' THEN 'profile' ELSE 'candidate' END AS source_type,
       CAST(ev.ts AS TIMESTAMP) AS created_at, CASE WHEN ev.event_type = 'view' THEN NULL ELSE CAST(ev.ts AS TIMESTAMP) + INTERVAL '7' DAY END AS expires_at
FROM embeddings e JOIN events ev ON ev.event_id = e.vec_id"""
_TEXTS = "SELECT doc_id, CAST(doc_id AS STRING) AS content_hash, text FROM documents"
_CACHE_NOW = "2024-01-07 12:00:00"
_LIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{_CACHE_NOW}')"


@entry("embedding_lookup", "S8 F12 J5", f"""
WITH s AS ({_STORE}), t AS ({_TEXTS})
SELECT t.doc_id, s.content_hash IS NOT NULL AS is_hit, round(list_sum(s.embedding::DOUBLE[]), 6)::DOUBLE AS total FROM t LEFT JOIN s ON s.content_hash = t.content_hash AND s.model = 'm1' AND {_LIVE}""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = joins.embedding_hits(query(spark, sf, _TEXTS), query(spark, sf, _STORE), "m1", _CACHE_NOW)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return hits.select("doc_id", "is_hit", rounded(total).alias("total"))


@entry("embedding_misses", "J5 E4", f"""
WITH s AS ({_STORE}), t AS (SELECT sha256(text) AS content_hash, text FROM documents UNION ALL SELECT content_hash, text FROM ({_TEXTS}))
SELECT t.content_hash, min(t.text) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.content_hash = t.content_hash AND s.model = 'm2' AND {_LIVE}) GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = query(spark, sf, _TEXTS).select("content_hash", "text")
    hashed = texts.select(text.content_hash(F.col("text")).alias("content_hash"), "text")
    return joins.embedding_misses(hashed.union(texts), query(spark, sf, _STORE), "m2", _CACHE_NOW)


@entry("embedding_cache_rates", "A25", f"""
WITH s AS ({_STORE}), t AS ({_TEXTS})
SELECT count(s.content_hash) AS hits, count(*) - count(s.content_hash) AS misses, round(100.0 * count(s.content_hash) / count(*), 6)::DOUBLE AS hit_rate
FROM t LEFT JOIN s ON s.content_hash = t.content_hash AND s.model = 'm1' AND {_LIVE}""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = joins.embedding_hits(query(spark, sf, _TEXTS), query(spark, sf, _STORE), "m1", _CACHE_NOW)
    return hits.agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"),
                    rounded(F.lit(100.0) * F.count_if("is_hit") / F.count("*")).alias("hit_rate"))


@entry("embedding_store_write", "S9", f"""
WITH s AS ({_STORE}), n AS (SELECT CAST(doc_id AS VARCHAR) AS content_hash, 'm1' AS model, 'new' AS source_type, TIMESTAMP '2024-02-01 00:00:00' AS created_at,
  TIMESTAMP '2024-02-08 00:00:00' AS expires_at FROM documents)
SELECT content_hash, model, source_type, epoch_us(created_at) AS created_us, epoch_us(expires_at) AS expires_us FROM n
UNION ALL SELECT content_hash, model, source_type, epoch_us(created_at), epoch_us(expires_at) FROM s WHERE (content_hash, model) NOT IN (SELECT content_hash, model FROM n)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    new = query(spark, sf, _TEXTS).select("content_hash", F.lit("m1").alias("model"), F.array().cast("array<float>").alias("embedding"), F.lit("new").alias("source_type"))
    merged = stores.merge(query(spark, sf, _STORE), stores.with_expiry(new, AS_OF, 7), ["content_hash", "model"], ["created_at"])
    return merged.select("content_hash", "model", "source_type", F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"))


@entry("cache_hygiene", "S19 T3", f"""
WITH s AS ({_STORE})
SELECT model, source_type, count(*) AS entries, count(*) FILTER (WHERE NOT {_LIVE}) AS expired_entries FROM s GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stores.store_counts(query(spark, sf, _STORE), _CACHE_NOW)


@entry("cache_after_cleanup", "S19 T2", f"""
WITH s AS ({_STORE}) SELECT content_hash, model FROM s WHERE {_LIVE} AND source_type <> 'profile' AND model <> 'm2'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = stores.live(query(spark, sf, _STORE), _CACHE_NOW)
    return stores.invalidate(stores.invalidate(kept, F.col("source_type") == "profile"), F.col("model") == "m2").select("content_hash", "model")


_CACHED = "SELECT CONCAT('10.1/SRC', SUBSTR(source, 4)) AS doi, MIN(text) AS abstract FROM documents WHERE lang = 'en' GROUP BY source HAVING COUNT(*) > 30"
_FRESH = "SELECT CONCAT('10.1/', source) AS doi, MAX(text) AS abstract FROM documents WHERE lang = 'es' GROUP BY source"
_FILL = f"""
c AS (SELECT lower(doi) AS doi, abstract FROM ({_CACHED})), f AS (SELECT lower(doi) AS doi, abstract FROM ({_FRESH})),
r AS (SELECT *, CASE WHEN abstract <> '' THEN 'has_abstract' WHEN doi <> '' THEN 'needs_abstract' ELSE 'no_doi' END AS route FROM ({_ROUTED})),
j AS (SELECT r.doc_id, r.route, r.abstract AS own, f.abstract AS fresh, c.abstract AS cached FROM r LEFT JOIN c ON c.doi = lower(r.doi) LEFT JOIN f ON f.doi = lower(r.doi)),
e AS (SELECT doc_id, route, CASE WHEN route = 'needs_abstract' THEN coalesce(fresh, cached, own) ELSE own END AS abstract,
  CASE WHEN route = 'has_abstract' THEN 'own' WHEN route = 'no_doi' THEN NULL WHEN fresh IS NOT NULL THEN 'fresh' WHEN cached IS NOT NULL THEN 'cache' END AS abstract_from FROM j)"""


@entry("filled_abstracts", "J6", f"WITH {_FILL} SELECT doc_id, route, abstract, abstract_from FROM e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.fill_abstracts(query(spark, sf, _ROUTED), query(spark, sf, _CACHED), query(spark, sf, _FRESH)).select("doc_id", "route", "abstract", "abstract_from")


@entry("enrichment_stats", "A13", f"""
WITH {_FILL}
SELECT count(*) AS total_candidates, count(*) FILTER (WHERE route = 'has_abstract') AS with_abstract, count(*) FILTER (WHERE route = 'needs_abstract') AS missing_abstracts,
  count(*) FILTER (WHERE route = 'no_doi') AS skipped_no_doi, count(*) FILTER (WHERE abstract_from = 'cache') AS cache_hits, count(*) FILTER (WHERE abstract_from = 'fresh') AS fetched,
  count(*) FILTER (WHERE abstract_from IN ('cache', 'fresh')) AS enriched, count(*) FILTER (WHERE route = 'needs_abstract' AND abstract_from IS NULL) AS failed,
  round(100.0 * count(*) FILTER (WHERE route = 'has_abstract') / count(*), 6)::DOUBLE AS original_rate, round(100.0 * count(abstract_from) / count(*), 6)::DOUBLE AS final_rate FROM e""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    filled = joins.fill_abstracts(query(spark, sf, _ROUTED), query(spark, sf, _CACHED), query(spark, sf, _FRESH))
    out = stats.enrichment_stats(filled)
    return out.withColumns({c: rounded(c) for c in ("original_rate", "final_rate")})


@entry("merged_abstracts", "E2 S10", f"""
WITH c AS (SELECT lower(doi) AS doi, abstract FROM ({_CACHED})), f AS (SELECT lower(doi) AS doi, abstract FROM ({_FRESH}))
SELECT coalesce(c.doi, f.doi) AS doi, coalesce(f.abstract, c.abstract) AS abstract FROM c FULL JOIN f ON c.doi = f.doi""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.merged_abstracts(query(spark, sf, _CACHED), query(spark, sf, _FRESH))


@entry("uncached_dois", "E4 S10", f"""
SELECT DISTINCT lower(doi) AS doi FROM ({_ROUTED}) WHERE doi <> '' AND lower(doi) NOT IN (SELECT lower(doi) FROM ({_CACHED}))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = query(spark, sf, _ROUTED).where("doi <> ''").select(F.lower("doi").alias("doi")).distinct()
    return joins.missing_from_store(wanted, query(spark, sf, _CACHED).select(F.lower("doi").alias("doi")), "doi")


@entry("journal_scores", "J7 C13", oracle("journal candidate_issn candidate", """
, u AS (SELECT issn, impact_factor, is_cn, CASE WHEN is_cn THEN 0.7 WHEN impact_factor IS NOT NULL THEN least(1.0, ln(impact_factor + 1) / ln(25.0)) END AS listed FROM journal),
m AS (SELECT c.ordinal, u.*, row_number() OVER (PARTITION BY c.ordinal ORDER BY c.pos) AS n FROM candidate_issn c JOIN u ON u.issn = c.issn WHERE u.listed IS NOT NULL),
o AS (SELECT DISTINCT ordinal FROM candidate_issn),
w AS (SELECT o.ordinal, coalesce(c.source, 'crossref') AS source FROM o LEFT JOIN candidate c ON c.ordinal = o.ordinal)
SELECT w.ordinal, round(CASE WHEN w.source = 'arxiv' THEN 0.6 ELSE coalesce(m.listed, 0.3) END, 6)::DOUBLE AS journal_score,
  CASE WHEN w.source <> 'arxiv' AND NOT coalesce(m.is_cn, FALSE) THEN m.impact_factor END AS impact_factor, w.source <> 'arxiv' AND coalesce(m.is_cn, FALSE) AS is_cn_core
FROM w LEFT JOIN m ON m.ordinal = w.ordinal AND m.n = 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    issns = view(spark, sf, "candidate_issn")
    known = view(spark, sf, "candidate").select("ordinal", "source")
    works = issns.select("ordinal").distinct().join(known, "ordinal", "left").select("ordinal", F.coalesce("source", F.lit("crossref")).alias("source"))
    return joins.journal_scores(works, issns, view(spark, sf, "journal")).withColumn("journal_score", rounded("journal_score"))


_TRANSLATED = "SELECT CAST(item_id AS STRING) AS paper_id, 'zh-CN' AS target_language, text AS translated_title FROM benchmark"


@entry("attached_translations", "J10 S12", f"""
SELECT d.doc_id, t.translated_title, t.paper_id IS NULL AS to_translate FROM documents d LEFT JOIN ({_TRANSLATED}) t ON t.paper_id = CAST(d.doc_id AS VARCHAR)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("identifier"))
    stored = query(spark, sf, _TRANSLATED).withColumnRenamed("paper_id", "identifier")
    todo = joins.missing_from_store(works, stored).select("identifier", F.lit(True).alias("to_translate"))
    return joins.attach_store(joins.attach_store(works, stored), todo).select("doc_id", "translated_title", F.coalesce("to_translate", F.lit(False)).alias("to_translate"))


@entry("calendar_gaps", "J12", """
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 90 GROUP BY ALL),
k AS (SELECT t.event_type, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT event_type FROM events) t, generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) AS d(day))
SELECT k.event_type, strftime(k.day, '%Y-%m-%d') AS day, coalesce(c.n, 0) AS n FROM k LEFT JOIN c ON c.event_type = k.event_type AND c.day = k.day""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    counts = events.where("value > 90").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date")))
    calendar = events.select("event_type").distinct().select("event_type", days.alias("day"))
    return joins.fill_gaps(counts, calendar, ["event_type", "day"], "n").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_OLD = "SELECT doc_id % 4 AS profile_id, CAST(doc_id AS STRING) AS key, CASE WHEN lang = 'fr' THEN NULL ELSE text END AS h FROM documents WHERE lang <> 'es'"
_NEW = "SELECT doc_id % 4 AS profile_id, CAST(doc_id AS STRING) AS key, CASE WHEN lang = 'fr' THEN NULL WHEN source = 'src1' THEN 'x' ELSE text END AS h FROM documents WHERE lang <> 'de'"


@entry("hash_changes", "J13", f"""
SELECT coalesce(o.profile_id, n.profile_id) AS profile_id, coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'gone'
  WHEN o.h IS NOT DISTINCT FROM n.h THEN 'same' ELSE 'changed' END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.profile_id = n.profile_id AND o.key = n.key""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    def hashed(sql: str) -> DataFrame:
        return query(spark, sf, sql).select("profile_id", "key", F.when(F.col("h").isNotNull(), text.content_hash(F.col("h"))).alias("content_hash"))

    return joins.hash_changes(hashed(_OLD), hashed(_NEW))


_STATE = "SELECT c_custkey AS profile_id, 'embedding_signature' AS key, c_mktsegment AS value FROM customer WHERE c_acctbal > 0"


@entry("rebuild_decisions", "J14 T2", f"""
SELECT c.c_custkey AS profile_id, s.value AS stored_signature, c.c_nationkey > 3 AS has_artifacts,
  NOT (c.c_nationkey > 3) OR (s.value IS DISTINCT FROM 'BUILDING') AS rebuild FROM customer c LEFT JOIN ({_STATE}) s ON s.profile_id = c.c_custkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    profiles = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), (F.col("c_nationkey") > 3).alias("has_artifacts"))
    return joins.rebuild_decision(profiles, query(spark, sf, _STATE), "BUILDING").select("profile_id", "has_artifacts", "stored_signature", "rebuild")


@entry("item_weights", "J15", oracle("library_item", """
, w AS (SELECT profile_id, key, o_totalprice AS weight FROM library_item JOIN orders ON CAST(o_orderkey AS VARCHAR) = key WHERE o_orderstatus = 'F')
SELECT i.profile_id, i.key, coalesce(w.weight, 1.0)::DOUBLE AS weight FROM library_item i LEFT JOIN w ON w.profile_id = i.profile_id AND w.key = i.key"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "library_item")
    priced = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("weight"))
    return joins.with_weights(items.select("profile_id", "key"), items.select("profile_id", "key").join(priced, "key"))


@entry("sections_union", "E3", """
WITH r AS (SELECT doc_id % 4 AS profile_id, source AS identifier, doc_id AS ordinal, 0 AS s FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id % 4, source, doc_id, 1 FROM documents WHERE lang = 'fr')
SELECT profile_id, identifier, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, identifier ORDER BY s, ordinal) AS n FROM r) WHERE n = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("profile_id"), F.col("source").alias("identifier"), F.col("doc_id").alias("ordinal"), "lang")
    return joins.union_works(d.where("lang = 'en'").drop("lang"), d.where("lang = 'fr'")).select("profile_id", "identifier", "ordinal")


# --- library store ---

_EDITED = "SELECT profile_id, key, version + 1 AS version, date_added, year, raw_date, CONCAT('new ', venue) AS venue FROM library_item WHERE venue = 'BUILDING'"
_DELETED = "SELECT profile_id, key, version + 2 AS version FROM library_item WHERE venue = 'MACHINERY'"


@entry("library_scan", "S5", oracle("library_item", "SELECT profile_id, count(*) AS item_count, min(key) AS first_key, count(DISTINCT venue) AS venues FROM library_item GROUP BY 1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "library_item").groupBy("profile_id").agg(
        F.count("*").alias("item_count"), F.min("key").alias("first_key"), F.count_distinct("venue").alias("venues")
    )


@entry("library_upsert", "S6", oracle("library_item", f"""
, e AS ({_EDITED})
SELECT profile_id, key, version, venue FROM e UNION ALL SELECT profile_id, key, version, venue FROM library_item WHERE venue <> 'BUILDING'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    current = view(spark, sf, "library_item")
    edited = current.where("venue = 'BUILDING'").withColumn("version", F.col("version") + 1).withColumn("venue", F.concat(F.lit("new "), "venue"))
    return stores.merge(current, edited, ["profile_id", "key"], ["version"]).select("profile_id", "key", "version", "venue")


@entry("library_tombstones", "S7", oracle("library_item", f", t AS ({_DELETED}) SELECT i.profile_id, i.key FROM library_item i WHERE i.key NOT IN (SELECT key FROM t)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    current = view(spark, sf, "library_item")
    return stores.without_tombstones(current, current.where("venue = 'MACHINERY'"), ["profile_id", "key"]).select("profile_id", "key")


@entry("high_water_marks", "S14 A25", oracle("library_item", "SELECT profile_id, max(version) AS high_water FROM library_item GROUP BY 1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stores.high_water_marks(view(spark, sf, "library_item"))


_SYNC_SPLIT = "raw_date < '1999-01-01'"


@entry("library_sync", "T1 P8", oracle("library_item", f"""
, c AS (SELECT * FROM library_item WHERE {_SYNC_SPLIT}), m AS (SELECT profile_id, max(version) AS hw FROM c GROUP BY 1),
n AS (SELECT i.* FROM (SELECT profile_id, key, version + 20000000 AS version, 'edited' AS venue FROM library_item WHERE venue = 'BUILDING'
      UNION ALL SELECT profile_id, key, version, venue FROM library_item WHERE NOT ({_SYNC_SPLIT})) i JOIN m ON m.profile_id = i.profile_id WHERE i.version > m.hw),
t AS (SELECT i.profile_id, i.key FROM library_item i JOIN m ON m.profile_id = i.profile_id WHERE venue = 'MACHINERY' AND i.version + 30000000 > m.hw),
a AS (SELECT profile_id, key, version, venue FROM c UNION ALL SELECT * FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY profile_id, key ORDER BY version DESC) AS r FROM a)
SELECT profile_id, key, version, venue FROM l WHERE r = 1 AND (profile_id, key) NOT IN (SELECT profile_id, key FROM t)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.ingest import sync

    items = view(spark, sf, "library_item").withColumn("content_hash", F.col("venue"))
    current, later = items.where(_SYNC_SPLIT), items.where(f"NOT ({_SYNC_SPLIT})")
    edited = items.where("venue = 'BUILDING'").withColumn("version", F.col("version") + 20000000).withColumn("venue", F.lit("edited"))
    gone = items.where("venue = 'MACHINERY'").select("profile_id", "key", (F.col("version") + 30000000).alias("version"))
    return sync(current, later.union(edited), gone)["library"].select("profile_id", "key", "version", "venue")


@entry("sync_stats", "A25 T1", oracle("library_item", """
, s AS (SELECT profile_id, count(*) FILTER (WHERE venue = 'BUILDING') AS fetched, count(*) FILTER (WHERE venue = 'MACHINERY') AS removed,
  greatest(max(version + 20000000) FILTER (WHERE venue = 'BUILDING'), max(version + 30000000) FILTER (WHERE venue = 'MACHINERY')) AS high_water FROM library_item GROUP BY 1)
SELECT profile_id, fetched, fetched AS updated, removed, high_water FROM s"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.ingest import sync

    items = view(spark, sf, "library_item").withColumn("content_hash", F.col("venue"))
    edited = items.where("venue = 'BUILDING'").withColumn("version", F.col("version") + 20000000)
    gone = items.where("venue = 'MACHINERY'").select("profile_id", "key", (F.col("version") + 30000000).alias("version"))
    return sync(items, edited, gone)["stats"]


_SUMMARY = "SELECT CAST(doc_id AS STRING) AS paper_id, CASE WHEN lang = 'en' THEN 's1' ELSE 's2' END AS signature, text AS bullets, doc_id AS generated FROM documents"


@entry("summary_store", "S11 S13", f"""
WITH s AS ({_SUMMARY}), n AS (SELECT paper_id, signature, 'again' AS bullets FROM s WHERE generated % 3 = 0)
SELECT paper_id, bullets FROM n WHERE signature = 's1' UNION ALL SELECT paper_id, bullets FROM s WHERE signature = 's1' AND generated % 3 <> 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored = query(spark, sf, _SUMMARY)
    again = stored.where("generated % 3 = 0").withColumn("bullets", F.lit("again")).withColumn("generated", F.col("generated") + 1)
    # another signature is another part of the store: its rows are not read
    return stores.merge(stored, again, ["paper_id", "signature"], ["generated"]).where("signature = 's1'").select("paper_id", "bullets")


# --- landed files, built as JSON or CSV text from the given tables and parsed again ---

@entry("library_records", "S1 F1 F2 C5 C11 C18", """
WITH d AS (SELECT doc_id, text, lang, source FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS key, doc_id AS version, source AS title, text AS abstract, 'Ann ' || source AS creators, lang AS tags,
  CASE WHEN lang = 'en' THEN NULL ELSE 2020 END::BIGINT AS year, 1704067200000000 AS added_us, CASE WHEN lang = 'en' THEN 'Proc ' || source ELSE 'J ' || source END AS venue,
  sha256(source || CASE WHEN text = '' THEN '' ELSE chr(0) || text END || chr(0) || 'Ann ' || source || chr(0) || lang) AS content_hash
FROM d WHERE lang <> 'de'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    data = F.struct(
        c("doc_id").cast("string").alias("key"), c("doc_id").alias("version"), F.when(c("lang") == "de", "note").otherwise("journalArticle").alias("itemType"),
        c("source").alias("title"), c("text").alias("abstractNote"),
        F.array(F.struct(F.lit("Ann").alias("firstName"), c("source").alias("lastName")), F.struct(F.lit("").alias("firstName"), F.lit("").alias("lastName"))).alias("creators"),
        F.array(F.struct(c("lang").alias("tag")), F.struct(F.lit(" private ").alias("tag")), F.struct(F.lit("").alias("tag"))).alias("tags"),
        F.array().cast("array<string>").alias("collections"), F.when(c("lang") == "en", "03/2024").otherwise("2020-05").alias("date"),
        F.lit("2024-01-01T00:00:00Z").alias("dateAdded"), F.when(c("lang") != "en", F.concat(F.lit("J "), "source")).otherwise("").alias("publicationTitle"),
        F.concat(F.lit("Proc "), "source").alias("conferenceName"),
    )
    landed = table(spark, sf, "documents").select(F.to_json(F.struct(none.alias("key"), data.alias("data"))).alias("line"))
    records = landed.select(F.from_json("line", readers.LIBRARY_ITEM).alias("r")).select("r.*")
    parsed = readers.parse_library_items(records, ["private"])
    return parsed.select("key", "version", "title", "abstract", F.array_join("creators", "|").alias("creators"), F.array_join("tags", "|").alias("tags"),
                         F.col("year").cast("long").alias("year"), F.unix_micros("date_added").alias("added_us"), "venue", "content_hash")


@entry("article_records", "S2 C4 F4 F5", oracle("page_work", """
, d AS (SELECT w.*, lower(venue) AS v FROM page_work w)
SELECT ordinal, doi AS identifier, trim(title) AS title, 'See ' || ordinal AS abstract, 'Q ' || v || '|Solo' AS authors, v AS venue, 3.0::DOUBLE AS referenced, 1704110400000000 AS published_us, '1|2' AS issns
FROM d WHERE trim(title) <> '' AND v NOT LIKE 'blog.%'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    blog = c("venue").startswith("blog.")
    item = F.struct(
        c("doi").alias("DOI"), F.array(F.when(blog, "Masthead").otherwise(c("title"))).alias("title"),
        F.array(F.struct(F.lit("Q").alias("given"), c("venue").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Solo").alias("family"))).alias("author"),
        F.concat(F.lit("<jats:p>See&nbsp;&lt;b&gt; "), c("ordinal").cast("string"), F.lit("</jats:p>")).alias("abstract"), F.array("venue").alias("container-title"),
        F.struct(F.lit("2024-01-01T12:00:00Z").alias("date-time")).alias("created"), c("url").alias("URL"), F.lit(3).alias("is-referenced-by-count"), F.array(F.lit("1"), F.lit("2")).alias("ISSN"),
    )
    works = view(spark, sf, "page_work").withColumn("venue", F.lower("venue"))
    landed = works.select("ordinal", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("page"))
    pages = landed.select("ordinal", F.from_json("page", readers.ARTICLE_PAGE).alias("p")).select("ordinal", F.explode("p.message.items").alias("item"))
    return readers.parse_article_items(pages).select(
        "ordinal", "identifier", "title", "abstract", F.array_join("authors", "|").alias("authors"), "venue", c("metrics")["is-referenced-by"].alias("referenced"),
        F.unix_micros("published").alias("published_us"), F.array_join("issns", "|").alias("issns"),
    )


_JOURNAL_ROWS = """
SELECT CASE WHEN p_size = 1 THEN ' ' ELSE CONCAT(' ', CAST(p_partkey AS STRING)) END AS issn, p_name AS title, CASE WHEN p_type = 'PROMO' THEN 'Core (CN)' ELSE p_type END AS category,
       CASE WHEN p_size < 10 THEN 'NA' WHEN p_size < 12 THEN '' ELSE CONCAT(CAST(p_size AS STRING), '.5') END AS impact_factor FROM part"""


@entry("journal_list", "S4", f"""
SELECT trim(issn) AS issn, title, category, CASE WHEN impact_factor IN ('NA', '') THEN NULL ELSE impact_factor::DOUBLE END AS impact_factor, contains(category, '(CN)') AS is_cn
FROM ({_JOURNAL_ROWS}) WHERE trim(issn) <> ''""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = query(spark, sf, _JOURNAL_ROWS).select(F.to_csv(F.struct("issn", "title", "category", "impact_factor")).alias("line"))
    return readers.parse_journals(lines.select(F.from_csv("line", readers.JOURNAL_ROW, {"ignoreLeadingWhiteSpace": "false"}).alias("r")).select("r.*"))


@entry("source_union", "S15 E1", """
SELECT 'arxiv' AS source, CAST(vec_id AS VARCHAR) AS identifier, NULL AS title, CAST(label AS BIGINT) AS label FROM embeddings
UNION ALL SELECT 'crossref', url, CAST(length(html) AS VARCHAR), NULL FROM pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    registry = readers.SourceRegistry()
    registry.register("arxiv", lambda s, p: s.read.parquet(p).select(F.lit("arxiv").alias("source"), F.col("vec_id").cast("string").alias("identifier"), F.col("label").cast("long").alias("label")))
    registry.register("crossref", lambda s, p: s.read.parquet(p).select(F.lit("crossref").alias("source"), F.col("url").alias("identifier"), F.length("html").cast("string").alias("title")))
    registry.register("broken", lambda s, p: s.read.parquet(p))
    merged, failed = registry.read(spark, {"arxiv": f"{sf}/embeddings.parquet", "crossref": f"{sf}/pages.parquet", "broken": f"{sf}/no_such_table.parquet"})
    assert failed == ["broken"]
    return merged.select("source", "identifier", "title", "label")


@entry("registered_sources", "S16", "SELECT 'pages' AS source, count(*) AS works FROM pages UNION ALL SELECT 'documents', count(*) FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    registry = readers.SourceRegistry()
    for name in ("pages", "documents", "embeddings"):
        registry.register(name, lambda s, p, n=name: s.read.parquet(p).select(F.lit(n).alias("source")))
    merged, _ = registry.read(spark, {n: f"{sf}/{n}.parquet" for n in registry.enabled(["pages", "documents"])})
    return merged.groupBy("source").agg(F.count("*").alias("works"))


_ENTRIES = """
SELECT ordinal, CONCAT('<entry><id>', identifier, '</id><title> ', REPLACE(REPLACE(title, '&', '&amp;'), '<', '&lt;'), '</title><summary> s </summary>',
  '<published>2024-01-01T00:00:00Z</published><author><name>', venue, '</name></author><author><name>B</name></author>',
  '<link href="', identifier, '" rel="alternate"/><link href="x" rel="related"/><arxiv:doi>', doi, '</arxiv:doi><arxiv:primary_category term="',
  CASE WHEN url LIKE 'https:%' THEN 'cs.AI' ELSE 'math.CO' END, '"/></entry>') AS entry_xml FROM page_work"""


@entry("atom_entries", "S3 F3", oracle("page_work", """
SELECT identifier, trim(title) AS title, 's' AS abstract, identifier AS url, doi, venue || '|B' AS authors, 'cs.AI' AS primary_category, 1704067200000000 AS published_us
FROM page_work WHERE trim(title) <> '' AND url LIKE 'https:%'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "page_work").createOrReplaceTempView("page_work")
    made = spark.sql(_ENTRIES)
    entries = made.select(F.from_xml("entry_xml", readers.FEED_ENTRY, {"rowTag": "entry", "attributePrefix": "_"}).alias("e")).select("e.*")
    return readers.parse_feed_entries(entries, ["cs.AI"]).select(
        "identifier", "title", "abstract", "url", "doi", F.array_join("authors", "|").alias("authors"), "primary_category", F.unix_micros("published").alias("published_us")
    )
