"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures.views import oracle, query, table, view
from ..functions import answers, clock, feed, prompts, scoring, text, titles
from ..functions.pages import clean_texts, detect_publisher, is_highlights, meta_content, stripped_page
from ..operators.stats import venue_type
from .base import collapse_sql, entry, rounded, strip_sql, stripped_sql, unescape_sql
from .title_sql import full_ratio, ratio_steps


@entry("normalized_identifiers", "C1", f"""
SELECT page_id, lower({strip_sql("url")}) AS identifier FROM pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.normalize_identifier(F.col("url")).alias("identifier"))


@entry("normalized_titles", "C2", f"""
SELECT doc_id, lower({collapse_sql("text")}) AS title FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("title"))


def _title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    works = view(spark, sf, "page_work").select("ordinal", text.normalize_title(F.col("title")).alias("a"))
    items = view(spark, sf, "document_item").select("version", text.normalize_title(F.col("title")).alias("b"))
    return works.join(items, F.col("ordinal") == F.col("version"))


_TOKENS = "list_sort(list_distinct(list_filter(string_split({}, ' '), lambda q: q <> '')))"

@entry("title_overlap_ratios", "C3", oracle("page_work document_item", f"""
, p AS (SELECT w.ordinal, {_TOKENS.format(f"lower({collapse_sql('w.title')})")} AS a, {_TOKENS.format(f"lower({collapse_sql('d.title')})")} AS b
        FROM page_work w JOIN document_item d ON d.version = w.ordinal),
q AS (SELECT ordinal, a, b, list_sort(list_filter(a, lambda t: list_contains(b, t))) AS s FROM p),
r AS (SELECT ordinal, len(a) AS na, len(b) AS nb, len(s) AS ns, length(array_to_string(a, ' ')) AS la,
             length(array_to_string(b, ' ')) AS lb, length(array_to_string(s, ' ')) AS ls FROM q)
SELECT ordinal, round(CASE WHEN ns = 0 THEN 0.0 WHEN ns = na OR ns = nb THEN 1.0
       ELSE greatest(1.0 - (la - ls)::DOUBLE / (ls + la), 1.0 - (lb - ls)::DOUBLE / (ls + lb)) END, 6)::DOUBLE AS ratio FROM r"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _title_pairs(spark, sf).select(
        "ordinal", rounded(titles.overlap_ratio(titles.token_key(F.col("a")), titles.token_key(F.col("b")))).alias("ratio")
    )


@entry("title_token_set_ratios", "C3", oracle("page_work document_item", f"""
, p AS (SELECT w.ordinal, {_TOKENS.format(f"lower({collapse_sql('w.title')})")} AS ta, {_TOKENS.format(f"lower({collapse_sql('d.title')})")} AS tb
        FROM page_work w JOIN document_item d ON d.version = w.ordinal){ratio_steps("p", "q")},
r AS (SELECT *, CASE WHEN length(xa) < length(xb) THEN xa ELSE xb END AS u, CASE WHEN length(xa) < length(xb) THEN xb ELSE xa END AS v FROM q)
SELECT ordinal, round((CASE WHEN cheap = 100 OR len(ta) = 0 OR len(tb) = 0 THEN cheap ELSE {full_ratio('u', 'v')} END) / 100, 6)::DOUBLE AS ratio FROM r"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _title_pairs(spark, sf).select("ordinal", rounded(titles.token_set_ratio_udf("a", "b")).alias("ratio"))


@entry("clean_pages", "C4", f"""
WITH c AS (SELECT page_id, {collapse_sql(f"regexp_replace({unescape_sql('html')}, '<[^>]+>', ' ', 'g')")} AS t FROM pages)
SELECT page_id, nullif(t, '') AS body, {strip_sql("t")} AS title FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("body")).withColumn("title", text.clean_title(F.col("body")))


@entry("content_hashes", "C5", """
SELECT doc_id, sha256(text || CASE WHEN lang = 'en' THEN '' ELSE chr(0) || lang END || chr(0) || source) AS content_hash FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    middle = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text"), middle, F.col("source")).alias("content_hash"))


_DATE_TEXTS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type
    WHEN 'view' THEN CONCAT(REPLACE(CAST(ts AS STRING), ' ', 'T'), 'Z')
    WHEN 'click' THEN CONCAT(SUBSTR(CAST(ts AS STRING), 1, 19), '+08:00')
    WHEN 'error' THEN CONCAT('about ', CAST(ts AS STRING))
    WHEN 'signup' THEN SUBSTR(CAST(ts AS STRING), 1, 10)
    ELSE REPLACE(SUBSTR(CAST(ts AS STRING), 1, 10), '-', '') END AS date_text, event_type
FROM events"""


@entry("parsed_dates", "C6", f"""
WITH t AS ({_DATE_TEXTS})
SELECT event_id, CASE event_type WHEN 'view' THEN epoch_us(ts)
    WHEN 'click' THEN epoch_us(date_trunc('second', ts)) - 8 * 3600000000
    WHEN 'error' THEN NULL ELSE epoch_us(date_trunc('day', ts)) END AS parsed_us,
    (event_id * 1000003) * 1000000 AS epoch_us FROM t WHERE event_id <> 0
UNION ALL SELECT event_id, CASE event_type WHEN 'view' THEN epoch_us(ts)
    WHEN 'click' THEN epoch_us(date_trunc('second', ts)) - 8 * 3600000000
    WHEN 'error' THEN NULL ELSE epoch_us(date_trunc('day', ts)) END, NULL FROM t WHERE event_id = 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return query(spark, sf, _DATE_TEXTS).select(
        "event_id", F.unix_micros(clock.parse_date(F.col("date_text"))).alias("parsed_us"),
        F.unix_micros(clock.from_epoch(F.col("event_id") * 1000003)).alias("epoch_us"),
    )


@entry("formatted_dates", "C7", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS iso,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS stored, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS rfc822,
       strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shanghai FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", clock.iso_format(ts).alias("iso"), clock.store_format(ts).alias("stored"), clock.rfc822(ts).alias("rfc822"),
        clock.store_format(clock.in_zone(ts, "Asia/Shanghai")).alias("shanghai"),
    )


@entry("day_anchors", "C8", """
SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS today_start,
       strftime(date_trunc('day', ts) - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS yesterday_end FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", clock.store_format(clock.today_start(ts)).alias("today_start"), clock.store_format(clock.yesterday_end(ts)).alias("yesterday_end")
    )


@entry("temporal_weights", "C9 C10", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts,
                  greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts))::DOUBLE / 86400000000) AS age FROM events)
SELECT event_id, round(CASE WHEN ts IS NULL THEN 0.0 ELSE age END, 6)::DOUBLE AS age_days,
       round(CASE WHEN ts IS NULL OR age <= 0 THEN 1.0 ELSE greatest(0.05, exp(-ln(2.0) / 3.0 * age)) END, 6)::DOUBLE AS weight FROM e""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..params import Decay

    added = F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))
    as_of = "2024-01-20 00:00:00"
    return table(spark, sf, "events").select(
        "event_id", rounded(clock.age_days(added, as_of)).alias("age_days"),
        rounded(scoring.temporal_weight(added, as_of, Decay(halflife_days=3.0))).alias("weight"),
    )


_RAW_DATES = """
SELECT o_orderkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(MONTH(o_orderdate) AS BIGINT) AS m, CAST(DAY(o_orderdate) AS BIGINT) AS d, o_orderstatus,
       CASE o_orderstatus WHEN 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
            WHEN 'O' THEN CONCAT(CAST(MONTH(o_orderdate) AS STRING), '/', CAST(YEAR(o_orderdate) AS STRING))
            ELSE CONCAT(CAST(DAY(o_orderdate) AS STRING), '-', CAST(MONTH(o_orderdate) AS STRING), '-', CAST(YEAR(o_orderdate) AS STRING)) END AS raw_date
FROM orders"""


@entry("years_and_quarters", "C11 C12", f"""
WITH t AS ({_RAW_DATES})
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN y WHEN 'O' THEN NULL ELSE d END AS parsed_year,
       CAST(y AS VARCHAR) || '-Q' || CASE o_orderstatus WHEN 'O' THEN '1' ELSE CAST((m - 1) // 3 + 1 AS VARCHAR) END AS quarter FROM t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return query(spark, sf, _RAW_DATES).select(
        "o_orderkey", clock.year_of(F.col("raw_date")).cast("long").alias("parsed_year"), clock.quarter_key(F.col("y"), F.col("raw_date")).alias("quarter")
    )


@entry("journal_factor_scores", "C13", oracle("journal", """
SELECT issn, round(CASE WHEN is_cn THEN 0.7 WHEN impact_factor IS NULL THEN NULL ELSE least(1.0, ln(impact_factor + 1) / ln(25.0)) END, 6)::DOUBLE AS listed_score FROM journal"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "journal").select("issn", rounded(scoring.journal_score(F.col("impact_factor"), F.col("is_cn"))).alias("listed_score"))


@entry("fused_scores_and_labels", "C14 C15", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / 50 AS micro, l_discount * 10 AS macro, l_tax * 10 AS journal FROM lineitem),
f AS (SELECT *, 0.8 * (0.65 * micro + 0.35 * macro) + 0.2 * journal AS score FROM s)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(score, 6)::DOUBLE AS score,
       CASE WHEN round(score, 6) >= 0.65 THEN 'must_read' WHEN round(score, 6) >= 0.45 THEN 'consider' ELSE 'ignore' END AS label FROM f""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    similarity = scoring.fused_similarity(F.col("l_quantity") / 50, F.col("l_discount") * 10)
    score = rounded(scoring.final_score(similarity, F.col("l_tax") * 10))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice", score.alias("score"),
        scoring.label(score, F.lit(0.65), F.lit(0.45)).alias("label"),
    )


@entry("unit_vectors", "C16", """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM n)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6)::DOUBLE AS norm, round(list_dot_product(u, v), 6)::DOUBLE AS along, round(u[1], 6)::DOUBLE AS first_value,
       round(u[len(u)], 6)::DOUBLE AS last_value FROM u""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v, u = F.col("embedding"), F.col("u")
    return table(spark, sf, "embeddings").withColumn("u", scoring.l2_normalize(v)).select(
        "vec_id", rounded(scoring.l2_norm(v)).alias("norm"), rounded(scoring.dot(u, v)).alias("along"),
        rounded(F.element_at(u, 1)).alias("first_value"), rounded(F.element_at(u, -1)).alias("last_value"),
    )


@entry("encodable_texts", "C17 F14", f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '  ' ELSE text END AS text, role FROM conversations)
SELECT conv_id, turn, CASE WHEN {strip_sql("text")} = '' THEN '[untitled]' ELSE text END AS encodable,
       'Title: ' || role || chr(10) || 'Abstract: ' || text AS embedding_text FROM t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("role") == "system", "  ").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.encodable_text(t).alias("encodable"), text.embedding_text(F.col("role"), t).alias("embedding_text")
    )


@entry("person_names", "C18", """
SELECT s_suppkey, trim(CASE WHEN s_acctbal < 0 THEN n_name ELSE s_name || ' ' || n_name END) AS full_name FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        "s_suppkey", text.person_name(first, F.col("n_name")).alias("full_name")
    )


_VENUES = "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN CONCAT('Annual Meeting on ', p_name) WHEN 'PROMO' THEN CONCAT(p_name, ' Symposium') ELSE CONCAT('Journal of ', p_name) END AS venue FROM part"


@entry("venue_types", "C19", f"""
SELECT p_partkey, venue, CASE WHEN regexp_matches(lower(venue), 'conference|symposium|workshop|proceedings|annual meeting|congress')
       THEN 'conference' ELSE 'journal' END AS venue_type FROM ({_VENUES})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return query(spark, sf, _VENUES).select("p_partkey", "venue", venue_type(F.col("venue")).alias("venue_type"))


@entry("publishers", "C20", oracle("publisher_page", """
, u AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, url FROM publisher_page UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), url FROM pages)
SELECT id, CASE WHEN url LIKE 'https://www.nature.com/%' THEN 'springer' WHEN url LIKE 'https://www.sciencedirect.com/%' THEN 'elsevier'
       WHEN url LIKE 'https://www.tandfonline.com/%' THEN 'taylor_francis' ELSE 'unknown' END AS publisher FROM u"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    made = view(spark, sf, "publisher_page").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "url")
    given = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    return made.unionByName(given).select("id", detect_publisher(F.col("url")).alias("publisher"))


@entry("truncated_values", "C23", """
SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS text_value, CASE WHEN length(source) > 80 THEN left(source, 80) || '...' ELSE source END AS source_value FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cut = text.truncate_values(F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source")))
    return table(spark, sf, "documents").select("doc_id", cut.alias("m")).select("doc_id", F.col("m")["text"].alias("text_value"), F.col("m")["source"].alias("source_value"))


def _sql_text(template: str) -> str:
    return "'" + template.replace("'", "''") + "'"


def _fill_sql(template: str, **values: str) -> str:
    sql = _sql_text(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


@entry("paper_prompts", "C24 W12", f"""
WITH a AS (SELECT key, array_to_string(list(author ORDER BY author)[1:5], ', ') AS authors FROM
             (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS key, s_name AS author FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY key),
d AS (SELECT doc_id, text, lang, source FROM documents)
SELECT d.doc_id, {_fill_sql(prompts.BULLET_SUMMARY.replace("{abstract}", "").split("Authors:")[0], title="d.source")} || '' AS head,
       'Authors: ' || coalesce(a.authors, 'Unknown') || chr(10) || 'Venue: ' || CASE WHEN d.lang = 'en' THEN 'Unknown' ELSE d.lang END AS names,
       length(d.text)::BIGINT AS abstract_chars
FROM d LEFT JOIN a ON a.key = CAST(d.doc_id AS VARCHAR)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    authors = view(spark, sf, "item_author").groupBy("key").agg(F.array_sort(F.collect_set("author")).alias("authors"))
    d = table(spark, sf, "documents").join(authors, F.col("doc_id").cast("string") == F.col("key"), "left")
    venue = F.when(F.col("lang") != "en", F.col("lang"))
    prompt = prompts.paper_prompt(prompts.BULLET_SUMMARY, F.col("source"), F.col("text"), F.col("authors"), venue)
    # the whole prompt is head + abstract + names + tail; the abstract comes back out to be counted
    head = F.concat(F.substring_index(prompt, "Abstract: ", 1), F.lit("Abstract: \n"))
    tail = F.regexp_extract(prompt, r"(?s).*\n(Authors: .*?\nVenue: [^\n]*)", 1)
    rest = F.length(prompt) - F.length(head) - F.length(tail) - F.lit(len(prompts.BULLET_SUMMARY.split("{venue}")[1]))
    return d.select("doc_id", head.alias("head"), tail.alias("names"), rest.cast("long").alias("abstract_chars"))


@entry("overview_lines", "C24", """
SELECT doc_id, CAST(doc_id AS VARCHAR) || '. ' || source || chr(10) || '   摘要片段：' || left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS line,
       '- ' || source || ' [' || lang || ']: ' || CAST(n_chars AS VARCHAR) || '篇' AS stat,
       CAST(doc_id AS VARCHAR) || '. ' || source || chr(10) || '   标签：' || lang AS classified FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "documents").select(
        "doc_id", prompts.overview_line(c("doc_id"), c("source"), c("text")).alias("line"), prompts.stat_line(c("source"), c("n_chars"), c("lang")).alias("stat"),
        prompts.classification_line(c("doc_id"), c("source"), F.array("lang")).alias("classified"),
    )


_ANSWERS = """
SELECT doc_id, text, CASE lang
    WHEN 'en' THEN CONCAT('{"research_question": "', source, '", "methodology": "m", "key_findings": "k", "innovation": "i", "relevance_note": null}')
    WHEN 'fr' THEN CONCAT('```json', CHR(10), '{"research_question": "', source, '", "methodology": "m", "key_findings": "k", "innovation": "i"}', CHR(10), '```')
    ELSE CONCAT('no json: ', text) END AS answer, lang, source
FROM documents"""


@entry("parsed_bullets", "C21", f"""
WITH a AS ({_ANSWERS})
SELECT doc_id, CASE WHEN lang IN ('en','fr') THEN source ELSE 'Unable to extract research question' END AS research_question,
       CASE WHEN lang IN ('en','fr') THEN 'i' ELSE 'Unable to extract innovation' END AS innovation,
       CASE WHEN lang IN ('en','fr') THEN NULL ELSE left({strip_sql("answer")}, 200) END AS relevance_note FROM a""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parsed = query(spark, sf, _ANSWERS).select("doc_id", answers.bullets(F.col("answer")).alias("b"))
    return parsed.select("doc_id", "b.research_question", "b.innovation", "b.relevance_note")


@entry("parsed_interests", "C21 U8", f"""
WITH a AS ({_ANSWERS})
SELECT doc_id, CASE WHEN lang IN ('en','fr') THEN '' ELSE left({strip_sql("answer")}, 500) END AS refined_query, 0::BIGINT AS n_excluded FROM a""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parsed = query(spark, sf, _ANSWERS).select("doc_id", answers.interests(F.col("answer")).alias("i"))
    return parsed.select("doc_id", "i.refined_query", F.size("i.exclude_keywords").cast("long").alias("n_excluded"))


@entry("fallback_labels", "C22", oracle("document_item", """
SELECT key, CASE WHEN lang = 'en' THEN source WHEN title <> '' AND lang = 'fr' THEN left(title, 30) ELSE '聚类 ' || key END AS label,
       CASE WHEN lang = 'en' THEN FALSE WHEN title <> '' AND lang = 'fr' THEN FALSE ELSE TRUE END AS needs_label FROM document_item"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    keywords = F.when(F.col("lang") == "en", F.array("source")).otherwise(none)
    title = F.when((F.col("title") != "") & (F.col("lang") == "fr"), F.array("title")).otherwise(none)
    labeled = view(spark, sf, "document_item").select("key", answers.fallback_label(keywords, title, F.col("key")).alias("label"))
    return labeled.select("key", "label", answers.needs_label(F.col("label")).alias("needs_label"))


@entry("feed_texts", "C25", oracle("page_work", """
SELECT ordinal, 'Published: Unknown' || chr(10) || 'Venue: ' || venue || chr(10) || 'Score: ' || printf('%.3f', length(title) / 64.0) || ' (consider)' AS description,
       '<p><strong>Authors:</strong> ' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '; B</p>' || chr(10)
       || '<p><strong>Journal:</strong> ' || venue || '</p>' || chr(10)
       || '<p><strong>DOI:</strong> <a href="https://doi.org/' || doi || '">' || doi || '</a></p>' || chr(10)
       || '<p><strong>Relevance:</strong> ' || printf('%.3f', length(title) / 64.0) || ' (consider)</p>' AS content FROM page_work"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    score, none = F.length("title") / F.lit(64.0), F.lit(None).cast("string")
    works = view(spark, sf, "page_work")
    return works.select(
        "ordinal", feed.description(none, F.lit(None).cast("timestamp"), F.col("venue"), score, F.lit("consider")).alias("description"),
        feed.content(F.array("title", F.lit("B")), F.col("venue"), F.col("doi"), score, F.lit("consider"), none).alias("content"),
    )


@entry("meta_contents", "X2", oracle("publisher_page", f"""
SELECT doc_id, {strip_sql("regexp_extract(html, '<meta name=\"dc.description\" content=\"([^\"]+)\">', 1)")} AS described FROM publisher_page WHERE html LIKE '<html><meta%'
UNION ALL SELECT doc_id, NULL FROM publisher_page WHERE html NOT LIKE '<html><meta%'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "publisher_page").select("doc_id", meta_content(F.col("html"), "name", "dc.description").alias("described"))


@entry("clean_extracts", "X4", f"""
WITH t AS (SELECT doc_id, ' Abstract: ' || replace(text, chr(10), '\\n') || ' <b>q</b> \\"x\\" a\\\\b &amp; c' AS raw FROM documents),
u AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(raw, '\\\\', chr(0)), '\\"', '"'), '\\n', ' '), '\\t', ' '), '\\r', ''), chr(0), '\\') AS raw FROM t)
SELECT doc_id, {collapse_sql(f"regexp_replace(regexp_replace({unescape_sql('raw')}, '<[^>]+>', ' ', 'g'), '^\\s*(?i:abstract)\\s*:?\\s*', '')")} AS cleaned FROM u""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" Abstract: "), F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit(' <b>q</b> \\"x\\" a\\\\b &amp; c'))
    return table(spark, sf, "documents").select("doc_id", F.get(clean_texts(F.array(raw)), F.lit(0)).alias("cleaned"))


@entry("highlights", "X5", """
WITH t AS (SELECT doc_id, replace(text, ',', '•') AS text FROM documents),
c AS (SELECT doc_id, text, length(text) - length(replace(text, '•', '')) AS bullets, len(regexp_extract_all(text, '\\.\\s|\\.$')) AS ends FROM t)
SELECT doc_id, text = '' OR starts_with(lower(text), 'highlights') OR (bullets > 2 AND bullets >= ends) AS is_highlights FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit(","), F.lit("•"))
    return table(spark, sf, "documents").select("doc_id", is_highlights(t).alias("is_highlights"))


@entry("stripped_pages", "X6", f"SELECT page_id, {stripped_sql('html')} AS content FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", stripped_page(F.col("html")).alias("content"))
