"""Input views over the given tables; the text runs unchanged in Spark SQL and in DuckDB."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_utc

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2024-02-01 00:00:00"
LIBRARY_AS_OF = "2001-09-01 00:00:00"

VIEWS = {
    "library": """
SELECT CAST(FLOOR(e.vec_id / 2) AS BIGINT) % 4 AS profile_id, CAST(e.vec_id AS STRING) AS key,
       CAST(e.label AS BIGINT) AS cluster_id, e.embedding, CAST(ev.ts AS TIMESTAMP) AS date_added
FROM embeddings e JOIN events ev ON ev.event_id = e.vec_id""",
    "candidate": """
SELECT CAST(e.vec_id AS BIGINT) AS ordinal, CAST(e.vec_id AS STRING) AS identifier,
       CASE WHEN ev.event_type IN ('view','click') THEN 'arxiv' ELSE 'crossref' END AS source, e.embedding,
       CAST(ev.ts AS TIMESTAMP) AS published, CASE WHEN ev.event_type = 'error' THEN NULL ELSE d.text END AS abstract
FROM embeddings e JOIN events ev ON ev.event_id = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "journal": """
SELECT CAST(p_partkey AS STRING) AS issn, p_name AS title,
       CASE WHEN p_size % 7 = 0 THEN CONCAT(p_type, ' (CN)') ELSE p_type END AS category,
       CASE WHEN p_size % 7 = 0 THEN TRUE ELSE FALSE END AS is_cn,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS impact_factor
FROM part""",
    "candidate_issn": """
SELECT l_orderkey AS ordinal, CAST(l_partkey AS STRING) AS issn,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                          l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS pos
FROM lineitem""",
    "library_item": """
SELECT o.o_custkey % 8 AS profile_id, CAST(o.o_orderkey AS STRING) AS key, o.o_orderkey AS version,
       CAST(o.o_orderdate AS TIMESTAMP) AS date_added, CAST(YEAR(o.o_orderdate) AS BIGINT) AS year,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS raw_date, c.c_mktsegment AS venue
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "item_author": """
SELECT DISTINCT CAST(l.l_orderkey AS STRING) AS key, s.s_name AS author
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "item_tag": """
SELECT DISTINCT CAST(l.l_orderkey AS STRING) AS key, p.p_brand AS tag
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    # works with titles, links and DOIs, from the pages
    "page_work": """
SELECT page_id AS ordinal, REGEXP_REPLACE(url, '[?#].*$', '') AS identifier, url,
       REGEXP_EXTRACT(html, '(?s)<title>(.*?)</title>', 1) AS title,
       CONCAT('10.1000/', REGEXP_EXTRACT(url, '/([0-9]+)', 1)) AS doi,
       REGEXP_EXTRACT(url, '//([^/]+)/', 1) AS venue, html
FROM pages""",
    # library items with titles (first line of the text), links and DOIs
    "document_item": """
SELECT d.doc_id % 4 AS profile_id, CAST(d.doc_id AS STRING) AS key, d.doc_id AS version, d.source, d.lang,
       SPLIT_PART(d.text, CHR(10), 1) AS title, d.text AS abstract, p.url,
       CASE WHEN d.lang = 'en' THEN CONCAT('10.1000/', CAST(d.n_chars AS STRING)) ELSE NULL END AS doi
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
    # a page of a known publisher around each document
    "publisher_page": """
SELECT d.doc_id, CASE d.lang WHEN 'en' THEN CONCAT('https://www.nature.com/articles/', CAST(d.doc_id AS STRING))
                            WHEN 'fr' THEN CONCAT('https://www.sciencedirect.com/science/article/', CAST(d.doc_id AS STRING))
                            WHEN 'de' THEN CONCAT('https://www.tandfonline.com/doi/', CAST(d.doc_id AS STRING))
                            ELSE CONCAT('https://signature.com/', CAST(d.doc_id AS STRING)) END AS url,
       CASE d.lang WHEN 'en' THEN CONCAT('<html><meta name="dc.description" content="',
                                  REPLACE(REPLACE(d.text, CHR(34), ' '), CHR(39), ' '), '"></html>')
                   WHEN 'fr' THEN CONCAT('<html><div class="x" id="abstract-1"><b>Abstract</b>: ', d.text, '</div></html>')
                   WHEN 'de' THEN CONCAT('<html><div class="hlFld-Abstract"><h2>Abstract</h2><p>', d.text, '</p></div></html>')
                   ELSE CONCAT('<html><section class="abstract">', d.text, '</section></html>') END AS html
FROM documents d""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the given tables it names."""
    for name in TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, VIEWS[name])


@cache
def _prefix(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)


def oracle(names: str, body: str) -> str:
    """SQL with the named views in front; ``body`` may start with further CTEs (``, x AS (…)``)."""
    return f"WITH {_prefix(tuple(names.split()))} {body.strip()}"
