"""Nearest neighbours, cluster scores, ranking and the composite runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures.views import AS_OF, oracle, table, view
from ..operators import clusters as cl
from ..operators import neighbors as nb
from ..operators import ranking as rk
from ..operators.vector_index import build_index, indexed_knn
from ..params import Thresholds, WatchLimits, WatchSettings
from ..plans.rank import with_thresholds, profile_clusters, rank_cold, score_candidates
from .base import entry, rounded

# --- shared SQL parts ---

_UNIT = """
, l AS (SELECT profile_id, key, cluster_id, date_added, embedding::DOUBLE[] AS v FROM library),
lu AS (SELECT profile_id, key, cluster_id, date_added, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u,
       greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(date_added))::DOUBLE / 86400000000) AS age FROM l),
li AS (SELECT *, CASE WHEN date_added IS NULL OR age <= 0 THEN 1.0 ELSE greatest(0.05, exp(-ln(2.0) / 180 * age)) END AS w FROM lu),
cv AS (SELECT ordinal, embedding::DOUBLE[] AS v FROM candidate),
cu AS (SELECT ordinal, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM cv)"""
_KNN = _UNIT + """,
d AS (SELECT i.profile_id, c.ordinal, i.key, i.w, list_dot_product(c.u, i.u) AS sim FROM cu c, li i),
k AS (SELECT *, row_number() OVER (PARTITION BY profile_id, ordinal ORDER BY round(sim, 9) DESC, key) AS rank FROM d),
micro AS (SELECT profile_id, ordinal, sum(sim * w) / (sum(w) + 1e-8) AS micro, max(sim) AS top_similarity FROM k WHERE rank <= 5 GROUP BY ALL)"""
_CENTROIDS = """,
x AS (SELECT profile_id, cluster_id, generate_subscripts(u, 1) AS pos, unnest(u) AS val, w FROM li),
m AS (SELECT profile_id, cluster_id, pos, avg(val) AS plain, sum(val * w) / sum(w) AS weighted, sum(w) AS e, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT profile_id, cluster_id, list(plain ORDER BY pos) AS p, list(weighted ORDER BY pos) AS q, max(e) AS effective_size, max(n) AS member_count FROM m GROUP BY ALL),
cen AS (SELECT profile_id, cluster_id, effective_size, member_count, list_transform(p, lambda x: x / (sqrt(list_dot_product(p, p)) + 1e-8)) AS centroid,
        list_transform(q, lambda x: x / (sqrt(list_dot_product(q, q)) + 1e-8)) AS weighted_centroid FROM g)"""
_MACRO = _CENTROIDS + """,
c8 AS (SELECT ordinal, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS u FROM cv),
w8 AS (SELECT profile_id, cluster_id, effective_size, list_transform(weighted_centroid, lambda x: x / (sqrt(list_dot_product(weighted_centroid, weighted_centroid)) + 1e-8)) AS z FROM cen),
cs AS (SELECT w8.profile_id, c8.ordinal, cluster_id, list_dot_product(c8.u, z) AS sim, ln(1 + effective_size) AS e FROM c8, w8),
mr AS (SELECT *, row_number() OVER (PARTITION BY profile_id, ordinal ORDER BY round(sim * e, 9) DESC, cluster_id) AS best,
       row_number() OVER (PARTITION BY profile_id, ordinal ORDER BY round(sim, 9) DESC, cluster_id) AS sim_rank, max(e) OVER (PARTITION BY profile_id) AS top_e FROM cs),
macro AS (SELECT profile_id, ordinal, cluster_id, CASE WHEN top_e > 0 THEN sim * e / top_e ELSE 0.0 END AS macro FROM mr WHERE best = 1)"""
_JOURNAL = """,
ju AS (SELECT issn, impact_factor, is_cn, CASE WHEN is_cn THEN 0.7 WHEN impact_factor IS NOT NULL THEN least(1.0, ln(impact_factor + 1) / ln(25.0)) END AS listed FROM journal),
jm AS (SELECT c.ordinal, ju.listed, row_number() OVER (PARTITION BY c.ordinal ORDER BY c.pos) AS n FROM candidate_issn c JOIN ju ON ju.issn = c.issn WHERE ju.listed IS NOT NULL),
js AS (SELECT w.ordinal, CASE WHEN w.source = 'arxiv' THEN 0.6 ELSE coalesce(jm.listed, 0.3) END AS journal_score FROM candidate w LEFT JOIN jm ON jm.ordinal = w.ordinal AND jm.n = 1)"""
_SCORED = _KNN + _MACRO + _JOURNAL + """,
sc AS (SELECT micro.profile_id, micro.ordinal, micro, macro, cluster_id, 0.65 * micro + 0.35 * macro AS similarity, journal_score,
       0.8 * (0.65 * micro + 0.35 * macro) + 0.2 * journal_score AS score FROM micro JOIN macro USING (profile_id, ordinal) JOIN js USING (ordinal))"""
_SCORE_VIEWS = "library candidate journal candidate_issn"


def _thresholds_sql(source: str, floors: tuple[float, float] = (0.6, 0.4)) -> str:
    return f""",
th0 AS (SELECT profile_id, greatest(quantile_cont(score, 0.95), {floors[0]}) AS m, greatest(quantile_cont(score, 0.70), {floors[1]}) AS c FROM {source} GROUP BY 1),
th AS (SELECT profile_id, CASE WHEN m <= c THEN c + 0.01 ELSE m END AS must_read, c AS consider FROM th0)"""


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf, n) for n in _SCORE_VIEWS.split())  # type: ignore[return-value]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    library, candidates, journals, issns = _inputs(spark, sf)
    return score_candidates(candidates, library, profile_clusters(library, AS_OF), issns, journals, AS_OF)


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return cl.weighted_items(view(spark, sf, "library"), AS_OF)


def _neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return nb.knn_join(view(spark, sf, "candidate"), cl.with_weight(view(spark, sf, "library"), AS_OF), 5)


_NEIGHBORS_SQL = oracle("library candidate", _KNN + """
SELECT profile_id, ordinal, key, rank, round(sim, 6)::DOUBLE AS sim FROM k WHERE rank <= 5""")


def _neighbor_rows(found: DataFrame) -> DataFrame:
    return found.select("profile_id", "ordinal", "key", F.col("rank").cast("long").alias("rank"), rounded("sim").alias("sim"))


@entry("nearest_neighbors", "J8", _NEIGHBORS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbor_rows(_neighbors(spark, sf))


@entry("indexed_neighbors", "J8", _NEIGHBORS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    index = build_index(cl.with_weight(view(spark, sf, "library"), AS_OF))
    return _neighbor_rows(indexed_knn(view(spark, sf, "candidate"), index, 5)[0])


@entry("micro_scores", "W1 J15", oracle("library candidate", _KNN + """
SELECT profile_id, ordinal, round(micro, 6)::DOUBLE AS micro, round(top_similarity, 6)::DOUBLE AS top_similarity FROM micro"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nb.micro_scores(_neighbors(spark, sf)).select("profile_id", "ordinal", rounded("micro").alias("micro"), rounded("top_similarity").alias("top_similarity"))


def _cluster_scored(spark: SparkSession, sf: str) -> DataFrame:
    return nb.cluster_scores(view(spark, sf, "candidate"), profile_clusters(view(spark, sf, "library"), AS_OF))


@entry("macro_scores", "J9 W2 A15", oracle("library candidate", _UNIT + _MACRO + """
SELECT profile_id, ordinal, cluster_id, round(macro, 6)::DOUBLE AS macro FROM macro"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nb.macro_scores(_cluster_scored(spark, sf)).withColumn("macro", rounded("macro"))


@entry("similar_clusters", "W3", oracle("library candidate", _UNIT + _MACRO + """
SELECT profile_id, ordinal, sim_rank, cluster_id, round(sim, 6)::DOUBLE AS sim FROM mr WHERE sim_rank <= 5"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return nb.similar_clusters(_cluster_scored(spark, sf)).withColumns({"sim": rounded("sim"), "sim_rank": F.col("sim_rank").cast("long")})


@entry("scored_candidates", "P3 C14 J7", oracle(_SCORE_VIEWS, _SCORED + """
SELECT profile_id, ordinal, round(micro, 6)::DOUBLE AS micro, round(macro, 6)::DOUBLE AS macro, cluster_id, round(similarity, 6)::DOUBLE AS similarity,
  round(journal_score, 6)::DOUBLE AS journal_score, round(score, 6)::DOUBLE AS score FROM sc"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("profile_id", "ordinal", "cluster_id", *[rounded(c).alias(c) for c in ("micro", "macro", "similarity", "journal_score", "score")])


@entry("single_neighbor_scores", "P3", oracle(_SCORE_VIEWS, _KNN + _JOURNAL + """
SELECT profile_id, ordinal, round(top_similarity, 6)::DOUBLE AS similarity, round(0.8 * top_similarity + 0.2 * journal_score, 6)::DOUBLE AS score FROM micro JOIN js USING (ordinal)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    library, candidates, journals, issns = _inputs(spark, sf)
    scored = score_candidates(candidates, library, None, issns, journals, AS_OF)
    return scored.select("profile_id", "ordinal", rounded("similarity").alias("similarity"), rounded("score").alias("score"))


# thresholds, labels and caps run on a cheaper score: every event is a candidate of one of five profiles
_EVENT_SCORES = """
WITH e AS (SELECT event_id AS ordinal, user_id % 5 AS profile_id, round(value / 100.0, 4) AS score, event_type, ts FROM events)"""


def _event_scores(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "view", "arXiv").when(kind == "click", "biorxiv").when(kind == "signup", "medRxiv").when(kind == "error", "arxiv").otherwise("crossref")
    return events.select(
        F.col("event_id").alias("ordinal"), (F.col("user_id") % 5).alias("profile_id"), F.round(F.col("value") / 100, 4).alias("score"),
        source.alias("source"), F.col("event_type"), F.col("ts").cast("timestamp").alias("published"),
    )


@entry("percentile_thresholds", "A23", _EVENT_SCORES + _thresholds_sql("e") + """
SELECT profile_id, round(must_read, 6)::DOUBLE AS must_read, round(consider, 6)::DOUBLE AS consider, 'dynamic' AS mode FROM th""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    th = rk.percentile_thresholds(_event_scores(table(spark, sf, "events")))
    return th.withColumns({"must_read": rounded("must_read"), "consider": rounded("consider")})


@entry("floored_thresholds", "A23", _EVENT_SCORES + _thresholds_sql("e", (0.99, 1.2)) + """
SELECT profile_id, round(must_read, 6)::DOUBLE AS must_read, round(consider, 6)::DOUBLE AS consider, 'dynamic' AS mode FROM th""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    th = rk.percentile_thresholds(_event_scores(table(spark, sf, "events")), Thresholds(min_must_read=0.99, min_consider=1.2))
    return th.withColumns({"must_read": rounded("must_read"), "consider": rounded("consider")})


@entry("label_distribution", "A11 C15", _EVENT_SCORES + _thresholds_sql("e") + """,
b AS (SELECT e.profile_id, CASE WHEN score >= must_read THEN 'must_read' WHEN score >= consider THEN 'consider' ELSE 'ignore' END AS label FROM e JOIN th USING (profile_id)),
t AS (SELECT profile_id, count(*) AS total FROM b GROUP BY 1), n AS (SELECT unnest(['must_read', 'consider', 'ignore']) AS label)
SELECT t.profile_id, total, n.label, count(b.label) AS label_count, round(100.0 * count(b.label) / total, 6)::DOUBLE AS percent
FROM t CROSS JOIN n LEFT JOIN b ON b.profile_id = t.profile_id AND b.label = n.label GROUP BY t.profile_id, total, n.label""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    labeled, _ = with_thresholds(_event_scores(table(spark, sf, "events")))
    return rk.label_distribution(labeled).withColumn("percent", rounded("percent"))


@entry("full_ranks", "W5", _EVENT_SCORES + " SELECT profile_id, ordinal, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, ordinal) AS rank FROM e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.full_rank(rk.order_by_score(_event_scores(table(spark, sf, "events")))).select("profile_id", "ordinal", "rank")


@entry("top_ranked", "W5", _EVENT_SCORES + """
, r AS (SELECT profile_id, ordinal, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, ordinal) AS rank FROM e) SELECT * FROM r WHERE rank <= 20""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.top_ranked(_event_scores(table(spark, sf, "events")), 20).select("profile_id", "ordinal", "score", "rank")


# the admitted count p(t) = min(p(t-1) + 1, cap(others so far)); its closed form over running values
_CAP = """,
o AS (SELECT profile_id, ordinal, row_number() OVER w AS t, event_type <> 'purchase' AS pre,
      sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS j FROM e
      WINDOW w AS (PARTITION BY profile_id ORDER BY score DESC, ordinal ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN pre THEN CAST({cap} AS BIGINT) - a END AS gap FROM o),
p AS (SELECT *, a + least(0, min(gap) OVER (PARTITION BY profile_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS admitted FROM c),
q AS (SELECT *, coalesce(lag(admitted) OVER (PARTITION BY profile_id ORDER BY t), 0) AS earlier FROM p)
SELECT profile_id, ordinal FROM q WHERE NOT pre OR coalesce(admitted, a) > coalesce(earlier, 0)"""


@entry("limited_preprints", "W4", _EVENT_SCORES + _CAP.format(cap="j"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.limit_preprints(rk.order_by_score(_event_scores(table(spark, sf, "events"))), 0.5).select("profile_id", "ordinal")


@entry("limited_preprints_default", "W4", _EVENT_SCORES + _CAP.format(cap="9 * j"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.limit_preprints(rk.order_by_score(_event_scores(table(spark, sf, "events"))), 0.9).select("profile_id", "ordinal")


@entry("cold_start", "W10 J7", oracle("candidate journal candidate_issn", _JOURNAL.replace(",", ", ", 1) + """
SELECT p.profile_id, js.ordinal, 0.0::DOUBLE AS score, 'consider' AS label, round(journal_score, 6)::DOUBLE AS journal_score
FROM js CROSS JOIN (SELECT CAST(r_regionkey + 4 AS BIGINT) AS profile_id FROM region) p"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    library, candidates, journals, issns = _inputs(spark, sf)
    profiles = library.select("profile_id").distinct().union(table(spark, sf, "region").select((F.col("r_regionkey") + 4).cast("long")))
    from ..plans.watch import fan_out

    follows = profiles.select("profile_id", F.explode(F.array(F.lit("arxiv"), F.lit("crossref"))).alias("source"))
    offered = fan_out(candidates.select("ordinal", "identifier", "source"), follows)
    cold = rank_cold(offered, profiles, library, issns, journals)
    return cold.select("profile_id", "ordinal", "score", "label", rounded("journal_score").alias("journal_score"))


@entry("numbered_batches", "W11", """
SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 5 AS batch_no FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.numbered_batches(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [F.asc("doc_id")], 5)


@entry("first_per_group", "W12", """
SELECT doc_id, lang, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rk.first_per_group(table(spark, sf, "documents"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 10).select("doc_id", "lang", "position")


# --- clusters ---

_STATS = _UNIT + _CENTROIDS + """,
ms AS (SELECT li.profile_id, li.cluster_id, li.key, li.w, li.age, list_dot_product(li.u, cen.centroid) AS sim FROM li JOIN cen USING (profile_id, cluster_id)),
st AS (SELECT profile_id, cluster_id, count(*) AS member_count, sum(w) AS effective_size, avg(sim) AS coherence, avg(age) AS mean_item_age_days,
  CAST(floor(max(age) - min(age)) AS BIGINT) AS temporal_span_days, count(*) FILTER (WHERE age <= 90)::DOUBLE / count(*) AS recent_ratio FROM ms GROUP BY ALL)"""


def _stats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _weighted(spark, sf)
    cents = cl.centroids(items)
    return items, cents, cl.cluster_stats(items, cents)


@entry("cluster_stats", "A14", oracle("library candidate", _STATS + """
SELECT profile_id, cluster_id, member_count, round(effective_size, 6)::DOUBLE AS effective_size, round(coherence, 6)::DOUBLE AS coherence,
  round(mean_item_age_days, 6)::DOUBLE AS mean_item_age_days, temporal_span_days, round(recent_ratio, 6)::DOUBLE AS recent_ratio FROM st"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    stats = _stats(spark, sf)[2]
    return stats.withColumns({c: rounded(c) for c in ("effective_size", "coherence", "mean_item_age_days", "recent_ratio")})


@entry("cluster_centroids", "A15 C16", oracle("library candidate", _UNIT + _CENTROIDS + """,
y AS (SELECT profile_id, cluster_id, generate_subscripts(centroid, 1) AS pos, unnest(centroid) AS plain, unnest(weighted_centroid) AS weighted FROM cen)
SELECT profile_id, cluster_id, CAST(pos AS BIGINT) AS pos, round(plain, 6)::DOUBLE AS plain, round(weighted, 6)::DOUBLE AS weighted FROM y"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    cents = cl.centroids(_weighted(spark, sf))
    return cents.select("profile_id", "cluster_id", F.posexplode(F.arrays_zip("centroid", "weighted_centroid")).alias("pos", "x")).select(
        "profile_id", "cluster_id", (F.col("pos") + 1).cast("long").alias("pos"), rounded(F.col("x.centroid")).alias("plain"), rounded(F.col("x.weighted_centroid")).alias("weighted")
    )


@entry("cluster_keywords", "A16 W6", oracle("library candidate item_tag", """
, c AS (SELECT l.profile_id, l.cluster_id, t.tag, count(*) AS tag_count FROM library l JOIN item_tag t ON t.key = l.key GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id, cluster_id ORDER BY tag_count DESC, tag) AS rank FROM c) SELECT * FROM r WHERE rank <= 10"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster_keywords(view(spark, sf, "library").select("profile_id", "cluster_id", "key"), view(spark, sf, "item_tag"))


@entry("representative_items", "A17", oracle("library candidate", _STATS + """
, r AS (SELECT profile_id, cluster_id, key, row_number() OVER (PARTITION BY profile_id, cluster_id ORDER BY round(sim, 9) DESC, key) AS rank FROM ms)
SELECT * FROM r WHERE rank <= 5"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items, cents, _ = _stats(spark, sf)
    return cl.representative_items(items, cents).select("profile_id", "cluster_id", "key", F.col("rank").cast("long").alias("rank"))


@entry("profile_summaries", "A18", oracle("library candidate", _STATS + """
, r AS (SELECT profile_id, count(*) AS total_papers, min(date_added) AS a, max(date_added) AS b FROM library GROUP BY 1)
SELECT r.profile_id, total_papers, epoch_us(a) AS first_us, epoch_us(b) AS last_us, count(*) FILTER (WHERE member_count >= 12) AS valid_cluster_count,
  CAST(sum(CASE WHEN member_count >= 12 THEN member_count ELSE 0 END) AS BIGINT) AS papers_in_valid_clusters, round(sum(CASE WHEN member_count >= 12 THEN effective_size ELSE 0 END), 6)::DOUBLE AS total_effective_size
FROM r JOIN st USING (profile_id) GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items, _, stats = _stats(spark, sf)
    s = cl.profile_summary(stats, items, 12)
    return s.select("profile_id", "total_papers", F.unix_micros("first_added").alias("first_us"), F.unix_micros("last_added").alias("last_us"),
                    "valid_cluster_count", "papers_in_valid_clusters", rounded("total_effective_size").alias("total_effective_size"))


@entry("renumbered_clusters", "W9", oracle("library", """
, n AS (SELECT profile_id, cluster_id, count(*) AS member_count FROM library GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY member_count DESC, cluster_id) - 1 AS new_cluster_id FROM n WHERE member_count >= 10"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    sizes = view(spark, sf, "library").groupBy("profile_id", "cluster_id").agg(F.count("*").alias("member_count"))
    return cl.renumber_clusters(sizes, 10)


@entry("cluster_links", "J11", oracle("library candidate", _UNIT + _CENTROIDS + """,
p AS (SELECT a.profile_id, a.cluster_id, b.cluster_id AS other_id, list_dot_product(a.weighted_centroid, b.weighted_centroid)
      / (sqrt(list_dot_product(a.weighted_centroid, a.weighted_centroid)) * sqrt(list_dot_product(b.weighted_centroid, b.weighted_centroid))) AS value
      FROM cen a JOIN cen b ON a.profile_id = b.profile_id AND a.cluster_id <> b.cluster_id),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id, cluster_id ORDER BY round(value, 9) DESC, other_id) AS n FROM p WHERE value > 0.05)
SELECT profile_id, least(cluster_id, other_id) AS source_id, greatest(cluster_id, other_id) AS target_id, round(max(value), 6)::DOUBLE AS value FROM r WHERE n <= 2 GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster_links(profile_clusters(view(spark, sf, "library"), AS_OF), 0.05).withColumn("value", rounded("value"))


@entry("cluster_bounds", "A21", """
WITH n AS (SELECT l_orderkey, count(*) * 37 AS n FROM lineitem GROUP BY 1),
h AS (SELECT *, least(CASE WHEN n < 100 THEN greatest(CAST(floor(sqrt(n)) AS BIGINT), least(n // 5, 8)) ELSE least(35, CAST(floor(sqrt(n)) AS BIGINT)) END, n // 2, 35) AS hi FROM n)
SELECT l_orderkey, n, CASE WHEN n < 5 OR hi < 2 THEN 1 ELSE least(greatest(5, 2, CAST(floor(sqrt(n) / 3) AS BIGINT)), hi) END AS min_k, CASE WHEN n < 5 OR hi < 2 THEN 1 ELSE hi END AS max_k FROM h""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 37).alias("n"))
    low, high = cl.cluster_bounds(F.col("n"))
    return sizes.select("l_orderkey", "n", low.alias("min_k"), high.alias("max_k"))


@entry("chosen_k", "A21", """
WITH s AS (SELECT l_partkey AS profile_id, CAST(l_quantity AS BIGINT) AS k, max(l_discount) - 0.03 AS silhouette FROM lineitem GROUP BY ALL),
b AS (SELECT profile_id, max(silhouette) AS best FROM s GROUP BY 1)
SELECT profile_id, max(k) AS k, round(arg_max(silhouette, k), 6)::DOUBLE AS silhouette FROM s JOIN b USING (profile_id) WHERE silhouette >= best - 0.2 * abs(best) GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("profile_id"), F.col("l_quantity").cast("long").alias("k")).agg(
        (F.max("l_discount") - 0.03).alias("silhouette")
    )
    return cl.choose_k(scores).withColumn("silhouette", rounded("silhouette"))


@entry("silhouettes", "A20", oracle("library candidate", _UNIT + """,
un AS (SELECT profile_id, key, cluster_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM l),
p AS (SELECT a.profile_id, a.key, a.cluster_id, b.cluster_id AS other_id, count(*) AS n, sum(1 - list_dot_product(a.u, b.u)) AS total
      FROM un a JOIN un b ON a.profile_id = b.profile_id GROUP BY ALL),
q AS (SELECT profile_id, key, max(CASE WHEN cluster_id = other_id AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN cluster_id <> other_id THEN total / n END) AS b FROM p GROUP BY ALL)
SELECT profile_id, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6)::DOUBLE AS silhouette FROM q GROUP BY 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cl.silhouettes(view(spark, sf, "library")).withColumn("silhouette", rounded("silhouette"))


@entry("single_cluster_stats", "A22 A14", oracle("library candidate", _STATS.replace("SELECT profile_id, key, cluster_id, date_added, embedding::DOUBLE[] AS v FROM library", "SELECT profile_id, key, 0::BIGINT AS cluster_id, date_added, embedding::DOUBLE[] AS v FROM library") + """
SELECT profile_id, cluster_id, member_count, round(effective_size, 6)::DOUBLE AS effective_size, round(coherence, 6)::DOUBLE AS coherence FROM st"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    items = cl.single_cluster(_weighted(spark, sf).drop("cluster_id"))
    stats = cl.cluster_stats(items, cl.centroids(items))
    return stats.select("profile_id", "cluster_id", "member_count", rounded("effective_size").alias("effective_size"), rounded("coherence").alias("coherence"))


@entry("fitted_clusters", "A19 A21 A22 P1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.profile import cluster_library

    library = cluster_library(view(spark, sf, "library").drop("cluster_id"))
    return library.groupBy("profile_id", "cluster_id").agg(F.count("*").alias("member_count"))


# --- the run ---

@entry("ranked_candidates", "P3 A23 C15 W5", oracle(_SCORE_VIEWS, _SCORED + _thresholds_sql("sc") + """,
r AS (SELECT sc.profile_id, ordinal, score, CASE WHEN score >= must_read THEN 'must_read' WHEN score >= consider THEN 'consider' ELSE 'ignore' END AS label,
  row_number() OVER (PARTITION BY sc.profile_id ORDER BY score DESC, ordinal) AS rank FROM sc JOIN th USING (profile_id))
SELECT profile_id, ordinal, round(score, 6)::DOUBLE AS score, label, rank FROM r WHERE rank <= 20"""))
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    labeled, _ = with_thresholds(_scored(spark, sf))
    return rk.top_ranked(labeled, 20).select("profile_id", "ordinal", rounded("score").alias("score"), "label", "rank")


# profiles without a library
_COLD = (7, 8)


def _watch_sql(result: str) -> str:
    cold = ", ".join(f"({p}::BIGINT)" for p in _COLD)
    return _SCORED.replace("FROM candidate)", "FROM candidate WHERE abstract <> '')", 1) + """,
sd AS (SELECT * FROM sc WHERE NOT (profile_id = 0 AND ordinal % 50 = 7))""" + _thresholds_sql("sd") + f""",
cold AS (SELECT p.profile_id, c.ordinal, 0.0::DOUBLE AS score, c.source, c.published, 'consider' AS label,
    (('0x' || substr(sha256('42:' || p.profile_id || ':' || c.identifier), 1, 13))::BIGINT)::DOUBLE AS sk
  FROM candidate c CROSS JOIN (VALUES {cold}) p(profile_id) WHERE c.abstract <> ''),""" + """
b AS (SELECT sd.profile_id, ordinal, score, c.source, c.published, CASE WHEN score >= must_read THEN 'must_read' WHEN score >= consider THEN 'consider' ELSE 'ignore' END AS label, score AS sk
      FROM sd JOIN th USING (profile_id) JOIN candidate c USING (ordinal) UNION ALL SELECT * FROM cold),
rc AS (SELECT * FROM b WHERE published >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 31 DAY),
o AS (SELECT *, row_number() OVER w AS t, source = 'arxiv' AS pre, sum(CASE WHEN source = 'arxiv' THEN 1 ELSE 0 END) OVER w AS a,
      sum(CASE WHEN source <> 'arxiv' THEN 1 ELSE 0 END) OVER w AS j FROM rc WINDOW w AS (PARTITION BY profile_id ORDER BY sk DESC, ordinal ROWS UNBOUNDED PRECEDING)),
gp AS (SELECT *, CASE WHEN pre THEN j - a END AS gap FROM o),
p AS (SELECT *, a + least(0, min(gap) OVER (PARTITION BY profile_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS admitted FROM gp),
q AS (SELECT *, coalesce(lag(admitted) OVER (PARTITION BY profile_id ORDER BY t), 0) AS earlier FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY sk DESC, ordinal) AS rank FROM q WHERE NOT pre OR coalesce(admitted, a) > coalesce(earlier, 0))
""" + result


def watch_frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The full run on candidates of which some repeat a DOI, are known to a profile, have a blank DOI or no vector; two profiles have no library."""
    from ..functions.text import content_hash, embedding_text
    from ..models.providers import HashingEmbedder
    from ..plans.watch import watch

    library, candidates, journals, issns = _inputs(spark, sf)
    col = F.col
    doi = F.when(col("ordinal") % 50 == 9, F.lit("  ")).otherwise(F.concat(F.lit("10.1000/x"), "identifier"))
    works = candidates.withColumn("title", col("identifier")).withColumn("doi", doi)
    # later copies under another identifier and title
    copies = works.where("ordinal % 50 = 0").withColumn("ordinal", col("ordinal") + 1_000_000).withColumn("identifier", F.concat(F.lit("copy-"), "identifier")).withColumn("title", F.concat(F.lit("z"), "title"))
    works = works.unionByName(copies)
    # every tenth vector is only in the store
    text = embedding_text(col("title"), col("abstract"))
    model = HashingEmbedder()
    moved = works.where("ordinal % 10 = 3")
    store = moved.select(content_hash(text).alias("content_hash"), F.lit(model.name).alias("model"), "embedding", F.lit(None).cast("timestamp").alias("expires_at"))
    works = works.withColumn("embedding", F.when(col("ordinal") % 10 != 3, col("embedding")))
    known = library.select("profile_id", F.concat(F.lit("item-"), "key").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    owned = candidates.where("ordinal % 50 = 7").select(F.lit(0).cast("long").alias("profile_id"), F.lit("").alias("title"), F.concat(F.lit(" 10.1000/X"), "identifier").alias("doi"), F.lit("  ").alias("url"))
    profiles = library.select("profile_id").distinct().union(spark.createDataFrame([(p,) for p in _COLD], "profile_id long"))
    follows = profiles.select("profile_id", F.explode(F.array(F.lit("arxiv"), F.lit("crossref"))).alias("source"))
    settings = WatchSettings(limits=WatchLimits(recent_days=31, max_preprint_ratio=0.5, top_k=20))
    return watch(works, library, known.unionByName(owned), follows, profile_clusters(library, AS_OF), issns, journals, AS_OF, settings, store=store, embedder=model)


@entry("watch", "P2 F8 W4 W5 W10 A23 J1 J4 J5", oracle(_SCORE_VIEWS, _watch_sql("SELECT profile_id, ordinal, round(score, 6)::DOUBLE AS score, label, source, rank FROM f WHERE rank <= 20")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return watch_frames(spark, sf)["recommendations"].select("profile_id", "ordinal", rounded("score").alias("score"), "label", "source", "rank")


@entry("watch_funnel", "A24", oracle(_SCORE_VIEWS, _watch_sql(f"""
, pf AS (SELECT DISTINCT profile_id FROM library UNION ALL VALUES {', '.join(f'({p}::BIGINT)' for p in _COLD)}),
n AS (SELECT count(*) AS a, count(*) FILTER (WHERE ordinal % 50 = 0) AS again, count(*) FILTER (WHERE ordinal % 50 = 7) AS owned, count(*) FILTER (WHERE abstract <> '') AS b,
  count(*) FILTER (WHERE ordinal % 50 = 7 AND abstract <> '') AS owned_b FROM candidate)
SELECT profile_id, 'offered' AS stage, a + again AS works FROM pf, n UNION ALL SELECT profile_id, 'deduped', CASE WHEN profile_id = 0 THEN a - owned ELSE a END FROM pf, n
UNION ALL SELECT profile_id, 'with_abstract', CASE WHEN profile_id = 0 THEN b - owned_b ELSE b END FROM pf, n
UNION ALL SELECT profile_id, 'recent', count(*) FROM rc GROUP BY 1 UNION ALL SELECT profile_id, 'capped', count(*) FROM f GROUP BY 1""")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return watch_frames(spark, sf)["funnel"].select("profile_id", "stage", "works")
