"""The registered query of each operator, and its DuckDB form where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, pin_utc
from . import boilerplate, decontaminate, language, licenses, mixing, near_dedup, negatives, repeats, runs, shards, token_files, topk, toxicity
from .common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def lower_sql(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


# 1: language identification


@query("op1_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs, model, ["doc_id", "held_out"])


# 2: token files

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The vocabulary is a public file that is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@query("op2_repair_tokens")
def repair_tokens(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_tokens(spark, path)


# 3: main text of pages


@query("op3_main_text")
def page_text(spark, sf_dir):
    return boilerplate.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


# 4: near-duplicates


@query("op4_near_dedup", f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower_sql('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
      e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
      r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
      m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
      SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""")
def near_dedup_groups(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("_h")


# 5: exact top-k search


@query("op5_pivot_topk", """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def pivot_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


# 6: mixing

DOMAINS = {"web": tuple(f"src{i}" for i in range(10)), "reference": tuple(f"src{i}" for i in range(10, 15))}
WEIGHTS = {"domain": {"web": 50, "reference": 30, "other": 20}, "lang": {"en": 60, "de": 15, "fr": 15, "es": 10}}
MIX_SEED, MIX_EPOCHS, MIX_PERCENT = 17, 2, 90


def domain_of(source: Column) -> Column:
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(source.isin(*sources), F.lit(name)).otherwise(domain)
    return domain


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS.get(level, {}).items())
    return f"(CASE {cases} ELSE 1 END)" if cases else "1"


def _mixture_sql() -> str:
    sources = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in x)}) THEN '{n}'" for n, x in DOMAINS.items())
    steps = [f"""t AS (SELECT doc_id, CASE {sources} ELSE 'other' END AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
      leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MIX_EPOCHS} AS cap FROM t GROUP BY ALL),
      b0 AS (SELECT least(sum(tokens) * {MIX_PERCENT} // 100, sum(cap)) AS budget FROM leaf)"""]
    levels = ["domain", "lang", "source"]
    for i, level in enumerate(levels):
        path, above = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        family = f"PARTITION BY {above}" if above else ""
        join = f"JOIN b{i} USING ({above})" if above else "CROSS JOIN b0"
        order = f"{family} ORDER BY CAST(cap AS DOUBLE) / weight, {level} ROWS UNBOUNDED PRECEDING"
        steps.append(f"""n{i} AS (SELECT {path}, sum(cap) AS cap, sum(tokens) AS tokens, {_weight_sql(level)} AS weight FROM leaf GROUP BY {path}),
      o{i} AS (SELECT n{i}.*, budget, sum(cap) OVER ({order}) AS caps, sum(weight) OVER ({family}) - sum(weight) OVER ({order}) AS later FROM n{i} {join}),
      f{i} AS (SELECT *, budget >= caps AND (budget - caps) * weight >= cap * later AS isfull FROM o{i}),
      s{i} AS (SELECT *, budget - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({family}) AS rest,
        sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({family}) AS open FROM f{i}),
      b{i + 1} AS (SELECT {path}, tokens, CASE WHEN isfull THEN cap ELSE least(cap, rest * weight // greatest(open, 1)) END AS budget FROM s{i})""")
    steps.append(f"""p AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM b3 WHERE tokens > 0 AND budget > 0),
      w AS (SELECT t.*, e.epoch, n_tokens AS n_taken FROM t JOIN p USING (domain, lang, source) JOIN (SELECT unnest(range(1, {MIX_EPOCHS} + 1)) AS epoch) e ON e.epoch <= whole),
      l AS (SELECT t.*, whole + 1 AS epoch, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
          ORDER BY md5('{MIX_SEED}-' || CAST(whole + 1 AS BIGINT) || '-' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM t JOIN p USING (domain, lang, source) WHERE rest > 0),
      x AS (SELECT doc_id, domain, lang, source, epoch, n_tokens, n_taken FROM w
        UNION ALL SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, rest - before) FROM l WHERE before < rest)
      SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, CAST(n_taken AS BIGINT) AS n_taken FROM x""")
    return "WITH " + ",\n".join(steps[:-1]) + ",\n" + steps[-1]


@query("op6_hierarchical_mixing", _mixture_sql())
def hierarchical_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mixture(docs, levels, WEIGHTS, F.expr(f"tokens * {MIX_PERCENT} div 100"), MIX_SEED, MIX_EPOCHS)


# 7: benchmark decontamination

_WORDS_SQL = f"regexp_extract_all({lower_sql('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op7_benchmark_decontamination", f"""WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
      win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
      d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
      g AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
      h AS (SELECT doc_id, s, n, item_id FROM g JOIN win USING (n, k)),
      c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
      i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
        sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""")
def benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# 8: licence scan


def _canonical_sql(text: str) -> str:
    copyright_line = licenses.COPYRIGHT_LINE.replace("(?md)", "(?m)")
    plain = f"regexp_replace(regexp_replace({lower_sql(text)}, '{copyright_line}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for other, usual in licenses.SPELLINGS:
        plain = f"replace({plain}, '{other}', '{usual}')"
    return plain


def _licenses_sql() -> str:
    line = lambda x: f"trim(regexp_replace({x}, ' *\\n[ \\n]*', ' ', 'g'))"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(licenses.TEXTS))
    return f"""WITH known AS (SELECT digest, arg_min(license, place) AS license FROM
        (SELECT place, license, sha256({line(_canonical_sql('text'))}) AS digest FROM (VALUES {known}) v(place, license, text)) GROUP BY digest),
      d AS (SELECT doc_id, {_canonical_sql('text')} AS form FROM documents),
      u AS (SELECT doc_id, license FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS part, form FROM d) JOIN known ON digest = sha256(trim(part)) WHERE contains(form, chr(10))),
      n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n_notice_lines FROM u GROUP BY doc_id)
      SELECT doc_id, digest, known.license, coalesce(notices, '') AS notices, coalesce(n_notice_lines, 0) AS n_notice_lines, known.license IS NOT NULL OR notices IS NOT NULL AS has_license
      FROM (SELECT doc_id, sha256({line('form')}) AS digest FROM d) LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)"""


@query("op8_license_scan", _licenses_sql())
def license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


# 9: repeated strings


@query("op9_suffix_dedup", """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS d, hex(d) AS h FROM documents),
      g AS (SELECT doc_id, i, md5(d[i + 1 : i + 200]) AS k FROM (SELECT doc_id, d, unnest(range(0, octet_length(d) - 199)) AS i FROM t)),
      d AS (SELECT doc_id, i FROM g JOIN (SELECT k FROM g GROUP BY k HAVING count(*) > 1) USING (k)),
      o AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS opens FROM d),
      q AS (SELECT doc_id, i, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM o),
      s AS (SELECT doc_id, no, min(i) AS a, max(i) + 200 AS b FROM q GROUP BY doc_id, no),
      p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM s),
      u AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept FROM p JOIN t USING (doc_id) GROUP BY doc_id)
      SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN u USING (doc_id)""")
def suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


# 10: toxicity

TOXICITY = (("low_quality", "1 - quality"), ("toxic", "toxic"))


@query("op10_toxicity_chain")
def toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.score(docs, models, [n for n, _ in TOXICITY])


# 11: periodic runs

# CRC-32 by its rule: the table of a byte, and the fold over the bytes of a list
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))"


def _crc_sql(codes: str, table: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)"


_DOC_CRC = _crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))", "crcs")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten its words with a period that depends on the id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(text)


@query("op11_periodic_runs", f"""WITH k AS (SELECT {_CRC_TABLE} AS crcs),
      h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(w) AS n, {_DOC_CRC} AS h FROM documents, k),
      a AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, (h // 10) % greatest(n, 1) AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM h),
      d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM a),
      x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
      e AS (SELECT a.doc_id, b.i - a.i AS q, a.i AS i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
      g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
      s AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
      r AS (SELECT * FROM s WHERE NOT EXISTS (FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.s <= s.s AND o.e >= s.e)),
      c AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM r),
      t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
      m AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS list FROM r GROUP BY doc_id),
      b AS (SELECT doc_id, s, e - s AS length, q FROM r
        WHERE NOT EXISTS (FROM r o WHERE o.doc_id = r.doc_id AND ((o.e - o.s) * r.q > (r.e - r.s) * o.q OR (o.e - o.s) * r.q = (r.e - r.s) * o.q AND (o.s, o.q) < (r.s, r.q))))
      SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli,
        sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
      FROM d LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)""")
def periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    # runs come by start and period, so the first of the largest is the one asked for
    larger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), larger)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# 12: shards

SHARDS = 24


def _shards_sql() -> str:
    best = lambda scores: f"CAST(list_position({scores}, list_max({scores})) - 1 AS INTEGER)"
    code = "instr('0123456789ABCDEF', substr(hex(data[i : i]), 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(data[i : i]), 2, 1)) - 17"
    return f"""WITH k AS (SELECT {_CRC_TABLE} AS crcs),
      t AS (SELECT doc_id, encode(coalesce(text, '')) AS data, octet_length(data) AS n, crcs FROM documents, k),
      c AS (SELECT doc_id, n + 8 AS size, {_crc_sql(f"list_transform(range(1, n + 1), lambda i: CAST({code} AS BIGINT))", "crcs")} AS text_crc32,
        list_transform(range({SHARDS + 1}), lambda s: 1 / -ln((CAST('0x' || substr(md5(s || '-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {shards.DIGITS}) AS BIGINT) + 0.5) / {float(shards.SPAN)})) AS score,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {shards.DIGITS}) AS BIGINT) AS place FROM t),
      s AS (SELECT *, {best(f'score[1 : {SHARDS}]')} AS shard, {best('score')} AS grown_shard FROM c)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


@query("op12_rendezvous_shards", _shards_sql())
def rendezvous_shards(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    shards.write_shards(table(spark, sf_dir, "documents"), path, [1.0] * SHARDS)
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    return shards.read_shards(spark, path).select(
        doc_id.alias("doc_id"), shards.text_bytes(text).alias("size"), shards.text_crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", shards.shard_of(doc_id, [1.0] * (SHARDS + 1)).alias("grown_shard"))


# 13: hard negatives


@query("op13_hard_negatives", """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
      p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
      n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
          CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
      SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"))
