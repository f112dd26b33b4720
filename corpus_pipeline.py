"""Documents to token files: language, near-duplicates, benchmark passages, source weights, token ids.

Each stage reads what its predecessor wrote and decides about whole documents. All but the last return the columns of
the documents. Rows are told apart by ``doc_id`` and text; a list of removed documents is broadcast while it is short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litradar.llm import decontaminate, language, mixing, near_dedup, token_files
from litradar.llm.catalog import WEIGHTS, domain_of, tokenizer_path
from litradar.llm.common import small_side, table
from litradar.session import cut_lineage, ensure_checkpoint_dir, pin_utc

# a text whose best language has a lower score is rejected
LEAST_SCORE = 0.25
# share of all tokens that the mixture may take, in per cent; no document is taken twice
MIX_SEED, MIX_PERCENT = 29, 80


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_h"))


def _join(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of whole rows with distinct ``doc_id, _h``; the documents may have columns of any name."""
    d, x = (f"_key_{uuid.uuid4().hex}" for _ in range(2))
    named = small_side(cut_lineage(keys.select(F.col("doc_id").alias(d), F.col("_h").alias(x)).distinct()))
    return docs.join(named, (F.xxhash64(docs["text"]) == F.col(x)) & docs["doc_id"].eqNullSafe(F.col(d)), how)


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    return _join(docs, removed, "left_anti")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that was learned and a sufficient score; null texts and such without a letter go."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    found = language.identify(keyed, model, ["doc_id", "_h"])
    return _without(docs, found.where((F.col("lang_pred") == language.UNDETERMINED) | (F.col("score") < LEAST_SCORE)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates; of equal rows one."""
    found = cut_lineage(near_dedup.near_duplicates(docs))
    rest = _without(docs, found.where(~F.col("kept")))
    again = cut_lineage(found.where("kept").groupBy("doc_id", "_h").count().where("count > 1").select("doc_id", "_h"))
    if again.isEmpty():
        return rest
    one = _join(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(rest, again).unionByName(one)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with a benchmark passage."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the tree of domains, languages and sources has a budget for; the last of a prefix stays whole."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("_h"))
    taken = mixing.mixture(keyed, levels, WEIGHTS, F.expr(f"tokens * {MIX_PERCENT} div 100"), MIX_SEED, 1, ("doc_id", "_h"))
    chosen = taken.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_x"))
    left = _keys(docs).join(chosen, (F.col("_h") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
    return _without(docs, left)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as token files and returns what these hold."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, path, tokenizer_path())
    return token_files.read_tokens(spark, path)


STAGES = [
    ("language", by_language),
    ("near-duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixture", to_weights),
    ("token files", to_token_files),
]

# fitted models, MinHash and the tokenizer are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    pin_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
