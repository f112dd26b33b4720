"""Keyed stores on parquet.

Writers only append rows with an order column; readers keep the last row per key. An
append is safe to repeat after a lost executor or a replayed batch, and needs no
rewrite of the store. ``compact`` rewrites it when wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import moment
from ..operators.filters import unexpired


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key as a whole. A grouped maximum, so a hot key is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def merge(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: the new row wins wholly when its order is not lower."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "_side"]).drop("_side")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def with_expiry(rows: DataFrame, as_of, ttl_days: int | None) -> DataFrame:
    """Stamp the creation time and, with a TTL, when the row expires."""
    now = moment(as_of)
    expires = F.lit(None).cast("timestamp") if ttl_days is None else now + F.make_dt_interval(days=F.lit(ttl_days))
    return rows.withColumn("created_at", now).withColumn("expires_at", expires)


def live(rows: DataFrame, as_of) -> DataFrame:
    return rows.where(unexpired(as_of))


def expired(rows: DataFrame, as_of) -> DataFrame:
    return rows.where(~unexpired(as_of))


def store_counts(rows: DataFrame, as_of) -> DataFrame:
    """Entries per model and source, and how many of them have expired."""
    return rows.groupBy("model", "source_type").agg(F.count("*").alias("entries"), F.count_if(~unexpired(as_of)).alias("expired_entries"))


def invalidate(rows: DataFrame, condition: Column) -> DataFrame:
    """Keep what does not match (a model, a source type)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


class LogStore:
    """One append-only parquet table with a key and an order column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str],
                 partition_by: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), list(order)
        self.schema, self.partition_by = schema, list(partition_by)

    def append(self, rows: DataFrame, deleted: bool = False) -> None:
        """Add rows; with ``deleted`` they hide the key up to their order."""
        shaped = self._shape(rows).withColumn("is_deleted", F.lit(deleted))
        shaped.write.mode("append").partitionBy(*self.partition_by).parquet(self.path)

    def _shape(self, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return empty.unionByName(rows.select(*[c for c in rows.columns if c in empty.columns]), allowMissingColumns=True)

    def log(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema).withColumn("is_deleted", F.lit(False))
        return self.spark.read.schema(empty.schema).option("pathGlobFilter", "*.parquet").parquet(self.path)

    def current(self) -> DataFrame:
        """Live rows: last per key, tombstones gone."""
        return self._newest(self.log())

    def _newest(self, log: DataFrame) -> DataFrame:
        newest = latest(log, self.keys, [*self.order, "is_deleted"])
        return newest.where(~F.coalesce(F.col("is_deleted"), F.lit(False))).drop("is_deleted")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Live rows of some keys; only their rows of the log are grouped."""
        return self._newest(self.log().join(keys.select(*self.keys).distinct(), self.keys, "left_semi"))

    def compact(self, target: str) -> "LogStore":
        """Write the live rows to a new folder; the caller switches over when it is complete."""
        fresh = LogStore(self.spark, target, self.schema, self.keys, self.order, self.partition_by)
        fresh.append(self.current())
        return fresh


# Store shapes.
LIBRARY = (
    "profile_id long, key string, version long, title string, abstract string, creators array<string>, tags array<string>, "
    "collections array<string>, year int, doi string, url string, date_added timestamp, raw_date string, venue string, content_hash string"
)
EMBEDDING = "content_hash string, model string, embedding array<float>, source_type string, source_id string, created_at timestamp, expires_at timestamp"
ABSTRACT = "doi string, abstract string, title string, source string, created_at timestamp, expires_at timestamp"
SUMMARY = "paper_id string, signature string, bullets string, detailed string, model_used string, tokens_used long, generated_at timestamp"
TRANSLATION = "paper_id string, target_language string, original_title string, translated_title string, model_used string, generated_at timestamp"
STATE = "profile_id long, key string, value string, changed_at timestamp"
ANALYSIS = "profile_id long, signature string, kind string, content string, generated_at timestamp"


def library_store(spark: SparkSession, path: str) -> LogStore:
    return LogStore(spark, path, LIBRARY, ["profile_id", "key"], ["version"])


def embedding_store(spark: SparkSession, path: str) -> LogStore:
    return LogStore(spark, path, EMBEDDING, ["content_hash", "model"], ["created_at"], ["model"])


def abstract_store(spark: SparkSession, path: str) -> LogStore:
    return LogStore(spark, path, ABSTRACT, ["doi"], ["created_at"])


def summary_store(spark: SparkSession, path: str) -> LogStore:
    """Keyed by paper and signature: another prompt or model is another partition."""
    return LogStore(spark, path, SUMMARY, ["paper_id", "signature"], ["generated_at"], ["signature"])


def translation_store(spark: SparkSession, path: str) -> LogStore:
    return LogStore(spark, path, TRANSLATION, ["paper_id", "target_language"], ["generated_at"])


def state_store(spark: SparkSession, path: str) -> LogStore:
    return LogStore(spark, path, STATE, ["profile_id", "key"], ["changed_at"])


def analysis_store(spark: SparkSession, path: str) -> LogStore:
    """Profile analysis and clustered profiles, keyed by library hash or embedding signature."""
    return LogStore(spark, path, ANALYSIS, ["profile_id", "signature", "kind"], ["generated_at"])


def high_water_marks(library: DataFrame) -> DataFrame:
    return library.groupBy("profile_id").agg(F.max("version").alias("high_water"))
