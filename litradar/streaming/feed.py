"""The candidate feed: each trigger's works are deduped against the library and all earlier output, then scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_doi, normalize_identifier
from ..operators.dedupe import dedupe
from ..session import cut_lineage
from .sync import run_batches

SEEN = "profile_id long, identifier string, doi string, title string, seen_at timestamp"


def seen_works(spark: SparkSession, folder: str, before_batch: int, clock: DataFrame | None = None, ttl_days: int | None = None) -> DataFrame:
    """What earlier triggers put out, without what is older than the TTL at ``clock`` (one row, ``now``).

    A trigger's rows are a folder of their own, so a replayed trigger does not meet its own output.
    """
    rows = spark.read.schema(f"{SEEN}, batch_id long").option("basePath", f"{folder}/seen").parquet(f"{folder}/seen")
    rows = rows.where((F.col("batch_id") >= 0) & (F.col("batch_id") < before_batch)).drop("batch_id")
    if ttl_days is None or clock is None:
        return rows
    fresh = F.col("seen_at").isNull() | F.col("now").isNull() | (F.col("seen_at") + F.make_dt_interval(F.lit(ttl_days)) > F.col("now"))
    return rows.crossJoin(F.broadcast(clock)).where(fresh).drop("now")


def as_known(seen: DataFrame) -> DataFrame:
    """Earlier output in the shape of library rows. Identifiers and DOIs share one set of values."""
    plain = seen.select("profile_id", "title", "doi", F.col("identifier").alias("url"))
    crossed = seen.select("profile_id", F.lit("").alias("title"), normalize_identifier(F.col("identifier")).alias("doi"), normalize_doi(F.col("doi")).alias("url"))
    return plain.union(crossed)


def watch_feed(stream: DataFrame, library: DataFrame, score_batch: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str,
               ttl_days: int | None = None, threshold: float = 0.9, once: bool = True) -> StreamingQuery:
    """Write ``folder/output/batch_id=…`` (scored rows) and ``folder/seen/batch_id=…`` (keys of the kept works) for each trigger.

    ``stream`` has ``profile_id, ordinal, identifier, doi, title, published`` and whatever ``score_batch`` needs; ``library`` has
    ``profile_id, title, doi, url``. A work is kept unless the library, earlier output that has not expired, or an earlier
    work of its trigger matches it by DOI, link or title. Time is the latest ``published`` of the trigger, so a replay gives
    the same rows. Thresholds and caps belong to a trigger, as ``score_batch`` sees its works only.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], SEEN).write.mode("overwrite").parquet(f"{folder}/seen/batch_id=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        works = cut_lineage(batch)
        clock = works.agg(F.max(F.col("published").cast("timestamp")).alias("now"))
        seen = seen_works(spark, folder, batch_id, clock, ttl_days)
        known = cut_lineage(library.select("profile_id", "title", "doi", "url").union(as_known(seen)))
        kept = cut_lineage(dedupe(works, known, threshold))
        score_batch(kept).write.mode("overwrite").parquet(f"{folder}/output/batch_id={batch_id}")
        keys = kept.select("profile_id", "identifier", "doi", "title", F.col("published").cast("timestamp").alias("seen_at"))
        keys.write.mode("overwrite").parquet(f"{folder}/seen/batch_id={batch_id}")

    return run_batches(stream, handle, checkpoint, once)
