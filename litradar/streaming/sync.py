"""Streaming forms: library sync, candidate feed, first sightings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import LIBRARY_ITEM, parse_library_items
from ..sources.stores import LogStore, high_water_marks

TOMBSTONE = "profile_id long, key string, version long"


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sync_library(spark: SparkSession, landing: str, store: LogStore, state: LogStore, checkpoint: str,
                 excluded_tags: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Append landed library records (JSON lines with a ``profile_id``) to the store.

    The store keeps the highest version per key, so a batch that is replayed after a failure
    changes nothing. The mark moves only when a batch brought rows.
    """
    stream = spark.readStream.schema("profile_id long, " + LIBRARY_ITEM).json(landing)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = parse_library_items(batch, excluded_tags, F.col("profile_id"))
        store.append(rows)
        marks = high_water_marks(rows).select(
            "profile_id", F.lit("high_water").alias("key"), F.col("high_water").cast("string").alias("value"),
            # the version orders the marks, so a replay cannot move one back
            F.timestamp_micros(F.col("high_water").cast("long")).alias("changed_at"),
        )
        state.append(marks)

    return run_batches(stream, handle, checkpoint, once)


def sync_tombstones(spark: SparkSession, landing: str, store: LogStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append deletions; a later version of the record brings it back."""
    stream = spark.readStream.schema(TOMBSTONE).json(landing)
    return run_batches(stream, lambda batch, _: store.append(batch, deleted=True), checkpoint, once)


def score_feed(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score each trigger's candidates as one batch: thresholds and caps belong to a batch.

    Results go to one folder per batch, overwritten when the batch is replayed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return run_batches(stream, handle, checkpoint, once)


def fresh_works(stream: DataFrame, library_keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream-static anti join: works whose key the library does not hold."""
    return stream.join(library_keys, list(on), "left_anti")


def first_sightings(stream: DataFrame, key: str, event_time: str, ttl_days: int) -> DataFrame:
    """Drop works seen before; the state of a key is kept for the TTL only."""
    return stream.withWatermark(event_time, f"{ttl_days} days").dropDuplicatesWithinWatermark([key])
