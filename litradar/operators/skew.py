"""Joins whose left keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
# only the hottest keys are split, so that their list may always be broadcast
MOST_HOT_KEYS = 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and into how many parts to cut them. Counts are combined before the shuffle."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("long").alias("_parts"))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], hot_rows: int = HOT_ROWS,
              hot: DataFrame | None = None) -> DataFrame:
    """Join with few right rows per key; a left key with many rows is cut into parts.

    Only the right rows of hot keys are copied, once per part. ``spread_by`` tells the rows of a key apart.
    ``hot`` is the result of ``hot_keys`` when it is known already.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(left.select(*keys), keys, hot_rows)
    # a key beyond the limit stays whole on both sides
    hot = F.broadcast(hot.orderBy(F.desc("_parts"), *keys).limit(MOST_HOT_KEYS))
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    cut = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread_by), parts)).drop("_parts")
    copies = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return cut.join(copies, [*keys, "_part"], how).drop("_part")


def never_null(key: Column, *row: str) -> Column:
    """A key for left and anti joins: a missing key becomes one that matches nothing, different per row.

    All null keys of a shuffle go to one task.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))


def with_slices(rows: DataFrame, keys: Sequence[str], slice_by: str, slice_rows: int) -> DataFrame:
    """Add ``slice``: 0 for small groups; larger ones are cut into slices of about ``slice_rows`` rows."""
    hot = hot_keys(rows.select(*keys), keys, slice_rows)
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    return rows.join(hot, list(keys), "left").withColumn("slice", F.pmod(F.xxhash64(slice_by), parts)).drop("_parts")
