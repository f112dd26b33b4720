"""Bring landed library records into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hash_changes
from ..sources.stores import high_water_marks, merge, without_tombstones


def sync(current: DataFrame, incoming: DataFrame, tombstones: DataFrame, full: bool = False) -> dict[str, DataFrame]:
    """New library state, counters and marks.

    Only records above the profile's old mark count (all of them on a full run); the same old
    mark holds for tombstones, so a deletion between two marks is not lost.
    ``tombstones(profile_id, key, version)``.
    """
    marks = high_water_marks(current)

    def above(rows: DataFrame) -> DataFrame:
        if full:
            return rows
        return rows.join(marks, "profile_id", "left").where(F.col("version") > F.coalesce("high_water", F.lit(0))).drop("high_water")

    new, gone = above(incoming), above(tombstones)
    keys = ["profile_id", "key"]
    # a record that came back after its deletion stays
    newest = new.groupBy(*keys).agg(F.max("version").alias("_v"))
    dead = gone.join(newest, keys, "left").where(F.col("_v").isNull() | (F.col("_v") < F.col("version"))).select(*keys)
    merged = without_tombstones(merge(current, new, keys, ["version"]), dead, keys)
    counts = new.groupBy("profile_id").agg(F.count("*").alias("fetched"), F.max("version").alias("_new")).join(
        gone.groupBy("profile_id").agg(F.count("*").alias("removed"), F.max("version").alias("_gone")), "profile_id", "full"
    ).join(marks, "profile_id", "full")
    stats = counts.select(
        "profile_id", F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("fetched", F.lit(0)).alias("updated"),
        F.coalesce("removed", F.lit(0)).alias("removed"),
        F.greatest(F.coalesce("high_water", F.lit(0)), F.coalesce("_new", F.lit(0)), F.coalesce("_gone", F.lit(0))).alias("high_water"),
    )
    return {"library": merged, "stats": stats, "changes": hash_changes(current, merged)}
