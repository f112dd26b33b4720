"""Shard files by rendezvous hashing of record keys over weighted shards.

Every shard draws a number from the key and its own number; the record goes to the shard with the highest draw, scaled by
the weights. A shard's draw does not depend on the others, so a new shard takes only the records in which it wins and
no record moves between old ones. The shard follows from key, weights and number of shards alone.

Records get their place in the order of their keys' hashes. A shard is cut into pieces of bounded size along that order and
the rows of a piece are numbered by a window; a small index holds the first slot of each piece. So a shard's slots are
gapless without a task that sees the whole shard. Rows of a key with very many rows are cut further. Everything is
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import HOT_ROWS
from ..session import cut_lineage
from .common import small_side

# hexadecimal digits of a draw: 52 bits, exact in a double
DIGITS, SPAN = 13, 2**52
PIECE_BYTES = 64 << 20
# what a record takes besides its text
RECORD_BYTES = 8


def _draw(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0, of a key. ``weights`` has one positive weight a shard; a missing key counts as an empty one.

    With u uniform in (0, 1), the largest of w / -ln(u) is shard s with probability w_s / sum(w).
    """
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def score(shard: Column) -> Column:
        u = (_draw(F.concat(shard.cast("string"), F.lit("-"), _key_text(key))) + F.lit(0.5)) / F.lit(float(SPAN))
        # equal scores go to the smaller number
        return F.struct((F.element_at(shares, shard + 1) / -F.ln(u)).alias("score"), (-shard).alias("shard"))

    return -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["shard"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD_BYTES)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def write_shards(documents: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", text: str = "text",
                 piece_bytes: int = PIECE_BYTES, hot_rows: int = HOT_ROWS) -> None:
    """Write the rows, with all their columns, as Parquet files of shards 0, 1, … under ``path/rows``, with ``path/index`` and ``path/columns``.

    Texts are shuffled once. The order within a shard is the hash of the key, then the key, the CRC-32 and the length of the
    text; rows equal in these are equal but for other columns. Null texts are empty, a null key counts as an empty one,
    repeated rows get a slot each, columns of any name are kept, an empty table gives empty files. Keys with more than
    ``hot_rows`` rows are cut by text and by input partition, in that order; this does not change their shard.
    """
    spark = documents.sparkSession
    keyed = documents.select(F.struct("*").alias("record"), F.col(key).alias("key"), text_bytes(F.col(text)).alias("size"))
    # one pass over lengths; the number of shards bounds what comes back
    total = documents.agg(F.sum(text_bytes(F.col(text)))).first()[0] or 0
    pieces = max(1, -(-int(total) // (piece_bytes * len(weights))))
    counts = documents.groupBy(F.col(key).alias("_k")).count().where(F.col("count") > hot_rows)
    hot = small_side(cut_lineage(counts.select("_k", F.ceil(F.col("count") / hot_rows).cast("long").alias("_parts"))))
    place = _draw(_key_text(F.col("key")))
    placed = keyed.select("*", shard_of(F.col("key"), weights).alias("shard"), place.alias("place"), text_crc32(F.col("record")[text]).alias("crc"),
                          F.spark_partition_id().alias("_from"))
    cut = F.pmod(F.xxhash64("crc", "size", "_from"), F.col("_parts")).cast("int")
    placed = placed.join(hot, F.col("key").eqNullSafe(F.col("_k")), "left").select(
        "record", "key", "size", "shard", "place", "crc", F.floor(F.col("place") * F.lit(pieces) / F.lit(SPAN)).cast("int").alias("piece"),
        F.coalesce(cut, F.lit(0)).alias("part"))
    order = Window.partitionBy("shard", "piece", "part").orderBy("place", "key", "crc", "size")
    rows = placed.withColumn("row", F.row_number().over(order)).select("record", "shard", "piece", "part", "row")
    rows.write.partitionBy("shard").parquet(f"{path}/rows")
    # an empty table of the columns; without rows there are no other files
    rows.limit(0).write.parquet(f"{path}/columns")
    # counted from what was written; a row per piece, and a shard's pieces in one window
    written = _rows(spark, path).groupBy("shard", "piece", "part").count()
    before = Window.partitionBy("shard").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    written.select("shard", "piece", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot")).write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (the struct of all columns of a row), ``shard`` and ``slot`` (from 0, gapless within a shard)."""
    rows = _rows(spark, path).join(small_side(spark.read.parquet(f"{path}/index")), ["shard", "piece", "part"])
    return rows.select("record", "shard", (F.col("first_slot") + F.col("row") - 1).alias("slot"))
