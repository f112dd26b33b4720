"""Thresholds, labels, ranks, caps and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import label
from ..params import Thresholds
from ..session import cut_lineage
from .scan import chunked, row_numbers, running
from .selection import top_n, values_at
from .skew import skew_join

# Sources whose works count as preprints (compared in lower case).
# the largest limit on a row number that Spark applies before the shuffle
PRUNED_ROWS = 1_000
PREPRINT_SOURCES = ("arxiv", "biorxiv", "medrxiv")


def top_counts(counted: DataFrame, keys: Sequence[str], count: str, value: str, n: int) -> DataFrame:
    """Top n values per group, ties by value; adds ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(count), value)
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def top_ranked(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k per profile. Spark prunes limits up to ``PRUNED_ROWS`` before the shuffle; for larger ones the rows are selected first."""
    if k > PRUNED_ROWS:
        scored = top_n(scored, ["profile_id"], F.col(score), "ordinal", k)
    best = Window.partitionBy("profile_id").orderBy(F.desc(score), "ordinal")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def score_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("ordinal")]


def order_by_score(scored: DataFrame, score: str = "score") -> DataFrame:
    """Spread the score order of all profiles over chunks; see ``scan``."""
    return chunked(scored, ["profile_id"], score_order(score))


def full_rank(ordered: DataFrame, score: str = "score", name: str = "rank") -> DataFrame:
    """Position of every row (no limit)."""
    return row_numbers(ordered, ["profile_id"], score_order(score), name)


def percentile_thresholds(scored: DataFrame, p: Thresholds = Thresholds(), score: str = "score") -> DataFrame:
    """``(profile_id, must_read, consider, mode)``; exact percentiles with linear interpolation.

    The scores at the two places around each percentile are found by histograms (see ``selection``), so nothing sorts a
    whole profile. ``scored`` is read several times.
    """
    sizes = scored.groupBy("profile_id").agg(F.count("*").alias("n"))
    if p.mode == "fixed":
        return sizes.select("profile_id", F.lit(p.must_read).alias("must_read"), F.lit(p.consider).alias("consider"), F.lit("fixed").alias("mode"))
    sizes = cut_lineage(sizes)
    spots = {"m": p.must_read_percentile, "c": p.consider_percentile}
    places = []
    for name, q in spots.items():
        at = (F.col("n") - 1) * F.lit(q / 100.0)  # 0 = lowest score
        for side, whole in (("low", F.floor(at)), ("high", F.ceil(at))):
            places.append(F.struct(F.lit(f"{name}_{side}").alias("spot"), (F.col("n") - 1 - whole).cast("long").alias("at"), (at - F.floor(at)).alias("part")))
    asked = sizes.select("profile_id", "n", F.explode(F.array(*places)).alias("x")).select("profile_id", "n", "x.*")
    values = values_at(scored, ["profile_id"], asked, score).withColumnRenamed(score, "_at_score")
    found = asked.join(values, ["profile_id", "at"]).groupBy("profile_id", "n").agg(
        *[F.max(F.when(F.col("spot") == f"{name}_{side}", F.col("_at_score"))).alias(f"{name}_{side}") for name in spots for side in ("low", "high")],
        *[F.max(F.when(F.col("spot") == f"{name}_low", F.col("part"))).alias(f"{name}_part") for name in spots],
    )

    def at_percentile(name: str) -> Column:
        return F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")

    floored = found.select(
        "profile_id", "n",
        F.greatest(at_percentile("m"), F.lit(p.min_must_read)).alias("m"),
        F.greatest(at_percentile("c"), F.lit(p.min_consider)).alias("c"),
    )
    enough = F.col("n") >= 2
    must = F.when(F.col("m") <= F.col("c"), F.col("c") + F.lit(0.01)).otherwise(F.col("m"))
    return floored.select(
        "profile_id",
        F.when(enough, must).otherwise(F.lit(p.must_read)).alias("must_read"),
        F.when(enough, F.col("c")).otherwise(F.lit(p.consider)).alias("consider"),
        F.when(enough, F.lit("dynamic")).otherwise(F.lit("fixed")).alias("mode"),
    )


def with_labels(scored: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    """A profile with very many rows is cut into parts for the join."""
    joined = skew_join(scored, thresholds.select("profile_id", "must_read", "consider"), ["profile_id"], "inner", ["ordinal"])
    return joined.withColumn("label", label(F.col(score), F.col("must_read"), F.col("consider"))).drop("must_read", "consider")


def label_distribution(labeled: DataFrame) -> DataFrame:
    """Count and percent per label, zero rows included."""
    counts = labeled.groupBy("profile_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("label") == name).alias(name) for name in ("must_read", "consider", "ignore")],
    )
    return counts.select(
        "profile_id", "total",
        F.explode(F.create_map(*[x for n in ("must_read", "consider", "ignore") for x in (F.lit(n), F.col(n))])).alias("label", "label_count"),
    ).withColumn("percent", F.lit(100.0) * F.col("label_count") / F.col("total"))


def preprint_allowance(others: Column, max_ratio: float) -> Column:
    """Most preprints p with p / (p + others) <= max_ratio, by the same floating point test."""
    guess = F.floor(F.lit(max_ratio) * others / F.lit(1 - max_ratio)).cast("long")

    def fits(p: Column) -> Column:
        return (p >= 0) & (p / F.greatest(p + others, F.lit(1)) <= F.lit(max_ratio))

    return F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(F.greatest(guess - 1, F.lit(0)))


def limit_preprints(ordered: DataFrame, max_ratio: float = 0.9, score: str = "score") -> DataFrame:
    """Walk down the score order and skip a preprint that would lift the preprint share above the ratio.

    With a = preprints seen and cap(j) = preprints that j other works allow, the number
    admitted so far is a + min(0, min over preprints so far of cap - a). A preprint is
    refused when its own cap - a is a new low below zero. ``ordered`` comes from
    ``order_by_score``.
    """
    if max_ratio <= 0 or max_ratio >= 1:
        return ordered
    keys, order = ["profile_id"], score_order(score)
    is_preprint = F.lower("source").isin(*PREPRINT_SOURCES)
    counted = running(
        ordered.withColumn("_pre", is_preprint), keys, order,
        sums={"_seen": F.when(F.col("_pre"), 1).otherwise(0).cast("long"), "_others": F.when(F.col("_pre"), 0).otherwise(1).cast("long")},
    )
    gap = F.when(F.col("_pre"), preprint_allowance(F.col("_others"), max_ratio) - F.col("_seen"))
    lows = running(counted.withColumn("_gap", gap), keys, order, mins_before={"_low": F.col("_gap")})
    refused = F.col("_pre") & (F.col("_gap") < F.least(F.lit(0), F.col("_low")))
    return lows.where(~refused).drop("_pre", "_seen", "_others", "_gap", "_low")


def cold_start(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """No library yet: a repeatable shuffle (the first digits of a hash), score 0, everything labelled "consider"."""
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("profile_id").cast("string"), F.col("identifier")), 256)
    return candidates.select(
        "*", F.lit(0.0).alias("score"), F.lit(0.0).alias("similarity"), F.lit("consider").alias("label"),
        F.conv(F.substring(mixed, 1, 13), 16, 10).cast("double").alias("shuffle_key"),
    )


def numbered_batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Batch number of each row when n rows go into one request."""
    rows = row_numbers(chunked(df, keys, order), keys, order, "_row")
    return rows.withColumn("batch_no", F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row", "_chunk")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "position") -> DataFrame:
    """First n rows per group, for prompts and reports."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)
