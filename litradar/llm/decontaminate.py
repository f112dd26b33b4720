"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item is cut into windows of ``window_words`` consecutive words. A window occurs in a document only if all its
shingles do, so one necessary shingle is enough as its prefix: the one that is rarest in the documents. Documents join
on that shingle; the window's place follows from the shingle's offset, must lie inside the document (length and
positional bound), and is then compared word by word. Everything is a DataFrame expression.

While the benchmark side is small it is broadcast, and shuffles carry only hits and one row per document. Beyond that the
places are joined by shuffle as (document, place, shingle) without their words, which are then attached, once for each
document, to the few places that met a window. A shingle in very many documents costs one row for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import HOT_ROWS, skew_join
from ..session import cut_lineage
from .common import BROADCAST_ROWS, is_small, lower_ascii, small_side

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII ones that are no letter or digit, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at`` (from 0); past the end it is a value that may match, the comparison decides."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def item_windows(benchmark: DataFrame, window_words: int) -> DataFrame:
    """Distinct (item_id, window); an item with fewer words is one window, one without words has none."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window_words, F.lit(0))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, window_words).alias("window")).distinct()


def _window_shingles(windows: DataFrame, shingle_words: int) -> DataFrame:
    """All shingles of each window: (window, offset, size, token)."""
    size = F.least(F.size("window"), F.lit(shingle_words))
    spots = windows.select("window", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("window") - size)).alias("offset"))
    token = F.lit(None).cast("long")
    for n in range(1, shingle_words + 1):
        token = F.when(F.col("size") == n, _shingle(F.col("window"), F.col("offset"), n)).otherwise(token)
    return spots.select("window", "offset", "size", token.alias("token"))


def _document_tokens(words: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """A row for each place (``pos`` from 1) and shingle size, and one with ``pos`` 0 and no token for each document."""
    placed = words.select(*keep, "words", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "_word"))
    one = lambda n: F.when(F.col("pos") > 0, _shingle(F.col("words"), F.col("pos") - 1, n))
    if len(sizes) == 1:
        return placed.select(*keep, "words", "pos", F.lit(sizes[0]).alias("size"), one(sizes[0]).alias("token"))
    tokens = F.array(*[F.struct(F.lit(n).alias("size"), one(n).alias("token")) for n in sizes])
    spread = placed.select(*keep, "words", "pos", F.explode(tokens).alias("t")).where((F.col("pos") > 0) | (F.col("t.size") == sizes[0]))
    return spread.select(*keep, "words", "pos", "t.size", "t.token")


def rarest_shingles(documents: DataFrame, windows: DataFrame, shingle_words: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each window that can occur: its necessary shingle, the rarest over all documents, ties to the first, and its places ``n``."""
    shingles = cut_lineage(_window_shingles(windows.select("window").distinct(), shingle_words))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most shingle_words values
    if not sizes:
        return shingles.withColumn("n", F.lit(0).cast("long"))
    known = cut_lineage(shingles.select("size", "token").distinct())
    tokens = _document_tokens(documents.select(words_of(F.col("text")).alias("words")), sizes).select("size", "token")
    if is_small(known, broadcast_rows):
        counts = tokens.join(F.broadcast(known), ["size", "token"]).groupBy("size", "token").agg(F.count("*").alias("n"))
    else:  # places are counted before they are shuffled
        counts = tokens.where("token IS NOT NULL").groupBy("size", "token").agg(F.count("*").alias("n")).join(known, ["size", "token"], "left_semi")
    rarity = shingles.join(cut_lineage(counts), ["size", "token"], "left")
    # a shingle that is in no document excludes its window
    best = rarity.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "size", "token")).alias("best"))
    return best.where(F.col("best.n") > 0).select("window", "best.offset", "best.size", "best.token", "best.n")


def _place(window_at: Column) -> list[Column]:
    """First word of a window and the word after its last."""
    return [window_at.cast("long").alias("_start"), (window_at + F.size("window")).cast("long").alias("_end"), F.col("item_id").cast("string").alias("item")]


def _same_words(at: Column) -> Column:
    """Whether the window stands at word ``at`` of ``words``; outside the text it does not."""
    n = F.size("window")
    inside = (at >= 0) & (at + n <= F.size("words"))
    return F.coalesce(inside & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.greatest(n, F.lit(0))) == F.col("window")), F.lit(False))


def _broadcast_hits(words: DataFrame, probes: DataFrame, sizes: list[int]) -> DataFrame:
    """One pass over the words: a base row for each document (``_base`` 1) and a row for each occurrence."""
    tokens = _document_tokens(words, sizes, "doc_id", "_h")
    probes = F.broadcast(probes.withColumnRenamed("token", "_t"))
    met = tokens.join(probes, (F.col("token") == F.col("_t")) & (F.col("size") == F.col("t_size")), "left")
    base, at = F.col("pos") == 0, F.col("pos") - 1 - F.col("offset")
    start, end, item = _place(F.when(base, -1).otherwise(at))
    return met.where(base | _same_words(at)).select(
        "doc_id", "_h", F.size("words").cast("long").alias("n_words"), base.cast("long").alias("_base"),
        start, F.when(base, F.lit(-1).cast("long")).otherwise(end).alias("_end"), item)


def _shuffled_hits(words: DataFrame, probes: DataFrame, sizes: list[int]) -> DataFrame:
    """As ``_broadcast_hits`` for any number of probes; no shuffle before the hits carries words."""
    tokens = _document_tokens(words, sizes, "doc_id", "_h").where("pos > 0").select(
        "doc_id", "_h", "pos", "size", "token", F.size("words").alias("_n"))
    probes = probes.withColumnRenamed("t_size", "size")
    # how often a shingle occurs is known already
    hot = probes.where(F.col("n") > HOT_ROWS).select("size", "token", F.ceil(F.col("n") / HOT_ROWS).cast("long").alias("_parts")).distinct()
    met = skew_join(tokens, probes, ["size", "token"], "inner", ["_h", "pos"], hot=hot)
    met = met.withColumn("_at", F.col("pos") - 1 - F.col("offset")).where((F.col("_at") >= 0) & (F.col("_at") + F.size("window") <= F.col("_n")))
    met = cut_lineage(met.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_x"), "_at", "window", "item_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_x"))
    asked = small_side(cut_lineage(met.select("_d", "_x").distinct()))
    # copies of a row have the same words: one of them is enough
    one_each = words.join(asked, same, "left_semi").dropDuplicates(["doc_id", "_h"])
    hits = met.join(one_each, same).where(_same_words(F.col("_at")))
    n_words = F.size("words").cast("long").alias("n_words")
    none = F.lit(-1).cast("long")
    base = words.select("doc_id", "_h", n_words, F.lit(1).cast("long").alias("_base"), none.alias("_start"), none.alias("_end"),
                        F.lit(None).cast("string").alias("item"))
    return base.unionByName(hits.select("doc_id", "_h", n_words, F.lit(0).cast("long").alias("_base"), *_place(F.col("_at"))))


def contamination(documents: DataFrame, benchmark: DataFrame, window_words: int = 10, shingle_words: int = 3,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items`` (sorted as strings), ``contaminated``, and ``_h``, the hash of its text.

    A document word inside any occurrence of an item window is hit. Null and empty texts have no words and no hits; an
    item that is null or has no word has no window; items that share windows each count; repeated rows give a row each;
    a null doc_id is kept as it is; an empty benchmark leaves every document clean; other columns are ignored. Up to
    ``broadcast_rows`` probes are broadcast, more are joined by shuffle with the same result.
    """
    windows = cut_lineage(item_windows(benchmark, window_words))
    prefix = rarest_shingles(documents, windows, shingle_words, broadcast_rows)
    probes = cut_lineage(windows.join(prefix, "window").select("token", F.col("size").alias("t_size"), "offset", "window", "item_id", "n"))
    sizes = sorted(r["t_size"] for r in probes.select("t_size").distinct().collect()) or [shingle_words]
    # rows with the same doc_id and the same text have the same result
    words = documents.select("doc_id", F.xxhash64("text").alias("_h"), words_of(F.col("text")).alias("words"))
    kept = (_broadcast_hits if is_small(probes, broadcast_rows) else _shuffled_hits)(words, probes, sizes)
    key = ["doc_id", "_h"]
    # equal rows are combined before the shuffle
    starts = kept.groupBy(*key, "_start").agg(
        F.max("n_words").alias("n_words"), F.sum("_base").alias("_rows"), F.max("_end").alias("_end"), F.collect_set("item").alias("items"))
    before = Window.partitionBy(*key).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("_end") - F.greatest("_start", F.coalesce("_reach", F.lit(0))), F.lit(0))
    merged = starts.withColumn("_reach", F.max("_end").over(before)).groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum("_rows").alias("_rows"), F.sum(F.when(F.col("_start") >= 0, covered).otherwise(0)).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one_each = merged.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return one_each.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "_h")
