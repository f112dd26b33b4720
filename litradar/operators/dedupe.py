"""Duplicate works: by DOI, by identifier, by fuzzy title, against the library and within a batch."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null, normalize_doi, normalize_identifier, normalize_title
from ..functions.titles import overlap_ratio, token_key, token_set_ratio
from ..session import cut_lineage
from .graph import components
from .skew import HOT_ROWS, never_null, skew_join

# titles, and their letters, in a block of the pairs by edit distance
TITLE_BLOCK, BLOCK_LETTERS = 32_768, 4_000_000
# batch dedupe: rounds before connected parts are looked for, and the entries of a part that one task may settle
ROUNDS, COMPONENT_ENTRIES = 4, 500_000


def without_known_dois(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Drop candidates whose DOI is in the profile's library (lower case, stripped)."""
    known = library.select("profile_id", normalize_doi(F.col("doi")).alias("_doi")).where("_doi IS NOT NULL").distinct()
    keyed = candidates.withColumn("_doi", never_null(normalize_doi(F.col("doi")), "profile_id", "ordinal"))
    return keyed.join(known, ["profile_id", "_doi"], "left_anti").drop("_doi")


def without_known_urls(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Drop candidates whose identifier is a library URL; blank ones never match."""
    known = library.select("profile_id", empty_to_null(normalize_identifier(F.col("url"))).alias("_id")).where("_id IS NOT NULL").distinct()
    own = empty_to_null(normalize_identifier(F.col("identifier")))
    return candidates.withColumn("_id", never_null(own, "profile_id", "ordinal")).join(known, ["profile_id", "_id"], "left_anti").drop("_id")


def title_keys(titles: DataFrame, column: str = "title") -> DataFrame:
    """Distinct token keys. Copies of a title, however many, become one row here."""
    return titles.select(token_key(normalize_title(F.col(column))).alias("tkey")).where("tkey <> ''").distinct()


# token lengths from each of these on are a class of their own: its 64 marks, one per token by hash, cost at least that length and a blank each
_MARKS = (1, 3, 5, 8)


def _marks(token: Column, length: Column) -> list[Column]:
    """One number per class of token lengths with the token's bit, 0 in the other classes."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(token, F.lit(64)).cast("int"))
    ends = (*_MARKS[1:], None)
    return [F.when((length >= lo) & (F.lit(True) if hi is None else length < hi), bit).otherwise(F.lit(0).cast("long")) for lo, hi in zip(_MARKS, ends, strict=True)]


def _numbered(keys: DataFrame) -> DataFrame:
    """Distinct keys with a number, their length and their marks, so that tokens and pairs need not carry the titles."""
    zero = F.lit(0).cast("long")
    tokens = F.transform(F.split("tkey", " "), lambda t: F.struct(F.xxhash64(t).alias("token"), F.length(t).alias("size")))

    def held(i: int) -> Column:
        return F.aggregate("_tokens", zero, lambda acc, t: acc.bitwiseOR(_marks(t["token"], t["size"])[i])).alias(f"m{i}")

    rows = keys.select("tkey").distinct().select("tkey", F.monotonically_increasing_id().alias("id"), F.length("tkey").alias("length"), tokens.alias("_tokens"))
    return cut_lineage(rows.select("id", "tkey", "length", *[held(i) for i in range(len(_MARKS))]))


def _token_rows(numbered: DataFrame) -> DataFrame:
    """``id, token, size``: the token is a hash, equal hashes of different tokens only add candidates."""
    rows = numbered.select("id", F.explode(F.split("tkey", " ")).alias("_token"))
    return rows.select("id", F.xxhash64("_token").alias("token"), F.length("_token").alias("size"))


def _rare_prefix(titles: DataFrame, allowed: float) -> DataFrame:
    """The rarest tokens ``token, df`` of each numbered title whose length is more than may be missing from a match; ``by_df`` has all, in order."""
    bound = F.col("length") * F.lit(allowed) + F.lit(1e-9)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        longer = acc["used"] + x["size"] + 1
        return F.struct(longer.alias("used"), (acc["taken"] + (acc["used"] <= bound).cast("int")).alias("taken"))

    taken = F.aggregate("by_df", start, step, lambda acc: acc["taken"])
    own = ["id", "length", *[f"m{i}" for i in range(len(_MARKS))]]
    return titles.select(*own, F.explode(F.slice("by_df", F.lit(1), taken)).alias("x")).select(*own, "x.token", "x.df")


def _overlap_candidates(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """``left_id, right_id`` of numbered titles that may overlap; see ``overlapping_titles``."""
    r = 1.0 - threshold
    allowed = 2 * r / (1 + r)
    every = _token_rows(left) if right is None else _token_rows(left).union(_token_rows(right))
    frequency = cut_lineage(every.groupBy("token").agg(F.count("*").alias("df")))
    hot = cut_lineage(frequency.where(F.col("df") > HOT_ROWS).select("token", F.ceil(F.col("df") / HOT_ROWS).cast("long").alias("_parts")))
    # a token of many titles is cut into parts: its index rows are spread, its few probes are copied
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")

    def index(big: DataFrame) -> DataFrame:
        held = [F.col(f"m{i}").alias(f"n{i}") for i in range(len(_MARKS))]
        rows = big.select(F.col("id").alias("other"), F.col("length").alias("reach"), *held, F.explode(F.split("tkey", " ")).alias("_token"))
        rows = rows.withColumn("token", F.xxhash64("_token")).drop("_token").join(F.broadcast(hot), "token", "left")
        return rows.withColumn("part", F.pmod(F.xxhash64("other"), parts)).drop("_parts")

    def probe(small: DataFrame, big: DataFrame, a: str, b: str) -> DataFrame:
        counted = skew_join(_token_rows(small), frequency, ["token"], "inner", ["id"], hot=hot)
        counted = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token", "size"))).alias("by_df")).join(small.drop("tkey"), "id")
        copies = F.ceil(F.col("df") / HOT_ROWS).cast("long")
        prefix = _rare_prefix(counted, allowed).withColumn("part", F.explode(F.sequence(zero, copies - 1))).drop("df")
        # the match holds the rest of the title, so it cannot be much shorter, and it has the marks of all but what may be missing
        long_enough = F.col("reach") + 1 >= F.col("length") * F.lit(1 - allowed - 1e-9)
        missing = sum(
            (F.bit_count(F.col(f"m{i}").bitwiseAND(F.bitwise_not(F.col(f"n{i}")))) * F.lit(lo + 1) for i, lo in enumerate(_MARKS)), F.lit(0)
        )
        few_missing = missing <= F.col("length") * F.lit(allowed) + F.lit(1e-9)
        return prefix.join(index(big), ["token", "part"]).where(long_enough & few_missing).select(F.col("id").alias(a), F.col("other").alias(b))

    if right is None:
        return probe(left, left, "left_id", "right_id")
    return probe(left, right, "left_id", "right_id").unionByName(probe(right, left, "right_id", "left_id"))


def _with_titles(pairs: DataFrame, lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """Add ``left_key`` and ``right_key``. ``pairs`` is stored: it is counted first, as a title may have very many matches."""
    for side, other, titles in (("left", "right", lefts), ("right", "left", rights)):
        named = titles.select(F.col("id").alias(f"{side}_id"), F.col("tkey").alias(f"{side}_key"))
        pairs = skew_join(pairs, named, [f"{side}_id"], "inner", [f"{other}_id"])
    return pairs


def overlapping_titles(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.9) -> DataFrame:
    """Pairs ``(left_key, right_key)`` where one title (nearly) contains the other.

    Without ``right`` the titles are joined with themselves and a pair may come in one order only.

    If the common part alone reaches the threshold against a title, at most 2r/(1+r) of that
    title (r = 1 - threshold) is missing from the other one. So any run of its tokens longer
    than that shares a token with the match; the rarest tokens are taken. Titles meet as numbers with
    their length and a few marks of their tokens, and are read again for the pairs that may match.
    """
    lefts = _numbered(left)
    rights = lefts if right is None else _numbered(right)
    pairs = cut_lineage(_overlap_candidates(lefts, None if right is None else rights, threshold).distinct())
    named = _with_titles(pairs, lefts, rights)
    return named.where(overlap_ratio(F.col("left_key"), F.col("right_key")) >= threshold).select("left_key", "right_key")


_COUNT_ROWS, _TILE = 1024, (64, 2048)  # titles whose letters are counted at once; titles compared at once


def _letter_counts(titles: list[str], width: int, dtype: type) -> np.ndarray:
    out = np.empty((len(titles), width), dtype=dtype)
    for at in range(0, len(titles), _COUNT_ROWS):
        some = titles[at : at + _COUNT_ROWS]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32) % width
        rows = np.repeat(np.arange(len(some)), [len(t) for t in some])
        out[at : at + len(some)] = np.bincount(rows * width + codes, minlength=len(some) * width).reshape(len(some), width)
    return out


def _block_similar(threshold: float, ordered: bool):
    """Compare two blocks; the edit distance is at least the difference of the letter counts."""
    r = 1.0 - threshold + 1e-9

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list[int], list[int]] = ([], [])
        if left.num_rows and right.num_rows:
            a, b = left["left_key"].to_pylist(), right["right_key"].to_pylist()
            id_a, id_b = left["left_id"].to_pylist(), right["right_id"].to_pylist()
            len_a, len_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            # sums of two counts stay within the type
            kind = np.int16 if max(len_a.max(), len_b.max()) < 8000 else np.int32
            fine_a, fine_b = _letter_counts(a, 128, kind), _letter_counts(b, 128, kind)
            coarse_a = np.ascontiguousarray(fine_a.reshape(len(a), 8, 16).sum(axis=1, dtype=kind).T)
            coarse_b = np.ascontiguousarray(fine_b.reshape(len(b), 8, 16).sum(axis=1, dtype=kind).T)
            high, wide = _TILE
            for at in range(0, len(a), high):
                for to in range(0, len(b), wide):
                    limit = np.floor(r * (len_a[at : at + high, None] + len_b[None, to : to + wide])).astype(kind)
                    spread = np.zeros(limit.shape, dtype=kind)
                    for d in range(16):
                        gap = coarse_a[d, at : at + high, None] - coarse_b[d, None, to : to + wide]
                        spread += np.abs(gap, out=gap)
                    rows, cols = np.nonzero(spread <= limit)
                    if not len(rows):
                        continue
                    i, j = rows + at, cols + to
                    close = np.abs(fine_a[i] - fine_b[j]).sum(axis=1, dtype=np.int64) <= r * (len_a[i] + len_b[j])
                    for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
                        if ordered and a[x] >= b[y]:
                            continue
                        if token_set_ratio(a[x], b[y]) / 100.0 >= threshold:
                            found[0].append(id_a[x])
                            found[1].append(id_b[y])
        return pa.table({"left_id": pa.array(found[0], pa.int64()), "right_id": pa.array(found[1], pa.int64())})

    return fn


def near_equal_titles(left: DataFrame, right: DataFrame, threshold: float = 0.9, self_join: bool = False,
                      block_rows: int = TITLE_BLOCK) -> DataFrame:
    """Pairs ``(left_key, right_key)`` whose sorted strings are close in edit distance. With ``self_join`` each pair comes once."""
    lefts = _numbered(left)
    rights = lefts if self_join else _numbered(right)
    pairs = cut_lineage(_near_equal_pairs(lefts, rights, threshold, self_join, block_rows))
    return _with_titles(pairs, lefts, rights).select("left_key", "right_key")


def _near_equal_pairs(left: DataFrame, right: DataFrame, threshold: float, self_join: bool, block_rows: int = TITLE_BLOCK) -> DataFrame:
    """``left_id, right_id`` of numbered titles whose sorted strings are close in edit distance.

    Such titles differ in length by at most (1+r)/(1-r), so only the same or the next
    length band can match. Bands are cut into blocks of bounded size and block pairs are
    compared inside tasks; only matches leave them.
    """
    r = 1.0 - threshold
    step = math.log((1 + r) / (1 - r)) * (1 + 1e-9)

    def banded(titles: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        band = F.floor(F.log(F.length("tkey").cast("double")) / F.lit(step)).cast("int").alias("band")
        rows = titles.select(F.col("id").alias(f"{side}_id"), F.col("tkey").alias(f"{side}_key"), band)
        # bands grow with the logarithm of the title length: a few dozen rows
        blocks = F.greatest(F.count("*") / block_rows, F.sum(F.length(f"{side}_key")) / BLOCK_LETTERS)
        return rows, rows.groupBy("band").agg(F.ceil(blocks).cast("int").alias("subs"))

    rows_l, subs_l = banded(left, "left")
    rows_r, subs_r = banded(right, "right")

    def spread(rows: DataFrame, own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        names = [f"{side}_id", f"{side}_key"]
        other = other.select(F.col("band").alias("other_band"), F.col("subs").alias("other_subs"))
        reach = rows.join(own, "band").select(
            *names, "band", F.pmod(F.xxhash64(names[1]), F.col("subs")).cast("int").alias("sub"),
            F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other_band"),
        ).join(other, "other_band")
        mine, theirs = ("l", "r") if side == "left" else ("r", "l")
        return reach.select(
            *names, F.col("band").alias(f"{mine}_band"), F.col("sub").alias(f"{mine}_sub"),
            F.col("other_band").alias(f"{theirs}_band"),
            F.explode(F.sequence(F.lit(0), F.col("other_subs") - 1)).alias(f"{theirs}_sub"),
        ).select("l_band", "l_sub", "r_band", "r_sub", *names)

    key = ["l_band", "l_sub", "r_band", "r_sub"]
    spread_l = spread(rows_l, subs_l, subs_r, "left")
    spread_r = spread(rows_r, subs_r, subs_l, "right").toDF("lb", "ls", "rb", "rs", "right_id", "right_key")
    return spread_l.groupBy(*key).cogroup(spread_r.groupBy("lb", "ls", "rb", "rs")).applyInArrow(
        _block_similar(threshold, self_join), "left_id long, right_id long"
    )


def _similar_pairs(lefts: DataFrame, rights: DataFrame | None, threshold: float) -> DataFrame:
    """``left_id, right_id`` of numbered titles whose token-set ratio reaches the threshold; without ``rights`` in one order or both."""
    others = lefts if rights is None else rights
    maybe = _overlap_candidates(lefts, rights, threshold).withColumn("near", F.lit(False))
    near = _near_equal_pairs(lefts, others, threshold, rights is None).withColumn("near", F.lit(True))
    # few pairs pass, so a pair found through several tokens is tested once
    pairs = cut_lineage(maybe.unionByName(near).groupBy("left_id", "right_id").agg(F.max("near").alias("near")))
    overlap = overlap_ratio(F.col("left_key"), F.col("right_key")) >= threshold
    tested = _with_titles(pairs.where("NOT near"), lefts, others).where(overlap).select("left_id", "right_id")
    return cut_lineage(pairs.where("near").select("left_id", "right_id").union(tested))


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = 0.9) -> DataFrame:
    """All pairs of token keys whose token-set ratio reaches the threshold."""
    lefts, rights = _numbered(left), _numbered(right)
    return _with_titles(_similar_pairs(lefts, rights, threshold), lefts, rights).select("left_key", "right_key")


def without_known_titles(candidates: DataFrame, library: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Drop candidates whose title matches a title of the profile's library."""
    key = token_key(normalize_title(F.col("title")))
    # untitled candidates get a key of their own each
    keyed = cut_lineage(candidates.withColumn("_tkey", never_null(empty_to_null(key), "profile_id", "ordinal")))
    owned = cut_lineage(library.select("profile_id", key.alias("tkey")).where("tkey <> ''").distinct())
    offered = keyed.select(F.col("_tkey").alias("tkey")).where(~F.col("tkey").startswith("\0")).distinct()
    lefts, rights = _numbered(offered), _numbered(owned.select("tkey"))
    pairs = _similar_pairs(lefts, rights, threshold)
    owners = owned.join(rights.select(F.col("id").alias("right_id"), "tkey"), "tkey").select("profile_id", "right_id")
    # a title that many offered titles contain is cut into parts
    known = skew_join(pairs, owners, ["right_id"], "inner", ["left_id"]).select("profile_id", "left_id").distinct()
    known = known.join(lefts.select(F.col("id").alias("left_id"), F.col("tkey").alias("_tkey")), "left_id").drop("left_id")
    return keyed.join(known, ["profile_id", "_tkey"], "left_anti").drop("_tkey")


def _title_links(titles: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between numbered titles, both directions."""
    pairs = _similar_pairs(titles, None, threshold).where("left_id <> right_id")
    once = cut_lineage(pairs.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct())
    return once.union(once.select("b", "a"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep rows in order, component by component; entries come sorted by component, profile and ordinal."""
    component, row, own, hit = None, None, [], False
    taken: set[tuple[int, str]] = set()
    kept: list[tuple[int, int]] = []

    def settle() -> None:
        if row is not None and not hit:
            kept.append(row)
            taken.update((row[0], g) for g in own)

    for batch in batches:
        for part, profile, ordinal, group, is_own in zip(*(batch.column(c).to_pylist() for c in ("component", "profile_id", "ordinal", "grp", "own")), strict=True):
            if (profile, ordinal) != row or part != component:
                settle()
                if part != component:
                    component = part
                    taken.clear()
                row, own, hit = (profile, ordinal), [], False
            hit = hit or (profile, group) in taken
            if is_own:
                own.append(group)
        yield pa.record_batch({"profile_id": pa.array([k[0] for k in kept], pa.int64()), "ordinal": pa.array([k[1] for k in kept], pa.int64())})
        kept.clear()
    settle()
    yield pa.record_batch({"profile_id": pa.array([k[0] for k in kept], pa.int64()), "ordinal": pa.array([k[1] for k in kept], pa.int64())})


def _solve_small(entries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Split open entries by connected component: the kept rows of those with at most ``most`` entries, and the other entries.

    Rows of a component depend on nothing outside it, so one task can go through it in order.
    """
    node = F.xxhash64(F.lit("row"), "profile_id", "ordinal")
    edges = entries.select(node.alias("a"), F.xxhash64(F.lit("group"), "profile_id", "grp").alias("b"))
    label = components(edges)
    named = cut_lineage(entries.withColumn("node", node).join(label, "node").drop("node"))
    size = named.groupBy("component").agg(F.count("*").alias("entries"))
    large = cut_lineage(size.where(F.col("entries") > most).select("component"))
    small = named if large.isEmpty() else named.join(large, "component", "left_anti")
    order = ["component", "profile_id", "ordinal"]
    kept = small.repartition("component").sortWithinPartitions(*order).mapInArrow(_greedy, "profile_id long, ordinal long")
    return kept, named.join(large, "component", "left_semi").drop("component")


def first_of_batch(candidates: DataFrame, threshold: float = 0.9, fuzzy_titles: bool = True, rounds: int = ROUNDS,
                   component_entries: int = COMPONENT_ENTRIES) -> DataFrame:
    """Keep a row unless an earlier kept row shares its identifier, DOI or (similar) title.

    The result equals the loop in ``ordinal`` order. Rows meet in groups (one per identifier or DOI value, one per title
    key) and only the lowest ordinal of a group is passed on, so a group of any size makes no pairs. A round keeps every
    row that is the lowest in all of its groups and drops the later rows of these groups; the state is the table of
    entries of open rows, so the work of a round follows what is open. Copies settle in a round or two. Long chains, in
    which each row waits for the one before it, need a round per link: after some rounds, what still hangs together
    with at most ``component_entries`` entries is settled by one task in order, and only larger parts go on.
    """
    rows = candidates.select(
        F.col("profile_id").cast("long").alias("profile_id"), F.col("ordinal").cast("long").alias("ordinal"),
        normalize_identifier(F.col("identifier")).alias("_id"), normalize_doi(F.col("doi")).alias("_doi"),
        token_key(normalize_title(F.col("title"))).alias("_tkey"),
    )
    rows = cut_lineage(rows)
    row, group = ["profile_id", "ordinal"], ["profile_id", "grp"]
    if fuzzy_titles:
        titles = _numbered(rows.where("_tkey <> ''").select(F.col("_tkey").alias("tkey")))
        # from here on a title is its number; untitled rows get a key of their own each
        keyed = rows.withColumn("_tkey", never_null(empty_to_null(F.col("_tkey")), *row))
        numbers = titles.select(F.col("tkey").alias("_tkey"), "id")
        rows = cut_lineage(skew_join(keyed, numbers, ["_tkey"], "left", row).withColumn("_tkey", F.col("id").cast("string")).drop("id"))
    own = F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("k:"), F.col("_id")), F.concat(F.lit("k:"), F.col("_doi")),
        F.when(F.col("_tkey") != "", F.concat(F.lit("t:"), F.col("_tkey"))),
    )))
    watch = rows.select(*row, F.explode(own).alias("grp"), F.lit(True).alias("own"))
    if fuzzy_titles:
        links = _title_links(titles, threshold)
        titled = rows.where("_tkey IS NOT NULL").select(*row, F.col("_tkey").cast("long").alias("a"))
        near = skew_join(titled, links, ["a"], "inner", row).select(*row, F.concat(F.lit("t:"), F.col("b").cast("string")).alias("grp"), F.lit(False).alias("own"))
        watch = watch.unionByName(near)
    watch = cut_lineage(watch)
    # a group that only one row watches decides nothing; rows without any other group stay at once
    sizes = cut_lineage(watch.groupBy(*group).agg(F.count("*").alias("watchers")).where("watchers > 1"))
    hot = cut_lineage(sizes.where(F.col("watchers") > HOT_ROWS).select(*group, F.ceil(F.col("watchers") / HOT_ROWS).cast("long").alias("_parts")))
    even = hot.isEmpty()

    def with_group(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, group, how) if even else skew_join(left, right, group, how, ["ordinal"], hot=hot)

    open_ = cut_lineage(with_group(watch, sizes.select(*group), "inner"))
    kept = [rows.select(*row).join(open_.select(*row).distinct(), row, "left_anti")]
    done = 0
    while not open_.isEmpty():
        if done and done % rounds == 0:
            settled, open_ = _solve_small(open_, component_entries)
            kept.append(cut_lineage(settled))
            open_ = cut_lineage(open_)
            if open_.isEmpty():
                break
        lows = open_.where("own").groupBy(*group).agg(F.min("ordinal").alias("low"))
        # the lowest open row of all, at least, is the lowest of its groups
        first = with_group(open_, lows, "left").groupBy(*row).agg(F.min("low").alias("low")).where(F.col("low") == F.col("ordinal"))
        newly = cut_lineage(first.select(*row))
        taken = open_.where("own").join(newly, row, "left_semi").select(*group, F.col("ordinal").alias("by"))
        later = with_group(open_, taken, "inner").where(F.col("ordinal") > F.col("by")).select(*row)
        open_ = cut_lineage(open_.join(newly.union(later).distinct(), row, "left_anti"))
        kept.append(newly)
        done += 1
    return candidates.join(functools.reduce(DataFrame.union, kept), row, "left_semi")


def dedupe(candidates: DataFrame, library: DataFrame, threshold: float = 0.9) -> DataFrame:
    """All four steps. The survivors of each costly step are materialised once."""
    fresh = without_known_urls(without_known_dois(candidates, library), library)
    return first_of_batch(cut_lineage(without_known_titles(fresh, library, threshold)), threshold)
