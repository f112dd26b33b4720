"""Batch dedupe against the loop it stands for."""

import random

from litradar.functions.titles import token_set_ratio
from litradar.operators.dedupe import dedupe, first_of_batch, without_known_dois, without_known_urls

SCHEMA = "profile_id long, ordinal long, identifier string, doi string, title string"
LIBRARY = "profile_id long, title string, doi string, url string"


def greedy(rows, threshold=0.9):
    seen, titles, kept = set(), [], []
    for _, ordinal, identifier, doi, title in sorted(rows, key=lambda r: r[1]):
        key, doi, title = identifier.lower().strip(), (doi or "").lower().strip(), " ".join(title.lower().split())
        if (doi and doi in seen) or key in seen:
            continue
        if any(t and token_set_ratio(title, t) / 100 >= threshold for t in titles):
            continue
        kept.append(ordinal)
        titles.append(title)
        seen |= {key} | ({doi} if doi else set())
    return kept


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for i in range(n):
        tokens = rng.sample(words, rng.randint(0, 4))
        if tokens and rng.random() < 0.3:
            tokens[0] = tokens[0][:-1] + "x"
        rows.append((0, i, rng.choice(["A", "b", "c "]) + str(rng.randint(0, n)), rng.choice([None, "", f"10.{rng.randint(0, n)}", f"a{rng.randint(0, n)}"]),
                     " ".join(tokens) + (f" w{rng.randint(0, 30)}" if rng.random() < 0.8 else "")))
    return rows


def test_equals_the_loop(spark):
    for seed in range(4):
        rows = random_rows(seed, 60)
        got = sorted(r.ordinal for r in first_of_batch(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == greedy(rows), seed


def test_profiles_are_apart_and_copies_are_cheap(spark):
    rows = [(p, i, f"id{i}", None, "one and the same title") for p in (1, 2) for i in range(2000)]
    got = first_of_batch(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.profile_id, r.ordinal) for r in got) == [(1, 0), (2, 0)]


def test_chain_keeps_both_ends(spark):
    # b looks like a and like c, but a and c do not look alike: b falls, c stays
    a, b, c = "abcdefghijklmnopqrst", "abcdefghijklmnopqrSS".lower(), "abcdefghijklmnopxxss"
    assert token_set_ratio(a, b) >= 90 and token_set_ratio(b, c) >= 90 > token_set_ratio(a, c)
    rows = [(0, i, f"id{i}", None, t) for i, t in enumerate((a, b, c))]
    assert sorted(r.ordinal for r in first_of_batch(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 2]


def test_identifier_and_doi_share_one_set(spark):
    rows = [(0, 0, "10.1/X", None, "first"), (0, 1, "other", " 10.1/x", "second")]
    assert [r.ordinal for r in first_of_batch(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_against_library(spark):
    library = spark.createDataFrame([(0, "known title", "10.1/A ", "http://X/1"), (1, "", None, "")], LIBRARY)
    works = spark.createDataFrame(
        [(0, 0, "n0", "10.1/a", "t zero"), (0, 1, "HTTP://x/1 ", None, "t one"), (0, 2, "n2", "https://doi.org/10.1/a", "t two"), (0, 3, "n3", "", "a known title"),
         (1, 0, "n0", "10.1/a", "t zero"), (1, 1, "", None, "")], SCHEMA)
    assert {(r.profile_id, r.ordinal) for r in without_known_dois(works, library).collect()} == {(0, 1), (0, 2), (0, 3), (1, 0), (1, 1)}
    assert {(r.profile_id, r.ordinal) for r in without_known_urls(works, library).collect()} == {(0, 0), (0, 2), (0, 3), (1, 0), (1, 1)}
    assert {(r.profile_id, r.ordinal) for r in dedupe(works, library).collect()} == {(0, 2), (1, 0), (1, 1)}


def test_partitions_do_not_matter(spark):
    rows = random_rows(9, 80)
    frame = spark.createDataFrame(rows, SCHEMA)
    results = {tuple(sorted(r.ordinal for r in first_of_batch(frame.repartition(n)).collect())) for n in (1, 8, 40)}
    assert len(results) == 1


def chain(n):
    """Each row shares a value with the next one only."""
    return [(0, i, f"c{i}", f"c{i + 1}", "") for i in range(n)]


def test_long_chain_is_settled_without_a_round_per_link(spark):
    rows = chain(10_000) + [(1, 2 * i, f"d{i}", None, "") for i in range(50)] + [(1, 2 * i + 1, f"x{i}", f"D{i}", "") for i in range(50)]
    got = first_of_batch(spark.createDataFrame(rows, SCHEMA), fuzzy_titles=False).collect()
    assert sorted((r.profile_id, r.ordinal) for r in got) == [(0, i) for i in range(0, 10_000, 2)] + [(1, 2 * i) for i in range(50)]


def test_rounds_and_parts_agree(spark):
    rows = random_rows(4, 40) + [(0, 100 + o, *x) for _, o, *x in chain(9)]
    got = sorted(r.ordinal for r in first_of_batch(spark.createDataFrame(rows, SCHEMA), rounds=2, component_entries=12).collect())
    assert got == greedy(rows)
