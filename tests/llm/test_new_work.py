"""Periodic runs, shards and hard negatives against plain versions."""

import hashlib
import re
import zlib

import edges
import numpy as np
import pandas as pd
import pytest
from checks import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litradar.llm import negatives, runs, shards
from litradar.llm.catalog import ORACLE, QUERIES, SHARDS


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(24, 3 * q) and not any(words[s : e - p] == words[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def found_runs(words):
    codes = np.array([sorted(set(words)).index(w) for w in words], dtype=np.int64)
    return runs.runs_of(codes, np.array([0, len(words)]))[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.tuples(st.integers(0, 200), st.integers(1, 40), st.integers(1, 120)), max_size=4), st.integers(0, 200))
def test_runs_equal_every_lag(seed, planted, n):
    words = [seed[i * i % len(seed)] if seed else 0 for i in range(n)]
    for a, p, m in planted:
        for i in range(a, min(a + m, n)):
            words[i] = words[a + (i - a) % p]
    assert found_runs(words) == plain_runs(words)


def test_long_periods_and_long_texts():
    r = np.random.default_rng(5)
    words = r.integers(0, 40, 60_000)
    words[10_000:40_000] = np.tile(words[10_000:19_000], 4)[:30_000]
    words[19_500:19_600] = words[19_500]  # a short run inside, which the long period does not repeat as a whole
    got = runs.runs_of(words, np.array([0, len(words)]))[0]
    assert (19_500, 100, 1) in got or any(s <= 19_500 and q == 1 for s, _, q in got)
    for s, m, q in got:
        assert m >= max(24, 3 * q) and (words[s : s + m - q] == words[s + q : s + m]).all()
    alike = np.zeros(200_000, dtype=np.int64)
    assert runs.runs_of(alike, np.array([0, len(alike)]))[0] == [(0, 200_000, 1)]
    period = np.tile(r.integers(0, 9, 15_000), 3)
    assert runs.runs_of(period, np.array([0, 45_000]))[0][0] == (0, 45_000, 15_000)


def test_hashes_that_agree_by_chance_change_nothing(monkeypatch):
    words = [*"ab" * 20, *"abcabdabe" * 9, *"xy" * 30]
    want = plain_runs(words)
    monkeypatch.setattr(runs, "mix64", lambda x: x * np.uint64(0))
    assert found_runs(words) == want


def test_rare_words_split_until_nothing_changes():
    # x is frequent as a whole, but rare in the parts that the other rare words leave
    words = [*"abcabcabc", "r1", *"xabc" * 7, "r2", *"abx", "r3", *"aab" * 9]
    codes = np.array([sorted(set(words)).index(w) for w in words], dtype=np.int64)
    parts = runs.split_by_rarity(codes, np.zeros(len(codes), dtype=np.int64))
    assert [words[a:b] for a, b in parts] == [[*"xabc" * 7], [*"aab" * 9]]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def run_row(doc_id, text):
    words = planted(doc_id, text)
    own = found_runs(words) if len(words) > 400 else plain_runs(words)
    best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(own), *four, digest("".join(f"{s},{m},{q}\n" for s, m, q in own)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def clean(value):
    return None if value is None or value is pd.NA or value != value else value if isinstance(value, str) else int(value)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("new-work")
    edges.documents().to_parquet(path / "documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    frame = edges.documents()
    return [(clean(d), clean(t)) for d, t in zip(frame.doc_id, frame.text, strict=True)]


def test_periodic_runs_of_odd_rows(spark, folder, rows):
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted((run_row(*r) for r in rows), key=repr)
    assert any(r[1] for r in got)


def test_periods_are_planted_as_asked(spark):
    texts = [(i, " ".join(edges.prose(i, 1 + i % 90))) for i in range(300)]
    from litradar.llm.catalog import with_planted_runs

    frame = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("t"))
    changed = 0
    for r in frame.collect():
        assert r.t.split() == planted(r.doc_id, texts[r.doc_id][1])
        changed += r.t != texts[r.doc_id][1]
    assert changed > 10


def test_runs_keep_clashing_columns_apart(spark):
    frame = spark.createDataFrame([(1, "a b " * 20, 5, 6, 7)], "n_chars int, text string, row int, runs int, n_words int")
    got = runs.periodic_runs(frame.withColumnRenamed("text", "body"), "body", ("n_chars",)).first()
    assert (got.n_chars, got.n_words, [tuple(x) for x in got.runs], got.collapsed) == (1, 40, [(0, 40, 2)], "a b")


# shards


def test_shards_of_odd_rows(spark, folder, rows):
    got = QUERIES["op12_rendezvous_shards"](spark, folder).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    for shard in range(SHARDS):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    where = {}
    for r in got:
        assert where.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, SHARDS) and r.law == "key"


def test_a_new_shard_takes_its_share_and_weights_count(spark):
    ids = spark.range(30_000)
    weights = [1.0, 2.0, 3.0, 2.0]
    placed = ids.select(shards.shard_of(F.col("id"), weights[:3]).alias("a"), shards.shard_of(F.col("id"), weights).alias("b"))
    moved = {(r.a, r.b): r["count"] for r in placed.groupBy("a", "b").count().collect()}
    assert all(b in (a, 3) for a, b in moved)
    for s, w in enumerate(weights):
        n = sum(c for (_, b), c in moved.items() if b == s)
        assert abs(n - 30_000 * w / 8) < 400


def test_pieces_and_hot_keys_leave_slots_gapless(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i % 50}", i, i) for i in range(3000)] + [(7, "same", 0, 0)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int").repartition(5)
    shards.write_shards(docs, f"{tmp_path}/x", [1.0] * 3, piece_bytes=2_000, hot_rows=100)
    got = shards.read_shards(spark, f"{tmp_path}/x").select("record.*", F.col("shard").alias("s"), F.col("slot").alias("n")).collect()
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in got) == sorted(rows)
    assert len({r.s for r in got if r.doc_id == 7}) == 1
    for s in range(3):
        assert sorted(r.n for r in got if r.s == s) == list(range(sum(r.s == s for r in got)))
    pieces = spark.read.parquet(f"{tmp_path}/x/rows").groupBy("shard", "piece", "part").count().collect()
    assert max(r["count"] for r in pieces) < 400 and len(pieces) > 30


def test_shard_plan_has_no_python(spark, folder):
    frame = QUERIES["op12_rendezvous_shards"](spark, folder)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


# hard negatives


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = np.random.default_rng(8)
    rows = [(i, int(r.integers(0, 4)), (r.normal(size=6) + 0.7).astype(np.float32).tolist()) for i in range(500)]
    rows += [(i, 2, rows[3][2]) for i in range(1000, 1100)]  # ties
    rows += [(0, *rows[0][1:]), (701, None, [1.0] * 6), (702, 1, None), (703, 1, [1.0, None] + [0.0] * 4), (750, 1, [float("nan")] * 6), (800, 1, [float("inf")] + [0.0] * 5)]
    rows += [(None, 1, [1.0] * 6), (850, 1, [0.0] * 6), (900, 3, [-0.0] * 6), (950, 77, [1.0] * 6), (51, 2, [])]
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame([(i, v, c, 1, 2) for i, c, v in rows], "vec_id long, embedding array<float>, label int, side int, score int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


def plain_negatives(rows):
    used = {(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(int(np.floor(256 * float(x))) for x in v))
            for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, c, v in used:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, d) for i, d, w in used if i != a]
        for p, i, _ in sorted(x for x in scored if x[2] == c)[:5]:
            fits = sorted(x for x in scored if x[2] != c and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(a, i, rank + 1, j, -p, -n) for rank, (n, j, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_GROUP", 5)
    monkeypatch.setattr(negatives, "SLICE_ROWS", 60)
    monkeypatch.setattr(negatives, "BATCH", 16)
    monkeypatch.setattr(negatives, "TILE", 3)
    path, rows = vectors
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, path).collect())
    assert got == plain_negatives(rows)


def test_hard_negatives_equal_sql_form(spark):
    assert same(spark, QUERIES, ORACLE, "op13_hard_negatives", "/root/testdata/sf0.001") is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600), st.integers(1, 30), st.integers(0, 10**6))
def test_residue_products_are_exact(width, bits, seed):
    r = np.random.default_rng(seed)
    a, b = (r.integers(-(2**bits), 2**bits, (7, width), endpoint=True) // (1 if bits < 25 else 64) for _ in range(2))
    bound = float(max((np.abs(x).astype(float) ** 2).sum(axis=1).max() for x in (a, b)))
    primes = negatives.primes_for(bound * (1 + 1e-9) + 1)
    held = [negatives.residues(x.astype(np.float64), primes) for x in (a, b)]
    assert (negatives.products(*held, primes) == a @ b.T).all()


def test_large_components_are_exact_or_an_error(spark):
    big = float(2**20)
    frame = spark.createDataFrame([(0, 0, [big, 1.0]), (1, 0, [big, 3.0]), (2, 1, [big * 0.75, 1.0 + 2**-8]), (3, 1, [1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    s = lambda x, y: sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True))
    a = [big, 1.0]
    assert [tuple(r) for r in negatives.hard_negatives(frame, every=50).collect()] == [(0, 1, 1, 2, s(a, [big, 3.0]), s(a, [big * 0.75, 1.0 + 2**-8]))]
    huge = spark.createDataFrame([(0, 0, [1e200]), (1, 0, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(huge)
