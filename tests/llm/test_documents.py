"""Operators over documents: rows that break things, against plain versions."""

import os
import re

import edges
import numpy as np
import pandas as pd
import pytest
from checks import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litradar.llm import components, decontaminate, language, licenses, mixing, near_dedup, repeats, shingles, token_files, toxicity
from litradar.llm.catalog import ORACLE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def clean(value):
    if value is None or value is pd.NA or value != value:
        return None
    return value if isinstance(value, str) else int(value)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    edges.documents().to_parquet(path / "documents.parquet")
    edges.benchmark().to_parquet(path / "benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    frame = edges.documents()
    return [(clean(d), clean(t)) for d, t in zip(frame.doc_id, frame.text, strict=True)]


def told(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_values(spark, name):
    assert same(spark, QUERIES, ORACLE, name, SF) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    frame = QUERIES[name](spark, empty)
    assert frame.count() == 0
    assert len(frame.columns) >= 4


def test_near_groups(spark, folder, rows):
    assert told(QUERIES["op4_near_dedup"](spark, folder), "doc_id", "n_shingles", "component_id", "kept") == sorted(edges.near_groups(rows), key=repr)


def test_near_groups_of_a_family_in_tiles(spark, monkeypatch):
    """A hub with many variants that are mostly not linked with each other, cut into many tiles."""
    monkeypatch.setattr(near_dedup, "TILE", 16)
    base = edges.prose(20, 120)
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        spots = set(r.choice(120, size=int(r.integers(0, 5)), replace=False).tolist())
        rows.append((1000 - i, " ".join(w + f"q{i}" if k in spots else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(edges.near_groups(rows), key=repr)


def test_odd_sketches_bound_the_differences():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, size=400).astype(np.uint64)
    for change in (0, 5, 20, 60):
        other = base.copy()
        other[:change] = r.integers(0, 2**63, size=change).astype(np.uint64)
        samples = near_dedup.minhashes([np.unique(base), np.unique(other)])
        differing = int((samples[0] != samples[1]).sum())
        odd = near_dedup.odd_sketches(samples)
        bits = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        assert bits <= 2 * differing and bits % 2 == 0 and bits >= 1.2 * differing
        assert (change > 20) or differing <= near_dedup.MOST_DIFFERING


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBc \n\t.é", max_size=60), max_size=8))
def test_shingle_sets_are_as_large_as_sets_of_words(texts):
    got = [len(s) for s in shingles.shingle_sets([t.encode() for t in texts])]
    want = [n for _, n, *_ in edges.near_groups([(i, t) for i, t in enumerate(texts)])]
    assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    got = dict(told(components.components(spark.createDataFrame([*chain, *star, (3, 3)], "a long, b long")), "node", "component"))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(200, 260))}}


def test_benchmark_hits(spark, folder, rows):
    frame = QUERIES["op7_benchmark_decontamination"](spark, folder)
    items = [(i, clean(t)) for i, t in zip(edges.benchmark().item_id, edges.benchmark().text, strict=True)]
    assert told(frame, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(edges.hits(rows, items), key=repr)


def test_benchmark_hits_of_a_shuffled_join(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    want = told(decontaminate.contamination(docs, items), *columns)
    assert any(r[-1] for r in want)
    assert told(decontaminate.contamination(docs, items, broadcast_rows=0), *columns) == want


def test_shuffled_places_carry_no_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z y x"), (3, "b c d a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "a b c d e f g h i j"), ("q", "y x"), ("r", None)], "item_id string, text string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plans, cut = [], decontaminate.cut_lineage
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda f: plans.append((f.columns, f._jdf.queryExecution().explainString(mode))) or cut(f))
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 1)
    monkeypatch.setattr(decontaminate, "small_side", lambda side: side)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = decontaminate.contamination(docs, items, broadcast_rows=0)
        assert told(found, "doc_id", "n_hit") == [(1, 10), (2, 2), (3, 10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    [met] = [plan for columns, plan in plans if "_at" in columns]
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", met)
    places = [columns for columns in shuffled if "pos#" in columns]
    assert places and not any("words#" in columns for columns in shuffled)


def test_benchmark_plan_has_no_python(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_licenses(spark, folder):
    body = licenses.TEXTS[0][1].split("\n")[1].replace("sublicense", "sub-license").upper().split(". ")
    other = "\n".join(["* MIT Licence *", "", "Copyright (c) 2020 Somebody", "All rights reserved.", "", *body])
    rows = [(1, other), (2, "text\nReleased under THE mit licence!\nmore"), (3, None), (4, ""), (2, "text\nReleased under THE mit licence!\nmore"), (None, "x"), (5, "Licensed under CC BY-NC 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = told(licenses.scan_licenses(docs, licenses.known_digests(spark)), "doc_id", "license", "notices", "n_notice_lines", "has_license")
    assert got == sorted([(1, "MIT", [], 0, True), (2, None, ["MIT"], 1, True), (2, None, ["MIT"], 1, True), (3, None, [], 0, False), (4, None, [], 0, False), (None, None, [], 0, False), (5, "CC-BY-NC-4.0", [], 0, True)], key=repr)
    assert QUERIES["op8_license_scan"](spark, folder).where("notices = 'MIT'").count() == 1
    none = licenses.scan_licenses(docs, licenses.known_digests(spark).limit(0))
    assert none.where("has_license").count() == 0


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>
"""
GIVEN = "/usr/share/common-licenses"


def test_usual_license_texts_are_known(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {"Unlicense": UNLICENSE} | {i: open(f"{GIVEN}/{f}").read() for i, f in files.items() if os.path.exists(f"{GIVEN}/{f}")}
    notices = {"AGPL-3.0": "x\nReleased under the GNU Affero General Public License v3.", "CC-BY-4.0": "x\nSPDX-License-Identifier: CC-BY-4.0"}
    docs = spark.createDataFrame([*((i, t.upper()) for i, t in texts.items()), *notices.items()], "doc_id string, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert {i: got[i][0] for i in texts} == {i: i for i in texts}
    assert {i: got[i] for i in notices} == {i: (None, [i]) for i in notices}


def test_repeats(spark, folder, rows, monkeypatch):
    want = sorted(edges.without_repeats(rows), key=repr)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert told(QUERIES["op9_suffix_dedup"](spark, folder), *columns) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert told(repeats.remove_repeats(docs, hot=1), *columns) == want
    monkeypatch.setattr(repeats, "SAMPLE_SHARE", 1)
    assert told(repeats.remove_repeats(docs, hot=2), *columns) == want


def test_repeats_of_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    r = np.random.default_rng(5)
    part = bytes(r.integers(97, 101, size=150).astype(np.uint8)).decode()
    rows = [(i, bytes(r.integers(97, 101, size=int(r.integers(0, 90))).astype(np.uint8)).decode() + part[: int(r.integers(20, 150))] + "é" * (i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = told(repeats.remove_repeats(docs, width=30, gram=8), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(edges.without_repeats(rows, 30), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), min_size=1, max_size=20))
def test_merged_intervals(spans):
    begin, end = np.array([b for b, _ in spans]), np.array([b + n for b, n in spans])
    got = {i for b, e in zip(*repeats.merged(begin, end), strict=True) for i in range(b, e)}
    assert got == {i for b, n in spans for i in range(b, b + n)}


def test_token_files(spark, folder, rows):
    import zlib

    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    frame = QUERIES["op2_repair_tokens"](spark, folder)
    got = frame.orderBy("start").collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()] and ends[-1] == start
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in rows if d is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=3000), st.integers(0, 3000), st.integers(0, 300), st.integers(1, 40))
def test_grammar_round_trip(ids, start, n, times):
    ids = np.array(ids * times, dtype=np.uint32)
    symbols, left, right = token_files.compress(ids, 10)
    assert np.array_equal(token_files.expand(symbols, left, right, 10), ids)
    lengths = token_files.rule_lengths(left, right, 10)
    start, n = min(start, len(ids)), min(n, max(len(ids) - start, 0))
    if n:
        assert np.array_equal(token_files.decode_range(symbols, left, right, lengths, 10, start, n), ids[start : start + n])
    # no symbol reaches over the end of a text: the end id is only ever the last of what a rule expands to
    for r in range(len(left)):
        whole = token_files.expand(np.array([10 + r]), left, right, 10).tolist()
        assert 1 not in whole[:-1]


def test_pairs_of_pairs_do_not_cross_ends():
    symbols, left, right = token_files.compress(np.array([5, 1] * 400, dtype=np.uint32), 100)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(5, 1)] and symbols.tolist() == [100] * 400


def test_single_documents_are_read(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = [(i % 40, " ".join(edges.prose(i, 5 + i))) for i in range(60)] + [(100, None), (None, "no id")]
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"{tmp_path}/t", tokenizer_path(), block_ids=500)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = spark.createDataFrame([(3,), (39,), (100,), (7,), (7,), (999,), (None,)], "doc_id long")
    got = sorted((r.doc_id, list(r.ids)) for r in token_files.read_documents(spark, f"{tmp_path}/t", wanted).collect())
    assert got == sorted((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs if d in (3, 39, 100, 7))


def test_long_words_hash_as_short_ones():
    """One sum for words of any length; case does not matter."""
    words = [b"aB" * 40, b"Ab" * 40, b"x" * 65, b"x" * 64, b"x" * 64 + b"y", b"q" * 3_000_000]
    hashes, bounds = shingles.word_hashes(words)
    assert bounds.tolist() == list(range(len(words) + 1))
    plain = []
    for w in words[:-1]:
        h = 0
        for b in w.lower():
            h = (h * int(shingles._BASE) + int(shingles._BYTE[b])) & 0xFFFFFFFFFFFFFFFF
        plain.append(int(shingles.mix64(np.array([h], dtype=np.uint64))[0]))
    assert hashes[:-1].tolist() == plain and plain[0] == plain[1] and len(set(plain)) == 4


TRICKY = [
    "don't I'LL 'sabc !'s '' 's 've've", "12½ x×y ÷ ŉ ǅ ß ẞ ﬁ é Å İstanbul ΣΑΣ ª º", "<|endoftext|> a<|endoftext|>b <|startoftext|", "a\x1cb c​d\xa0e",
    "", "  ", "漢字かな العربية ไทย 😀👍🏽", "ab1c22,;d" + "x" * 700, "x" * 200 + " " + "y" * 499,
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TRICKY), st.text(alphabet="abÉé'1½,.!<|> \ńßsΣ", max_size=30), st.text(max_size=20)), max_size=4))
def test_encoder_equals_the_tokenizer(texts):
    encode = token_files.encoder(tokenizer_path())
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode.encode(texts) == want


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 5)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
    encode = token_files.Encoder(tokenizer_path())
    for at in range(0, 60, 20):
        texts = [" ".join(edges.LONG[at : at + 20]), "it's " + " ".join(edges.PASSAGE[at : at + 20])]
        assert encode.encode(texts) == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]


def test_grammar_makes_real_text_smaller():
    encode = token_files.encoder(tokenizer_path())
    data = np.frombuffer(encode.encode([" ".join(edges.LONG * 20)])[0], dtype="<u2")
    symbols, left, _ = token_files.compress(data, encode.size)
    assert len(symbols) + 2 * len(left) < 0.5 * len(data)


def test_language(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    edge = {(r.doc_id, r.lang_pred, r.score) for r in QUERIES["op1_language_id"](spark, folder).collect() if r.doc_id in (0, 1, 2, 14) or r.doc_id is None}
    assert {(d, s) for d, x, s in edge if x == "und"} == {(0, 0.0), (1, 0.0), (2, 0.0), (14, 0.0), (None, 0.0)}
    none = language.identify(docs, language.train(docs.where("false")), ["doc_id"])
    assert {tuple(r) for r in none.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    alone = language.identify(docs, language.train(docs.where("lang = 'de'")), ["doc_id"])
    assert {r[0] for r in alone.select("lang_pred").distinct().collect()} == {"de"}


def test_presence_counts_n_grams():
    texts = ["", "a", "Ab 1 c", "é"]
    grams = [{(" " + t + " ")[i : i + n] for n in range(1, 5) for i in range(len(t) + 3 - n)} for t in ("", "a", "ab c")]
    assert language.presence(texts)[0].sum() == 1  # one gap
    assert [int(x) for x in language.presence(texts)[1:3].sum(axis=1)] == [len(g) for g in grams[1:]]


def test_toxicity_finds_held_out_rows(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    names = ["low_quality", "toxic"]
    models = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), list(zip(names, ["1 - quality", "toxic"], strict=True)))
    got = toxicity.score(docs, models, names).join(labels, "doc_id").where("doc_id % 3 = 0")
    n = {tuple(r[:2]): r[2] for r in got.groupBy("toxic", "flagged").count().collect()}
    assert n[(1, True)] > 0.7 * (n[(1, True)] + n[(1, False)])
    assert n.get((0, True), 0) < 0.01 * n[(0, False)]
    assert models[1].earlier.shape == (1,)
    nothing = toxicity.score(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), models, names)
    assert {r.flagged for r in nothing.collect()} == {False}
    unlabelled = toxicity.train(docs, labels.limit(0), list(zip(names, ["1 - quality", "toxic"], strict=True)))
    assert toxicity.score(docs, unlabelled, names).where("flagged").count() == 0


def test_mixture_edges(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    everything = mixing.mixture(docs, levels, {}, F.expr("tokens * 5"), 1, 3)
    total = docs.select(F.sum(mixing.token_count(F.col("text")))).first()[0]
    assert everything.agg(F.sum("n_taken")).first()[0] == 3 * total
    some = mixing.mixture(docs, levels, {"lang": {"en": 3}}, F.expr("tokens div 2"), 1, 1)
    taken = some.agg(F.sum("n_taken")).first()[0]
    assert total // 2 - 10 <= taken <= total // 2
    assert some.where("n_taken > n_tokens or epoch <> 1").count() == 0
    assert mixing.mixture(docs, levels, {}, F.lit(0), 1, 1).count() == 0


def test_deal_gives_shortages_to_siblings(spark):
    rows = [("p", "a", 10, 1, 100), ("p", "b", 1000, 1, 100), ("p", "c", 1000, 2, 100), ("q", "a", 5, 9, 100), ("q", "b", 5, 1, 100)]
    frame = spark.createDataFrame(rows, "parent string, node string, cap long, weight long, budget long")
    got = {(r.parent, r.node): r.budget for r in mixing.deal(frame, ["parent"]).collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("q", "a"): 5, ("q", "b"): 5}
