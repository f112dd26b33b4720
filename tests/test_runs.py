"""Streaming forms, model services and the composite runs."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from litradar.models import services
from litradar.models.providers import EchoCompleter, HashingEmbedder, OverlapReranker, complete_prompts, rerank
from litradar.params import Clustering, WatchLimits, WatchSettings
from litradar.plans.profile import build_profile
from litradar.plans.rank import profile_clusters, rank_cold
from litradar.plans.watch import fan_out, watch
from litradar.sources import stores
from litradar.streaming.sync import first_sightings, fresh_works, score_feed, sync_library, sync_tombstones

AS_OF = "2024-02-01 00:00:00"
# providers of this file go to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def record(profile, key, version, title):
    return {"profile_id": profile, "key": key, "version": version, "data": {"key": key, "version": version, "itemType": "book", "title": title}}


def test_library_stream_survives_a_replay(spark, tmp_path):
    landing, gone = tmp_path / "landing", tmp_path / "gone"
    store, state = stores.library_store(spark, str(tmp_path / "lib")), stores.state_store(spark, str(tmp_path / "state"))
    land(landing, "1.json", [record(1, "a", 1, "a1"), record(1, "b", 2, "b1"), record(2, "a", 9, "x")])
    land(gone, "1.json", [{"profile_id": 1, "key": "b", "version": 5}])

    def run(checkpoint):
        sync_library(spark, str(landing), store, state, str(tmp_path / checkpoint)).awaitTermination()
        return {(r.profile_id, r.key, r.title) for r in store.current().collect()}

    assert run("cp") == {(1, "a", "a1"), (1, "b", "b1"), (2, "a", "x")}
    land(landing, "2.json", [record(1, "a", 3, "a2")])
    assert run("cp") == {(1, "a", "a2"), (1, "b", "b1"), (2, "a", "x")}
    # a lost checkpoint replays everything: same state, same marks
    assert run("cp2") == {(1, "a", "a2"), (1, "b", "b1"), (2, "a", "x")}
    sync_tombstones(spark, str(gone), store, str(tmp_path / "cp3")).awaitTermination()
    assert {(r.profile_id, r.key) for r in store.current().collect()} == {(1, "a"), (2, "a")}
    assert {(r.profile_id, r.value) for r in state.current().collect()} == {(1, "3"), (2, "9")}


def test_candidate_stream(spark, tmp_path):
    landing = tmp_path / "feed"
    schema = "profile_id long, ordinal long, doi string, score double, seen timestamp"
    land(landing, "1.json", [{"profile_id": 1, "ordinal": i, "doi": f"10/{i % 4}", "score": i / 10, "seen": "2024-01-01T00:00:00Z"} for i in range(8)])
    known = spark.createDataFrame([("10/3",)], "doi string")
    stream = spark.readStream.schema(schema).json(str(landing))
    once = first_sightings(fresh_works(stream, known, ["doi"]), "doi", "seen", 7)
    from litradar.operators.ranking import top_ranked

    score_feed(once, lambda batch: top_ranked(batch, 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and len({r.doi for r in rows}) == 2 and "10/3" not in {r.doi for r in rows}


def test_reranker_limit(spark):
    class Small(OverlapReranker):
        max_documents = 3

    docs = spark.createDataFrame([(1, i, "a b", f"a {'b' if i == 2 else 'c'}") for i in range(3)], "profile_id long, ordinal long, query string, document string")
    assert [r.ordinal for r in rerank(docs, Small(), 2).orderBy("rank").collect()] == [2, 0]
    with pytest.raises(Exception, match="exceed the reranker limit"):
        rerank(docs.union(docs.withColumn("ordinal", F.col("ordinal") + 10)), Small(), 2).collect()


class Failing(EchoCompleter):
    def complete(self, prompt, max_tokens=1024, temperature=0.3):
        if "boom" in prompt:
            raise RuntimeError("no answer")
        if "partial" in prompt:
            return '{"research_question": "only this", "background": "b"}', 3
        return super().complete(prompt)


def test_failed_calls_are_listed_not_fatal(spark):
    works = spark.createDataFrame([("1", "fine", "x", ["A"], "V"), ("2", "boom", "x", ["A"], "V"), ("3", "partial", "x", None, None)], "identifier string, title string, abstract string, authors array<string>, venue string")
    none = spark.createDataFrame([], "paper_id string")
    got = {r.paper_id: r for r in services.summarize(works, none, Failing(), AS_OF).collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "ok", "2": "failed", "3": "failed"}
    assert got["1"].bullets.methodology.startswith("methodology") and got["1"].tokens_used > 0
    errors = complete_prompts(spark.createDataFrame([(1, "boom")], "id long, prompt string"), Failing(), ["id"]).first()
    assert errors.answer is None and errors.error == "no answer"


def test_clusters_keep_a_name_when_the_call_fails(spark):
    clusters = spark.createDataFrame([(1, 0, 3, ["boom"], ["key"], None), (1, 1, 2, ["t" * 40], [], "聚类 1"), (1, 2, 1, ["x"], [], "done")],
                                     "profile_id long, cluster_id long, member_count long, titles array<string>, keywords array<string>, label string")
    got = {r.cluster_id: r.label for r in services.label_clusters(clusters, Failing()).collect()}
    assert got == {0: "key", 1: "t" * 30}


def test_profile_is_built_once_per_text(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(1, f"{i:03d}", f"paper on {words[i % 4]}", f"{words[i % 4]} " * 5 + f"w{i}" if i % 10 else "  ", "2024-01-01 00:00:00") for i in range(80)]
    items = spark.createDataFrame(rows, "profile_id long, key string, title string, abstract string, d string").withColumn("date_added", F.col("d").cast("timestamp"))
    tags = spark.createDataFrame([(f"{i:03d}", words[i % 4]) for i in range(80)], "key string, tag string")
    store = spark.createDataFrame([], stores.EMBEDDING)
    p = Clustering(min_clusters=2, iterations=5)
    out = build_profile(items, tags, store, HashingEmbedder(), AS_OF, p)
    assert out["library"].count() == 72 and out["new_embeddings"].count() == 72
    summary = out["summary"].first()
    assert summary.total_papers == 72 and summary.papers_in_valid_clusters == 72
    assert out["keywords"].where("rank = 1").count() == out["clusters"].count()
    again = build_profile(items, tags, out["new_embeddings"].withColumn("source_id", F.lit(None).cast("string")), HashingEmbedder(), AS_OF, p)
    assert again["new_embeddings"].count() == 0
    stored = out["new_embeddings"].withColumn("source_id", F.lit(None).cast("string"))
    assert build_profile(items, tags, stored, HashingEmbedder(), AS_OF, p, full=True)["new_embeddings"].count() == 72
    assert {tuple(r) for r in again["library"].select("key", "cluster_id").collect()} == {tuple(r) for r in out["library"].select("key", "cluster_id").collect()}


def world(spark, n=60, dim=8):
    rng = np.random.default_rng(3)
    vec = lambda: rng.normal(size=dim).astype(np.float32).tolist()
    library = spark.createDataFrame([(p, f"{p}-{i}", i % 3, vec(), "2024-01-20 00:00:00") for p in (1, 2) for i in range(20)], "profile_id long, key string, cluster_id long, embedding array<float>, d string")
    works = spark.createDataFrame(
        [(i, f"w{i}", "arxiv" if i % 3 else "crossref", f"{'Study' if i % 2 else 'Survey'} number {i:04d}x{i * 7919 % 1000}", "text" if i % 10 else None, f"10/{i // 2 if i < 10 else i}", vec(), "2024-01-30 00:00:00" if i % 4 else "2023-01-01 00:00:00")
         for i in range(n)], "ordinal long, identifier string, source string, title string, abstract string, doi string, embedding array<float>, p string")
    known = spark.createDataFrame([(1, "x", "10/20", None), (2, "y", None, "W30")], "profile_id long, title string, doi string, url string")
    follows = spark.createDataFrame([(1, "arxiv"), (1, "crossref"), (2, "arxiv"), (9, "arxiv")], "profile_id long, source string")
    issns = spark.createDataFrame([], "ordinal long, pos long, issn string")
    journals = spark.createDataFrame([], "issn string, impact_factor double, is_cn boolean")
    return library.withColumn("date_added", F.col("d").cast("timestamp")), works.withColumn("published", F.col("p").cast("timestamp")), known, follows, issns, journals


def test_watch(spark):
    library, works, known, follows, issns, journals = world(spark)
    s = WatchSettings(limits=WatchLimits(recent_days=7, max_preprint_ratio=0.9, top_k=5), title_threshold=0.97)
    out = watch(works, library, known, follows, profile_clusters(library, AS_OF), issns, journals, AS_OF, s)
    rows = out["recommendations"].collect()
    # profile 2 follows preprints only: with no other work above them none is admitted
    assert {r.profile_id for r in rows} == {1}
    assert all(r.abstract and r.published.year == 2024 for r in rows)
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert 20 not in {r.ordinal for r in rows}
    funnel = {(r.profile_id, r.stage): r.works for r in out["funnel"].collect()}
    assert funnel[1, "offered"] == 60 and funnel[1, "deduped"] == 60 - 5 - 1 and funnel[9, "offered"] == 40


def test_watch_serves_cold_profiles_fills_vectors_and_selects_by_interest(spark):
    library, works, known, follows, issns, journals = world(spark)
    follows = follows.union(spark.createDataFrame([(9, "crossref")], "profile_id long, source string"))
    works = works.withColumn("embedding", F.when(F.col("ordinal") % 7 != 5, F.col("embedding")))
    s = WatchSettings(limits=WatchLimits(recent_days=7, max_preprint_ratio=0.9, top_k=0), title_threshold=0.97)
    interests = spark.createDataFrame([(9, "survey of text", [])], "profile_id long, refined_query string, exclude_keywords array<string>")
    store = spark.createDataFrame([], stores.EMBEDDING)
    out = watch(works, library, known, follows, profile_clusters(library, AS_OF), issns, journals, AS_OF, s, store=store, embedder=HashingEmbedder(8), interests=interests, reranker=OverlapReranker())
    rows = out["recommendations"].collect()
    cold = [r for r in rows if r.profile_id == 9]
    assert cold and {(r.label, r.score) for r in cold} == {("consider", 0.0)}
    assert any(r.ordinal % 7 == 5 for r in rows if r.profile_id == 1)
    assert out["new_embeddings"].count() == 8
    assert {r.profile_id: r.mode for r in out["thresholds"].collect()} == {1: "dynamic", 2: "dynamic", 9: "random"}
    picked = out["interest"].collect()
    assert len(picked) == 5 and {r.profile_id for r in picked} == {9} and all("Survey" in r.title for r in picked)


def test_cold_profiles_are_shuffled_the_same_way(spark):
    library, works, _, follows, issns, journals = world(spark)
    offered = fan_out(works.select("ordinal", "identifier", "source"), follows)
    profiles = follows.select("profile_id").distinct()
    first = [r.ordinal for r in rank_cold(offered, profiles, library, issns, journals).orderBy("shuffle_key").collect()]
    second = [r.ordinal for r in rank_cold(offered.repartition(7), profiles, library, issns, journals).orderBy("shuffle_key").collect()]
    assert first == second and len(first) == 40 and first != sorted(first)
