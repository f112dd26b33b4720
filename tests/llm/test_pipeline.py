"""The pipeline against a plain version of each stage, on a table with rows that break things."""

import edges
import numpy as np
import pytest

import corpus_pipeline as P
from litradar.llm import language, mixing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    edges.documents().to_parquet(path / "documents.parquet")
    edges.benchmark().to_parquet(path / "benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda f: [(r.doc_id, r.text) for r in f.select("doc_id", "text").collect()]
    first = P.by_language(spark, docs, folder)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    want = []
    for d, t in pairs(docs):
        if t and any(c.isalpha() for c in t):
            best = float(language.scores(model, [t]).max())
            want += [(d, t)] if (best + 1) / 2 >= P.LEAST_SCORE else []
    assert first.columns == docs.columns and sorted(pairs(first), key=repr) == sorted(want, key=repr)

    second = P.one_of_each_group(spark, docs, folder)
    rows = pairs(docs)
    kept = {(d, t) for (d, t), g in zip(rows, edges.near_groups(rows), strict=True) if g[3]}
    assert second.columns == docs.columns and sorted(pairs(second), key=repr) == sorted(kept, key=repr)

    third = P.without_benchmark(spark, docs, folder)
    items = [(i, t if isinstance(t, str) else None) for i, t in zip(edges.benchmark().item_id, edges.benchmark().text, strict=True)]
    clean = [r for r, h in zip(rows, edges.hits(rows, items), strict=True) if not h[5]]
    assert third.columns == docs.columns and sorted(pairs(third), key=repr) == sorted(clean, key=repr)

    fourth = P.to_weights(spark, second, folder)
    assert fourth.columns == docs.columns
    chosen = pairs(fourth)
    count = lambda f: f.select(F.sum(mixing.token_count(F.col("text")))).first()[0]
    assert set(chosen) < kept and len(chosen) == len(set(chosen)) and count(fourth) >= count(second) * P.MIX_PERCENT // 100 - 10


def test_run(spark, folder):
    from tokenizers import Tokenizer

    from litradar.llm.catalog import tokenizer_path

    got = P.run(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = dict(zip(edges.documents().doc_id, edges.documents().text, strict=True))
    assert got and len({r.doc_id for r in got}) == len(got)
    for r in got:
        if r.doc_id is not None:
            assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
