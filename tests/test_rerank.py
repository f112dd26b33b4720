"""More documents of a profile than a reranker takes in one request."""

import duckdb
import pytest
from compare import rows_of

from litradar.catalog import ORACLE, QUERIES
from litradar.models.providers import OverlapReranker, rerank

SCHEMA = "profile_id long, ordinal long, query string, document string"


def test_a_large_profile_has_several_requests(spark):
    """reranked_works."""
    class Small(OverlapReranker):
        max_documents = 3

        def rerank(self, query, documents):
            assert len(documents) <= self.max_documents
            return super().rerank(query, documents)

    rows = [(1, i, "a b", "a b" if i == 39 else f"a {i}") for i in range(40)] + [(2, 0, "a b", "a c"), (2, 1, "x", "x"), (None, 0, "a b", "a b")]
    # rows that are equal, too, are dealt over requests
    rows += [(3, 5, "a b", "b")] * 10
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.profile_id, r["rank"]): (r.ordinal, round(r.rerank_score, 6)) for r in rerank(docs, Small(), 2, split=True).collect()}
    assert got == {(1, 1): (39, 1.0), (1, 2): (0, 0.5), (2, 1): (1, 1.0), (2, 2): (0, 0.5), (3, 1): (5, 0.707107), (3, 2): (5, 0.707107)}
    with pytest.raises(Exception, match="40 documents exceed the reranker limit"):
        rerank(docs.where("profile_id = 1"), Small(), 2).collect()


def test_reranked_works_asks_about_all_documents(spark, tmp_path):
    """reranked_works."""
    texts = {10: "aa bb cc d e f g h i", 20: "aa", 1099: "cc, bb aa"}
    talks = [(3 + 40 * i, 0, "user", texts.get(i, "none")) for i in range(1100)] + [(4, 0, "user", "aa"), (44, 1, "user", "other"), (50, 0, "user", "nobody asks")]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(3, "aa bb cc"), (4, "AA")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = con.execute(ORACLE["reranked_works"])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    frame = QUERIES["reranked_works"](spark, str(tmp_path))
    assert rows_of(frame.columns, frame.collect()) == want
    # two equal scores that differ in the last bit keep the order of their ordinals
    assert [r.ordinal for r in frame.where("profile_id = 3").orderBy("rank").limit(3).collect()] == [(3 + 40 * i) * 100 for i in (1099, 10, 20)]
