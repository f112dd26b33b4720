"""What is shuffled, sorted and computed again must not grow faster than the input; told from the plans."""

import re

import pytest
from pyspark.sql import functions as F

from litradar.operators import extraction, joins, kmeans
from litradar.sources import sinks

AS_OF = "2024-02-01 00:00:00"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanged(frame):
    """Columns that enter an exchange."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = frame._jdf.queryExecution().explainString(mode)
    return [part.split("\n")[1] for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0] and "\n" in part]


def test_rounds_do_not_shuffle_the_items(spark):
    """F12 F14: profile_rebuild, profile_build."""
    library = spark.createDataFrame([(1, f"k{i}", [float(i % 7) + 1, float(i % 3), 1.0]) for i in range(60)], "profile_id long, key string, embedding array<float>")
    tries = spark.createDataFrame([(1, 2), (1, 3)], "profile_id long, k long")
    sliced = kmeans._Sliced(library, tries, 42, 16)
    inputs = exchanged(sliced._parts(sliced.centroids, "owners", "profile_id long, k long, key string, cluster_id long"))
    assert inputs and not any("embedding#" in line for line in inputs)
    sliced.close()
    whole = {(r.key, r.cluster_id) for r in kmeans.fit_assign(library, tries.where("k = 3")).collect()}
    cut = {(r.key, r.cluster_id) for r in kmeans.fit_assign(library, tries.where("k = 3"), block_rows=16).collect()}
    assert whole == cut and len(cut) == 60
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("litradar_slices_")]


def test_known_texts_are_not_shuffled(spark):
    """profile_rebuild asks for missing texts when none is."""
    texts = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B"), (None, "N"), (None, "M")], "content_hash string, text string")
    store = spark.createDataFrame([(h, "m", None) for h in ("a", "x")], "content_hash string, model string, expires_at timestamp")
    found = joins.embedding_misses(texts, store, "m", AS_OF)
    assert {tuple(r) for r in found.select("content_hash", "text").collect()} == {("b", "B"), (None, "M")}
    assert found.columns == ["content_hash", "text"]
    known = joins.embedding_misses(texts.where("content_hash IS NOT NULL"), store.union(spark.createDataFrame([("b", "m", None)], store.schema)), "m", AS_OF)
    assert known.count() == 0 and "BroadcastHashJoin" in plan_of(known) and "SortMergeJoin" not in plan_of(known)


def test_feeds_are_sorted_before_they_are_rendered(spark):
    """written_feeds."""
    works = spark.createDataFrame([(1, 2, "T2"), (1, 1, "T1"), (None, 1, "T3")], "profile_id long, rank long, title string")
    for name in ("url", "identifier", "source", "venue", "doi", "abstract", "label"):
        works = works.withColumn(name, F.lit("x\ny"))
    works = works.withColumn("published", F.lit(AS_OF).cast("timestamp")).withColumn("authors", F.array(F.lit("A"))).withColumn("score", F.lit(0.5))
    lines = sinks.feed_lines(works, AS_OF, "t", "l", "a")
    plan = plan_of(lines)
    assert "<item>" in plan and plan.rindex("<item>") < plan.index("Sort [")
    got = [(r.profile_id, re.sub("<item><title>(T.).*", r"\1", r.value)[:9]) for r in lines.collect()]
    assert sorted(got, key=lambda x: x[0] or 0) == [(None, "<?xml ver"), (None, "T3"), (None, "</channel"), (1, "<?xml ver"), (1, "T1"), (1, "T2"), (1, "</channel")]


@pytest.mark.parametrize("ask", [extraction.model_requests, lambda e: extraction.as_store_rows(e.withColumns({"doi": F.lit("d"), "title": F.lit("t")}), AS_OF)])
def test_rules_run_once_for_a_page(spark, ask):
    """page_requests. The test of the abstract stays above the projection that makes it."""
    pages = spark.createDataFrame([("http://x.org", "<p>no</p>"), (None, None)], "url string, html string")
    asked = ask(extraction.extract_abstracts(pages))
    filters = [line for line in plan_of(asked).split("\n") if re.search(r"\bFilter \(", line)]
    assert filters and not any("pythonUDF" in line or "regexp" in line or "<" in line for line in filters)
    assert asked.count() in (0, 2)


def test_kept_pieces_are_numbers(monkeypatch):
    """op2_repair_tokens: pieces of plain texts are kept by their hashes, not as one string and one bytes object each."""
    import numpy as np

    from litradar.llm import token_files
    from litradar.llm.catalog import tokenizer_path

    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{a}" for i in range(3000)) for a in "xyx"] + ["", " \n", "AÉb, 12"]
    encoder = token_files.Encoder(tokenizer_path())
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode([t])[0] for t in texts] == want and encoder.encode(texts) == want
    assert not encoder.pieces and not encoder.words and len(encoder.hashes) >= 6000
    monkeypatch.setattr(token_files, "KEPT_HASHES", 5)
    assert encoder.encode(texts) == want and encoder.encode(texts[1:]) == want[1:]


def test_pieces_are_encoded_as_arrays():
    """op2_repair_tokens: new pieces come as one array of ids, and each different symbol of a block is opened once."""
    import numpy as np

    from litradar.llm import token_files
    from litradar.llm.catalog import tokenizer_path

    encoder = token_files.Encoder(tokenizer_path())
    pieces = [f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(450)] + ["'s", "a b", "q"]  # two words are not one piece
    ids, many = encoder._piece_ids(pieces)
    want = [e.ids for e in encoder.tokenizer.encode_batch(pieces, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and many.tolist() == [len(w) for w in want]
    assert [len(x) for x in encoder._piece_ids([])] == [0, 0]
    block = np.array([5, 6, 7, 8, 1] * 400 + [9, 5, 6, 1], dtype="<u2")
    symbols, left, right = token_files.compress(block, 20)
    assert len(symbols) < 500 and token_files.expand(symbols, left, right, 20).tolist() == block.tolist()
    assert token_files.expand(symbols[:0], left, right, 20).tolist() == []
