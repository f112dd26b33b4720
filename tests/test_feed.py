"""The deduped feed over triggers, and sources with broken records."""

import gzip

import pytest
from pyspark.sql import functions as F

from litradar.operators.dedupe import dedupe
from litradar.sources.checked import article_source, preprint_source, read_checked
from litradar.streaming.feed import watch_feed

WORK = "profile_id long, ordinal long, identifier string, doi string, title string, published timestamp"
LIBRARY = "profile_id long, title string, doi string, url string"
WORKS = [
    (0, 0, "a1", "10.1/a", "a first title of some length"), (0, 1, "b1", None, "known title"), (0, 2, "c1", None, "another work"), (1, 0, "a1", "10.1/a", "a first title of some length"),
    (0, 10, "A1 ", None, "unlike all others"), (0, 11, "x", "10.1/A", "not seen before"), (0, 12, "10.1/a", None, "crossed over"), (0, 13, "y", "c1", "crossed back"),
    (0, 14, "z", None, "a first title of some lengthy"), (0, 15, "new", None, "fresh"), (1, 11, "c1", None, "another work"), (0, 16, "new", "10.9/q", "fresh again"),
]


@pytest.fixture
def feed(spark, tmp_path):
    library = spark.createDataFrame([(0, "known title", None, None)], LIBRARY)
    landing = f"{tmp_path}/landing"

    def land(rows, day):
        frame = spark.createDataFrame([(*r, None) for r in rows], WORK).withColumn("published", F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp"))
        frame.write.mode("append").parquet(landing)

    def run(score=lambda kept: kept, **kw):
        stream = spark.readStream.schema(WORK).parquet(landing)
        watch_feed(stream, library, score, f"{tmp_path}/feed", f"{tmp_path}/checkpoint", **kw).awaitTermination()

    def output():
        return sorted((r.profile_id, r.ordinal) for r in spark.read.parquet(f"{tmp_path}/feed/output").collect())

    return land, run, output, library


def test_two_triggers_equal_one_batch(spark, feed):
    land, run, output, library = feed
    land([r for r in WORKS if r[1] < 10], 1)
    run()
    assert output() == [(0, 0), (0, 2), (1, 0)]
    land([r for r in WORKS if r[1] >= 10], 2)

    def fails(kept):
        kept.count()
        raise RuntimeError("the scorer is down")

    with pytest.raises(Exception, match="scorer is down"):
        run(fails)
    # the trigger is run again from the checkpoint, and a third time as if its end had not been noted
    run()
    want = sorted((r.profile_id, r.ordinal) for r in dedupe(spark.createDataFrame([(*r, None) for r in WORKS], WORK), library).collect())
    assert output() == want == [(0, 0), (0, 2), (0, 15), (1, 0), (1, 11)]


def test_a_replayed_trigger_does_not_meet_its_own_output(spark, feed, tmp_path):
    land, run, output, _ = feed
    land([r for r in WORKS if r[1] < 10], 1)
    run()
    land([r for r in WORKS if r[1] >= 10], 2)
    run()
    before = output()
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".1.crc"):
        crc.unlink()
    run()
    assert output() == before


def test_seen_works_expire(feed):
    land, run, output, _ = feed
    land([(0, 0, "a", None, "one title")], 1)
    run(ttl_days=7)
    land([(0, 1, "a", None, "one title")], 6)
    run(ttl_days=7)
    land([(0, 2, "a", None, "one title")], 20)
    run(ttl_days=7)
    assert output() == [(0, 0), (0, 2)]


def test_broken_records_and_files(spark, tmp_path):
    (tmp_path / "articles").mkdir()
    good = '{"message":{"items":[{"DOI":"10.1/%s","title":["Title %s"],"URL":"u"}]}}'
    (tmp_path / "articles" / "a.json").write_text("\n".join([good % (1, "one"), good[:40], "", good % (2, "two"), '{"message": 5}']))
    whole = gzip.compress("\n".join(good % (100 + i, f"three {i}") for i in range(2000)).encode())
    (tmp_path / "articles" / "b.json.gz").write_bytes(b"this is no archive" + whole[:50])
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "f.xml").write_text(
        "<?xml version='1.0'?><feed xmlns:arxiv='x'><entry><id>i1</id><title>one</title><arxiv:primary_category term='cs.DB'/></entry><entry><id>i2</id><title>a & b</title></entry>"
        "<entry>\n<id>i3</id><title>three &amp; more</title><link href='h' rel='alternate'/></entry></feed>")
    got = read_checked(spark, [preprint_source(), article_source(multi_line=False), article_source("gone")],
                       {"arxiv": f"{tmp_path}/feed", "crossref": f"{tmp_path}/articles", "gone": f"{tmp_path}/nowhere"})
    works = sorted((r.source, r.identifier, r.title, r.primary_category, r.url) for r in got.works.collect())
    assert works == [("arxiv", "i1", "one", "cs.DB", None), ("arxiv", "i3", "three & more", None, "h"), ("crossref", "10.1/1", "Title one", None, "u"), ("crossref", "10.1/2", "Title two", None, "u")]
    aside = got.quarantine.collect()
    assert sorted((r.source, r.record[:20]) for r in aside) == sorted([("arxiv", "<entry><id>i2</id><t"), ("crossref", good[:20]), ("crossref", '{"message": 5}')])
    assert all(r.file.endswith(("f.xml", "a.json")) for r in aside)
    report = {r.source: tuple(r)[1:] for r in got.report.collect()}
    assert report == {"arxiv": ("damaged", 1, 0, 2, 1), "crossref": ("damaged", 2, 1, 2, 2), "gone": ("failed", 0, 0, 0, 0)}


def test_no_source_at_all(spark):
    got = read_checked(spark, [article_source()], {})
    assert got.works is None and got.report.count() == 0 and got.quarantine.count() == 0
