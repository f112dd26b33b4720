"""Stores, readers and writers on files."""

import json

from pyspark.sql import functions as F

from litradar.plans.ingest import sync
from litradar.sources import readers, sinks, stores

AS_OF = "2024-02-01 00:00:00"


def library(spark, rows):
    return spark.createDataFrame(rows, "profile_id long, key string, version long, title string")


def test_log_store_keeps_the_last_version(spark, tmp_path):
    store = stores.library_store(spark, str(tmp_path / "library"))
    first = library(spark, [(1, "a", 1, "a1"), (1, "b", 1, "b1"), (2, "a", 1, "other")])
    store.append(first)
    store.append(library(spark, [(1, "a", 2, "a2")]))
    store.append(first)  # a replay
    store.append(library(spark, [(1, "b", 3, None)]), deleted=True)
    assert {(r.profile_id, r.key, r.title) for r in store.current().collect()} == {(1, "a", "a2"), (2, "a", "other")}
    store.append(library(spark, [(1, "b", 4, "back")]))
    compacted = store.compact(str(tmp_path / "compacted"))
    assert {(r.profile_id, r.key, r.title) for r in compacted.log().collect()} == {(1, "a", "a2"), (2, "a", "other"), (1, "b", "back")}


def test_embedding_store_prunes_by_model(spark, tmp_path):
    store = stores.embedding_store(spark, str(tmp_path / "embedding"))
    rows = spark.createDataFrame([("h1", "m1", [1.0]), ("h1", "m2", [2.0])], "content_hash string, model string, embedding array<float>")
    store.append(stores.with_expiry(rows, "2024-01-01 00:00:00", 7))
    store.append(stores.with_expiry(rows.where("model = 'm1'").withColumn("embedding", F.array(F.lit(3.0).cast("float"))), AS_OF, None))
    assert {(r.model, r.embedding[0]) for r in store.current().collect()} == {("m1", 3.0), ("m2", 2.0)}
    assert [r.model for r in stores.live(store.current(), AS_OF).collect()] == ["m1"]
    assert [r.model for r in stores.expired(store.current(), AS_OF).collect()] == ["m2"]
    plan = store.log().where("model = 'm2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_merge_ties_go_to_the_new_row(spark):
    old, new = library(spark, [(1, "a", 5, "old"), (1, "b", 9, "newer")]), library(spark, [(1, "a", 5, "new"), (1, "b", 8, "late")])
    got = stores.merge(old, new, ["profile_id", "key"], ["version"])
    assert {(r.key, r.title) for r in got.collect()} == {("a", "new"), ("b", "newer")}


def test_sync_uses_the_old_mark_for_tombstones(spark):
    frame = lambda rows: spark.createDataFrame(rows, "profile_id long, key string, version long, content_hash string")
    current = frame([(1, "a", 10, "x"), (1, "b", 10, "y"), (1, "c", 10, "z")])
    incoming = frame([(1, "a", 20, "x2"), (1, "d", 5, "stale"), (1, "e", 20, "n")])
    gone = frame([(1, "b", 15, None), (1, "c", 9, None), (1, "e", 12, None)])
    out = sync(current, incoming, gone)
    assert {(r.key, r.version) for r in out["library"].collect()} == {("a", 20), ("c", 10), ("e", 20)}
    assert out["stats"].collect()[0].asDict() == {"profile_id": 1, "fetched": 2, "updated": 2, "removed": 2, "high_water": 20}
    assert {(r.key, r.status) for r in out["changes"].collect()} == {("a", "changed"), ("b", "gone"), ("c", "same"), ("e", "new")}
    again = sync(out["library"], incoming, gone)
    assert again["stats"].collect()[0].fetched == 0


ITEM = {"key": "K1", "version": 7, "data": {"itemType": "journalArticle", "title": "T", "abstractNote": "A", "creators": [{"firstName": "Ann", "lastName": "B"}, {"lastName": "C"}, {}],
        "tags": [{"tag": "x"}, {"tag": " hidden"}], "collections": ["c1"], "date": "2021-05-03", "DOI": "10.1/X", "dateAdded": "2024-01-15T10:30:00Z", "proceedingsTitle": "Proc"}}


def test_library_pages(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps([ITEM, {"key": "N", "data": {"itemType": "note"}}, {"key": "E", "version": 3, "data": {}}]))
    rows = {r.key: r for r in readers.read_library_pages(spark, str(tmp_path), ["hidden"]).collect()}
    assert set(rows) == {"K1", "E"}
    k = rows["K1"]
    assert (k.version, k.creators, k.tags, k.year, k.venue, str(k.date_added)) == (7, ["Ann B", "C"], ["x"], 2021, "Proc", "2024-01-15 10:30:00")
    assert rows["E"].title == "" and rows["E"].version == 3 and rows["E"].creators == []


def test_article_pages(spark, tmp_path):
    item = {"DOI": "10.2/A", "title": [" A title "], "author": [{"given": "X", "family": "Y"}, {}], "abstract": "<jats:p>Hi &amp; bye</jats:p>", "container-title": ["J"],
            "created": {"date-time": "2024-01-10T00:00:00Z"}, "URL": "http://u", "type": "journal-article", "is-referenced-by-count": 4, "ISSN": ["1-1"]}
    page = {"message": {"total-results": 3, "items": [item, {"title": ["Masthead"]}, {"title": []}, {"title": ["J"], "container-title": ["j"]}, {"title": ["No link"]}]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = readers.read_article_pages(spark, str(tmp_path)).collect()
    assert [(r.identifier, r.title, r.abstract, r.authors, r.venue, r.metrics["is-referenced-by"]) for r in rows] == [
        ("10.2/A", "A title", "Hi & bye", ["X Y"], "J", 4.0), ("unknown", "No link", None, [], None, 0.0)]


FEED = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
<entry><id>http://a/1</id><title> One
 line </title><summary> S </summary><published>2024-01-10T00:00:00Z</published><author><name>P</name></author><author><name>Q</name></author>
<link href="http://a/1v1" rel="alternate" type="text/html"/><link title="pdf" href="http://a/1.pdf" rel="related"/><arxiv:doi>10.3/x</arxiv:doi><arxiv:primary_category term="cs.AI"/></entry>
<entry><id>http://a/2</id><title>Two</title><arxiv:primary_category term="math.CO"/></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    rows = readers.read_preprint_feed(spark, str(tmp_path), ["cs.AI"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.identifier, r.abstract, r.authors, r.doi, r.url, r.primary_category, str(r.published)) == (
        "http://a/1", "S", ["P", "Q"], "10.3/x", "http://a/1v1", "cs.AI", "2024-01-10 00:00:00")
    assert readers.read_preprint_feed(spark, str(tmp_path)).count() == 2


def test_journal_file(spark, tmp_path):
    (tmp_path / "j.csv").write_text('issn,title,category,impact_factor\n1-1,"A, B",X,6.60\n2-2,C,Y (CN),NA\n,blank,Z,1\n3-3,D,Z,\n')
    got = {r.issn: (r.title, r.impact_factor, r.is_cn) for r in readers.read_journals(spark, str(tmp_path)).collect()}
    assert got == {"1-1": ("A, B", 6.6, False), "2-2": ("C", None, True), "3-3": ("D", None, False)}


def test_registry_skips_a_missing_source(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    registry = readers.default_registry()
    merged, failed = registry.read(spark, {"arxiv": str(tmp_path / "f.xml"), "crossref": str(tmp_path / "nowhere")})
    assert failed == ["crossref"] and merged.count() == 2


def test_feed_documents(spark, tmp_path):
    import xml.etree.ElementTree as ET

    works = spark.createDataFrame(
        [(1, 1, "T <1>", "http://u", "id1", ["A & B", "C"], "arxiv", "V", "10/1", "abs", 0.5, "consider"), (1, 2, "T2", "", "id2", [], "crossref", None, None, None, 0.4, "ignore")],
        "profile_id long, rank long, title string, url string, identifier string, authors array<string>, source string, venue string, doi string, abstract string, score double, label string",
    ).withColumn("published", F.lit("2024-01-10 00:00:00").cast("timestamp"))
    sinks.write_feeds(works, str(tmp_path / "feeds"), AS_OF, title="My feed")
    document = spark.read.text(str(tmp_path / "feeds"), wholetext=True).first().value
    channel = ET.fromstring(document.strip()).find("channel")
    items = channel.findall("item")
    dc = "{http://purl.org/dc/elements/1.1/}"
    assert channel.findtext("title") == "My feed" and channel.findtext("lastBuildDate") == "Thu, 01 Feb 2024 00:00:00 +0000"
    assert [i.findtext("title") for i in items] == ["T <1>", "T2"]
    assert [e.text for e in items[0].findall(dc + "creator")] == ["A & B", "C"]
    assert items[0].findtext(dc + "type") == "preprint" and items[1].find("link") is None and items[1].find(dc + "type") is None


def test_note_payload_and_report(spark, tmp_path):
    works = spark.createDataFrame([(1, 0, 0.12345, "must_read")], "profile_id long, ordinal long, score double, label string").withColumn("published", F.lit(AS_OF).cast("timestamp"))
    note = json.loads(sinks.note_payload(works, "C9", "tagged").first().payload)
    assert note == {"itemType": "note", "note": "Recommended due to score 0.123", "tags": [{"tag": "tagged"}, {"tag": "must_read"}], "collections": ["C9"]}
    sinks.write_report({"works": sinks.report_works(works, "Asia/Shanghai")}, str(tmp_path / "report"))
    assert str(spark.read.parquet(str(tmp_path / "report/works")).first().published_local) == "2024-02-01 08:00:00"


def test_checkpoint_folder_is_the_one_of_the_session(spark):
    from litradar.session import ensure_checkpoint_dir

    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
