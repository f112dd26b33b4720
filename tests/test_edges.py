"""Hand-made rows for the awkward cases."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from litradar.functions import answers, clock, feed, scoring, text
from litradar.operators import filters, joins, stats
from litradar.operators.extraction import extract_abstracts, with_answers
from litradar.functions.pages import LEAD_DESCRIPTION, LEAD_SECTION, shrink_page

AS_OF = "2024-02-01 12:30:00"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_weights(spark):
    rows = [(None,), ("2025-01-01 00:00:00",), ("2024-02-01 12:30:00",), ("2023-08-05 12:30:00",), ("2023-02-06 12:30:00",), ("1996-01-01 00:00:00",)]
    added = F.col("d").cast("timestamp")
    got = values(spark, rows, "d string", scoring.temporal_weight(added, AS_OF), clock.age_days(added, AS_OF))
    assert [g[0] for g in got] == pytest.approx([1.0, 1.0, 1.0, 0.5, 0.25, 0.05])
    assert [g[1] for g in got[:5]] == [0.0, 0.0, 0.0, 180.0, 360.0]


def test_dates(spark):
    rows = [("2024-01-15T10:30:00Z",), ("2024-01-15T10:30:00+08:00",), ("2024-01-15",), ("20240115",), ("2024-01-15T10",), ("15 Jan 2024",), ("2024",), ("",), (None,)]
    got = [g[0] for g in values(spark, rows, "d string", clock.parse_date(F.col("d")))]
    d = datetime
    assert got == [d(2024, 1, 15, 10, 30), d(2024, 1, 15, 2, 30), d(2024, 1, 15), d(2024, 1, 15), d(2024, 1, 15, 10), None, None, None, None]


def test_years_and_quarters(spark):
    rows = [("2024-03-15",), ("03/2024",), ("12-05-2024",), ("2024-13-01",), ("2024-xx",), ("2024",), ("",), (None,), ("c. 2020-2021",)]
    got = values(spark, rows, "d string", clock.year_of(F.col("d")), clock.quarter_key(F.lit(2024), F.col("d")))
    assert [g[0] for g in got] == [2024, None, 12, 2024, 2024, 2024, None, None, 2021]
    assert [g[1] for g in got] == ["2024-Q1", "2024-Q1", "2024-Q2", "2024-Q5", "2024-Q1", "2024-Q1", "2024-Q1", "2024-Q1", "2024-Q674"]


def test_hashes(spark):
    rows = [("a", "", "b"), ("a", "b", ""), ("ab", "", ""), ("", "a", "b"), ("a", None, "b")]
    got = [g[0] for g in values(spark, rows, "x string, y string, z string", text.content_hash(F.col("x"), F.col("y"), F.col("z")))]
    assert got == [hashlib.sha256(b).hexdigest() for b in (b"a\0b", b"a\0b", b"ab", b"\0a\0b", b"a\0b")]


def test_html(spark):
    rows = [("a &lt;b&gt;x&lt;/b&gt; c",), ("<p>",), ("",), (None,), ("A&amp;B   C",), ("&eacute;&#x4e2d;",)]
    assert [g[0] for g in values(spark, rows, "h string", text.clean_html(F.col("h")))] == ["a x c", None, None, None, "A&B C", "é中"]


def test_non_articles(spark):
    bad = ["Table of Contents", "MASTHEAD", "editorial board", "Errata", "erratum", "Corrections", "retraction", "Connect. Support. Inspire.", "IEEE Information for Authors",
           "Publication Information", "Author Guidelines", "Instructions for Authors", "Guide for authors: X", "IEEE Transactions on Robotics", "IEEE Journal of Oceanic Engineering",
           "Proceedings of the IEEE", "IEEE Signal Processing Magazine", "", None, " Nature "]
    good = ["Correction of errors", "IEEE Transactions on Robotics 2024", "A table of contents", "Natural"]
    got = [g[0] for g in values(spark, [(t, "nature") for t in bad + good], "t string, v string", text.is_non_article(F.col("t"), F.col("v")))]
    assert got == [True] * len(bad) + [False] * len(good)


def test_tags_keep_their_form(spark):
    rows = [([" private ", "x ", "", None, " ", "private"],)]
    assert values(spark, rows, "t array<string>", text.keep_tags(F.col("t"), ["private", " "]))[0][0] == ["x ", " "]


def test_abstract_rules_differ(spark):
    frame = spark.createDataFrame([(" ",), ("x",), ("",), (None,)], "abstract string")
    assert [r.abstract for r in filters.with_library_abstract(frame).collect()] == ["x"]
    assert sorted(r.abstract for r in filters.with_candidate_abstract(frame).collect()) == [" ", "x"]


def test_recency_boundary(spark):
    frame = spark.createDataFrame([("2024-01-25 00:00:00",), ("2024-01-24 23:59:59",), (None,)], "p string").select(F.col("p").cast("timestamp").alias("published"))
    assert filters.recent(frame, AS_OF, 7).count() == 1
    assert filters.recent(frame, AS_OF, 0).count() == 3


def test_exclusions(spark):
    works = spark.createDataFrame([(1, 0, "Deep Nets", None), (1, 1, "Soil", "uses NETS"), (2, 2, "Deep Nets", ""), (3, 3, "Deep Nets", "")], "profile_id long, ordinal long, title string, abstract string")
    interests = spark.createDataFrame([(1, ["nets"]), (2, [])], "profile_id long, exclude_keywords array<string>")
    assert sorted(r.ordinal for r in filters.without_excluded(works, interests).collect()) == [2, 3]


def test_journal_scores(spark):
    journals = spark.createDataFrame([("cn", None, True), ("na", None, False), ("a", 24.0, False), ("b", 1.0, False)], "issn string, impact_factor double, is_cn boolean")
    cases = {0: ("crossref", ["cn", "a"]), 1: ("crossref", ["na", "b", "a"]), 2: ("crossref", ["zz"]), 3: ("crossref", []), 4: ("arxiv", ["a"]), 5: ("ArXiv", ["a"])}
    works = spark.createDataFrame([(o, s) for o, (s, _) in cases.items()], "ordinal long, source string")
    issns = spark.createDataFrame([(o, i, x) for o, (_, xs) in cases.items() for i, x in enumerate(xs)], "ordinal long, pos long, issn string")
    got = {r.ordinal: (round(r.journal_score, 4), r.impact_factor, r.is_cn_core) for r in joins.journal_scores(works, issns, journals).collect()}
    assert got == {0: (0.7, None, True), 1: (round(0.6931 / 3.2189, 4), 1.0, False), 2: (0.3, None, False), 3: (0.3, None, False), 4: (0.6, None, False), 5: (1.0, 24.0, False)}


def test_enrichment_counts(spark):
    works = spark.createDataFrame([(0, "own", "10/a"), (1, None, "10/A"), (2, "", "10/b"), (3, None, None), (4, None, ""), (5, None, "10/c"), (6, " ", "10/a")], "ordinal long, abstract string, doi string")
    cached = spark.createDataFrame([("10/A", "cached"), ("10/b", "old"), ("10/c", "")], "doi string, abstract string")
    fresh = spark.createDataFrame([("10/B", "fresh")], "doi string, abstract string")
    filled = joins.fill_abstracts(works, cached, fresh)
    assert [(r.ordinal, r.abstract, r.abstract_from) for r in filled.orderBy("ordinal").collect()] == [
        (0, "own", "own"), (1, "cached", "cache"), (2, "fresh", "fresh"), (3, None, None), (4, None, None), (5, None, None), (6, " ", "own")]
    s = stats.enrichment_stats(filled).first()
    assert (s.total_candidates, s.with_abstract, s.missing_abstracts, s.skipped_no_doi, s.cache_hits, s.fetched, s.enriched, s.failed) == (7, 2, 3, 2, 1, 1, 2, 1)


def test_durations(spark):
    cases = {1: ("2024-01-01", "2024-01-01", "1天"), 2: ("2024-01-05", "2024-02-03", "30天"), 3: ("2024-01-15", "2024-03-10", "1月24天"), 4: ("2020-05-31", "2024-03-01", "3年9月"),
             5: ("2023-12-31", "2024-03-01", "2月-1天"), 6: ("2023-01-01", "2024-01-01", "1年0月")}
    rows = [(p, d) for p, (a, b, _) in cases.items() for d in (a, b)] + [(7, None)]
    frame = spark.createDataFrame(rows, "profile_id long, d string").select("profile_id", F.col("d").cast("timestamp").alias("date_added"))
    got = {r.profile_id: r.duration for r in stats.collection_duration(frame).collect()}
    assert got == {**{p: c[2] for p, c in cases.items()}, 7: None}


def test_answers(spark):
    rows = [('{"domains": [{"domain": "a", "paper_count": 2, "sample_titles": ["1","2","3","4"]}, {}]}',), ('```json\n{"domains": []}\n```',), ("```\nbroken",), ("",)]
    got = [g[0] for g in values(spark, rows, "a string", answers.domains(F.col("a")))]
    assert [[tuple(x) for x in g] for g in got] == [[("a", 2, ["1", "2", "3"]), ("未命名", 0, [])], [], [], []]
    rows = [('["\'a\'", "b"]',), ('```json\n["a","b"]\n```',), ('["a"]',), ("1. first\n- second\n3. third",), ("",), ('["a", ""]',)]
    got = [g[0] for g in values(spark, rows, "a string", answers.cluster_labels(F.col("a"), F.lit(2)))]
    assert got == [["a", "b"], ["a", "b"], ['["a"]', "聚类 2"], ["first", "second"], ["聚类 1", "聚类 2"], ['["a", ""]', "聚类 2"]]
    rows = [('{"translations": [{"id": "1", "translated": "x"}, {"id": "2"}, {"id": "", "translated": "y"}]}',), ("no",)]
    assert [[tuple(x) for x in g[0]] for g in values(spark, rows, "a string", answers.translations(F.col("a")))] == [[("1", "x")], []]
    rows = [('{"research_focus_summary": "s"}',), ("x",)]
    got = [tuple(g[0]) for g in values(spark, rows, "a string", answers.insights(F.col("a")))]
    assert got == [("s",) + ("暂无分析",) * 4, ("分析生成失败，请重试。",) * 5]
    rows = [('{"overview": "o", "topics": [{"paper_count": 1}]}',), ("x",)]
    got = [g[0] for g in values(spark, rows, "a string", answers.overview(F.col("a"), F.lit(3)))]
    assert got[0].topics[0].topic_name == "未命名" and got[1].overview == "本期共推荐 3 篇论文。"


def test_labels_to_make(spark):
    rows = [(None,), ("",), ("聚类 3",), ("聚类 x",), ("主题",)]
    assert [g[0] for g in values(spark, rows, "l string", answers.needs_label(F.col("l")))] == [True, True, True, False, False]


def test_feed_texts(spark):
    rows = [("a<b", None, None, 0.0625, "x", None)]
    got = values(spark, rows, "abstract string, published timestamp, venue string, score double, label string, doi string",
                 feed.description(F.col("abstract"), F.col("published"), F.col("venue"), F.col("score"), F.col("label")),
                 feed.content(F.array().cast("array<string>"), F.col("venue"), F.col("doi"), F.col("score"), F.col("label"), F.col("abstract")))[0]
    assert got == ("a<b\nPublished: Unknown\nVenue: Unknown\nScore: 0.062 (x)", "<p><strong>Relevance:</strong> 0.062 (x)</p>\n<p>a&lt;b</p>")


LONG = "This sentence is long enough to be taken for an abstract by the rules, because it has more than a hundred characters."


def page(body, url="https://example.org/1"):
    return (url, body)


def test_extraction_rules(spark):
    short = "Too short."
    bullets = "• one thing that is written here at some length • another thing that is written here • a third thing, also quite long"
    cases = [
        (page(f'<meta content="{LONG}" property="og:description">', "https://dl.acm.org/x"), LONG),
        (page(f'<META NAME="description" CONTENT="{LONG}">'), LONG),
        # a short meta tag does not count, the selector does
        (page(f'<meta property="og:description" content="{short}"><div role="paragraph"><b>Abstract</b>: {LONG}</div>', "https://dl.acm.org/x"), LONG),
        # selectors first
        (page(f'<meta property="og:description" content="{LONG} meta"><div id="abstract1">{LONG}</div>', "https://www.sciencedirect.com/x"), LONG),
        (page(f'<meta property="og:description" content="{LONG} meta"><div class="x">{LONG}</div>', "https://www.tandfonline.com/x"), f"{LONG} meta"),
        # highlights are refused, the generic meta tag is found
        (page(f'<div id="abstract">{bullets}</div><meta name="citation_abstract" content="{LONG}">', "https://www.sciencedirect.com/x"), LONG),
        (page(f'<section class="my-abstract-box"><p>{LONG}</p></section>'), LONG),
        (page('{"abstract": "Quote \\" and ' + LONG + '"}', "https://ieeexplore.ieee.org/document/1"), 'Quote " and ' + LONG),
        (page(f'<div id="abstract">{short}</div>'), None),
        # a tag of which nothing is left does not end the search
        (page('<meta name="dc.description" content="' + "&lt;b&gt;&#160;&lt;/b&gt; " * 20 + f'"><section class="abstract">{LONG}</section>', "https://www.nature.com/x"), LONG),
        (page(""), None),
        # the host must end with the domain
        (page(f'<div id="Abs1-content">{LONG}</div>', "https://signature.com/x"), None),
        (page(f'<div id="Abs1-content">{LONG}</div>', "https://www.nature.com:443/x"), LONG),
    ]
    frame = spark.createDataFrame([(i, u, h) for i, ((u, h), _) in enumerate(cases)], "i long, url string, html string")
    got = {r.i: r.abstract for r in extract_abstracts(frame).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_shrunk_pages(spark):
    body = "word " * 60
    rows = [(f'<meta property="og:description" content="{body}">',), (f'<meta property="og:description" content="IEEE {body}"><h2>Abstract</h2> {body}</div>',),
            (f'<div id="abstract">{body} Show More</div><script>x</script><p>rest</p>',), ("<nav>n</nav><!-- c --><p>a   b</p>",)]
    got = [g[0] for g in values(spark, rows, "h string", shrink_page(F.col("h")))]
    assert got[0] == LEAD_DESCRIPTION + body.strip()
    assert got[1] == LEAD_SECTION + body.strip()
    assert got[2].endswith("<p>rest</p>") and "script" not in got[2]
    assert got[3] == "<p>a b</p>"


def test_entities_in_the_jvm_and_in_python(spark):
    import html

    from litradar.functions.text import unescape

    texts = ["a &lt;b&gt; &amp;lt; &quot;x&quot; &#39;y&#39; &nbsp;", "&amp;amp;lt;", "caf&eacute; &lt;", "&#x41;&#66; &amp", "R&D &amp; more", "none", "", "&amp;#39; &#160;"]
    got = [g[0] for g in values(spark, [(t,) for t in texts], "t string", unescape(F.col("t")))]
    assert got == [html.unescape(t) for t in texts]


def test_landed_answers_fill_missing_abstracts(spark):
    long = "a" * 60
    extracted = spark.createDataFrame([("x", None), ("x", None), ("y", "kept"), ("z", None), (None, None), ("w", None)], "doi string, abstract string")
    answers = spark.createDataFrame([("x", f" {long}b "), ("x", f"{long}a"), ("x", "short"), ("y", long), ("z", f"NOT_FOUND {long}"), (None, long), ("v", long)], "doi string, answer string")
    got = sorted(((r.doi, r.abstract) for r in with_answers(extracted, answers).collect()), key=repr)
    assert got == sorted([("x", long + "a"), ("x", long + "a"), ("y", "kept"), ("z", None), (None, None), ("w", None)], key=repr)
    assert with_answers(extracted, answers.limit(0)).where("abstract IS NULL").count() == 5
