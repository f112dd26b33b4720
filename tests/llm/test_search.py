"""Top-k search and main text of pages."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from checks import same
from hypothesis import given, settings
from hypothesis import strategies as st

from litradar.llm import boilerplate, topk
from litradar.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * (1 + i % 4)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[3][1]) for i in range(1000, 1300)]  # ties: one vector many times
    rows += [(0, rows[0][1]), (700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] * 8), (703, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, slice int, score int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_top_k_equals_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "SLICE_ROWS", 50)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    oracle = {"op5_pivot_topk": ORACLE["op5_pivot_topk"]}
    assert same(spark, QUERIES, oracle, "op5_pivot_topk", vectors) is None


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (100, [3.0]), (7, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    assert got == [(0, 1, 100, 3 * 1024 * 1024), (0, 2, 7, 0), (100, 1, 0, 3 * 1024 * 1024), (100, 2, 7, -3 * 1024 * 1024)]


def test_scores_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame).collect()
    near = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(near).collect()] == [(0, 1, 1, 2**60 + 2 * 2**20)]


def test_large_components_stay_exact():
    a = np.array([[2**30, 3], [1, 2**29]], dtype=np.int64)
    assert topk._products(a, a).tolist() == [[2**60 + 9, 2**30 + 3 * 2**29], [2**30 + 3 * 2**29, 1 + 2**58]]


PAGES = [
    ("<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><ul><li>menu</li></ul></nav><header>site</header>"
     "<article class='post'><header><h1>Title &amp; more</h1></header><p>One\n two&nbsp;<b>three</b>.<p>Four &lt;five&gt;<br>six"
     "<div class='ad-box'>buy</div><aside>side</aside><form><p>name</p></form><section id='comments'><p>first!</p></section></article><footer>f</footer></body></html>",
     "Title & more\nOne two three.\nFour <five> six"),
    ("<body><div id=main-content><p>text</p><p hidden>secret</p></div><div>rest</div>", "text"),
    ("<p>only a <!-- x --> paragraph</p><p class='cookie-notice'>we use</p>", "only a paragraph"),
    ("plain &am text &amp", "plain &am text &"),
    ("<article><p>cut <a hre", "cut"),
    ("<style>p{}</style><script>never closed <p>x</p>", ""),
    ("", ""), (None, ""),
    ("<article><article class=comment>c</article><p>a</p></article><article>b</article>", "a\nb"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_parse(html, text):
    page = boilerplate.parse(html)
    assert "\n".join(page.main or page.other) == text


def test_host_runs_decide_where_markup_does_not(spark, tmp_path):
    line = "subscribe now to read all of our stories every day"
    def page(i):
        own = " ".join(f"w{i}_{k}" for k in range(30))
        return f"<div>{line}</div><div>{own}. short end {i}</div><div>{line} {own}</div>"

    rows = [(i, "http://Host.example.com/%d" % i, page(i)) for i in range(5)]
    rows += [(10, "http://other.example.com/", f"<div>{line}</div>"), (11, None, "<p>x</p>"), (None, "http://host.example.com/", None), (3, rows[3][1], rows[3][2])]
    # one page's copies count as one
    rows += [(20 + i, "http://copies.example.com/%d" % i, "<div>" + " ".join(f"c{k}" for k in range(20)) + "</div>") for i in range(4)]
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    frame["host"], frame["blocks"], frame["text"] = 1, 2, 3
    frame.to_parquet(tmp_path / "pages.parquet")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in QUERIES["op3_main_text"](spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, _, html in rows:
        own = " ".join(f"w{i}_{k}" for k in range(30))
        text = f"{own}. short end {i}\n{own}" if i is not None and i < 5 else {10: line, 11: "x", None: ""}.get(i, " ".join(f"c{k}" for k in range(20)))
        want.append((i, text, len(text)))
    assert got == sorted(want, key=repr)


def test_common_phrases_of_a_large_host_stay(spark):
    phrase = "as far as we can tell from the figures of the last few years"
    footer = "all rights of these pages belong to their owners and to nobody else"
    def blocks(i):
        own = " ".join(f"w{i}_{k}" for k in range(20))
        return [*(["Introduction"] if i < 6 else []), f"{phrase} {own}" if i % 8 == 0 else own, "Read on", footer]

    pages = [(i, f"http://large.example.com/{i}", "".join(f"<div>{b}</div>" for b in blocks(i))) for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in boilerplate.main_text(frame).collect()}
    # six pages have the heading and eight the phrase; the teaser and the footer are on all
    assert got == {i: "\n".join(blocks(i)[:-2]) for i in range(60)}


def test_host_runs_inside_article_elements(spark):
    notice = "our shop has a summer sale until the end of this long month"
    phrase = "as far as we can tell from the figures of the last few years"
    def blocks(i):
        own = " ".join(f"w{i}_{k}" for k in range(30))
        return [f"{phrase} {own}" if i % 3 == 0 else own, notice]

    pages = [(i, f"http://shop.example.com/{i}", blocks(i)) for i in range(12)]
    copied = " ".join(f"c{k}" for k in range(40))
    pages += [(20 + i, f"http://copies.example.com/{i}", [f"{copied} {i}"]) for i in range(4)]
    frame = spark.createDataFrame([(i, url, "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in bs) + "</article>") for i, url, bs in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in boilerplate.main_text(frame).collect()}
    # a third of the pages have the phrase; near copies are no boilerplate
    assert got == {i: "\n".join(x for x in bs if x != notice) for i, _, bs in pages}


WRAPPED = [
    ("<div class='layout no-sidebar'><article><p>a text</p></article></div>", "a text"),
    ("<div class='has-sidebar share-enabled'><p>a</p><div class=sidebar>s</div></div>", "a"),
    ("<form action=/><nav>n</nav><main><p>a text</p><form>search</form></main></form>", "a text"),
    ("<form><div class=menu>m</div><article><p>a text</p><div class=share>s</div></article></form><p>end</p>", "a text"),
    ("<div class='page sidebar-right'><article><header class='entry-header'><h1>Title</h1></header><p>a</p></article></div>", "Title\na"),
    ("<article><header class='entry-header'><h1>Title</h1></header><p>a</p></article>", "Title\na"),
    ("<article class='post tag-social'><p>a</p></article><div class=related><article>a longer teaser</article></div>", "a"),
    ("<article><p>a</p><section id=comments><article>a comment</article></section></article>", "a"),
    ("<p>all of the text</p><div class=related><article>teaser</article></div>", "all of the text"),
    ("<nav><article>n</article></nav><p>a</p>", "a"),
]


@pytest.mark.parametrize(("html", "text"), WRAPPED)
def test_articles_inside_wrappers(html, text):
    page = boilerplate.parse(html)
    assert "\n".join(page.main or page.other) == text


OPEN_ENDS = [
    ("<ul><li class='menu-item'>Home<li class='menu-item'>About</ul><p>Main text", "Main text"),
    ("<p class='ad'>Buy<p>Main text", "Main text"),
    ("<table><tr><td class='share'>x<td>cell</table><p>More", "cell\nMore"),
    ("<article><p>a<dl><dt>x<dd>y<dt class=ad>z<dd>w</dl></article>", "a\nx\ny\nw"),
    ("<ul><li class=ad>x<ul><li>y</ul>z<li>kept</ul>", "kept"),
    ("<div><p>one<div class=ad>two</p>three</div>four</div>five", "one\nfour\nfive"),
    ("<article><h1>T</h1><section id='search'><h2>Search algorithms</h2><p>a</p></section><section id='related-work'><p>b</p></section>"
     "<div class='promotion-effects'>c</div><p class='alert'>d</p><div class='cookie-banner'>e</div><div class='share-links'>f</div></article>", "T\nSearch algorithms\na\nb\nc\nd"),
    ("<p>Hi <a class='login'>Bob</a> now</p>", "Hi now"),
    ("<p>Hi <span class='ad'><span>x</span> y</span>there <a href=/>link</a></p>", "Hi there link"),
    ("<article><p>Hi <a class='login'>Bob</a> now</p></article>", "Hi Bob now"),
    ("<p>a <b>b<p>c</b> d", "a b\nc d"),
]


@pytest.mark.parametrize(("html", "text"), OPEN_ENDS)
def test_end_tags_may_be_missing(html, text):
    page = boilerplate.parse(html)
    assert "\n".join(page.main or page.other) == text


def test_parser_is_linear():
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        boilerplate.parse("<div><p>x<li>" * n + "<span class=ad><b>y</i></span>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


OMITTED = {"p", "li", "dt", "dd", "td", "tr"}


@st.composite
def trees(draw, depth=0):
    """Markup, markup without the end tags that may be left out, and the blocks that stay."""
    kind = draw(st.sampled_from(["p", "ul", "dl", "table"] if depth > 2 else ["p", "ul", "dl", "table", "div"]))
    ad = draw(st.booleans()) and draw(st.booleans())
    attribute = " class='ad'" if ad else ""
    if kind == "p":
        text = draw(st.sampled_from(["one", "two &amp; three", "x"]))
        return f"<p{attribute}>{text}</p>", f"<p{attribute}>{text}", [] if ad else [text.replace("&amp;", "&")]
    if kind == "div":
        inner = draw(st.lists(trees(depth + 1), max_size=4))
        whole, short = ("".join(x[i] for x in inner) for i in (0, 1))
        return f"<div{attribute}>{whole}</div>", f"<div{attribute}>{short}</div>", [] if ad else [b for x in inner for b in x[2]]
    item = {"ul": ["li"], "dl": ["dt", "dd"], "table": ["td"]}[kind]
    whole, short, blocks = "", "", []
    for _ in range(draw(st.integers(0, 3))):
        name, hidden, text = draw(st.sampled_from(item)), draw(st.booleans()), draw(st.sampled_from(["a", "b c", "d"]))
        tag = f"<{name} class='share'>" if hidden else f"<{name}>"
        inner = draw(trees(depth + 2)) if depth < 2 and draw(st.booleans()) else ("", "", [])
        whole, short = f"{whole}{tag}{text}{inner[0]}</{name}>", f"{short}{tag}{text}{inner[1]}"
        blocks += [] if hidden else [text, *inner[2]]
    row = ("<tr>", "</tr>") if kind == "table" else ("", "")
    return f"<{kind}{attribute}>{row[0]}{whole}{row[1]}</{kind}>", f"<{kind}{attribute}>{row[0]}{short}</{kind}>", [] if ad else blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(trees(), max_size=5))
def test_omitted_end_tags_change_nothing(parts):
    whole, short = ("".join(p[i] for p in parts) for i in (0, 1))
    blocks = [b for p in parts for b in p[2]]
    for html in (whole, short, f"<nav>n</nav><article>{short}</article>"):
        page = boilerplate.parse(html)
        assert (page.main or page.other) == blocks


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_article_of_the_given_tables_loses_a_block(spark, sf):
    """Their pages have one article each, of headings and paragraphs that are all closed or end where the next one starts."""
    pages = pd.read_parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op3_main_text"](spark, f"/root/testdata/{sf}").collect()}
    import html as entities

    for page_id, html in zip(pages.page_id, pages.html, strict=True):
        article = re.search(r"<article[^>]*>(.*)</article>", html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(b|i|a|em|strong|span)\b[^>]*>", "", x))).split()) for x in re.split(r"</?(?:h1|p|li|ul|div)\b[^>]*>", article)]
        assert got[page_id] == "\n".join(b for b in blocks if b), page_id


def test_headings_and_copies_outside_articles_take_nothing_from_them(spark):
    """Each page's advert is the opening of another page's article, and all articles have one heading."""
    def own(i):
        return f"Opening {i} of a story with more than ten words in its very first sentence. " + " ".join(f"w{i}_{k}" for k in range(20))

    pages = [(i, f"http://small.example.com/{i}", f"<div class=ad>{own((i + 1) % 8)}</div><div>{own((i + 2) % 8)}</div><article><h1>The same heading on all pages of this one host here</h1><p>{own(i)}</p><p>z{i}</p></article>") for i in range(8)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in boilerplate.main_text(frame).collect()}
    assert got == {i: f"The same heading on all pages of this one host here\n{own(i)}\nz{i}" for i in range(8)}
