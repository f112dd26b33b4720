"""Main text of web pages, with host boilerplate found as repeated token runs.

A page is parsed into blocks, once, in time linear in its length. What markup says is no article (scripts, menus, forms,
adverts, comments, ...) goes; if there is an article element, or another one that holds the main text, its blocks are the
text, else those of which markup says nothing. Then the host decides: the token streams of the host's pages are cut into
all their suffixes, suffixes that share their first tokens are brought together (an interval of the host's suffix array),
and the ones that start on a share of the host's distinct pages mark their tokens as boilerplate. Marked runs are removed,
the others stay. Pages with equal texts count as one, so that copies of an article do not remove it. Inside an article
element only copies inside the article elements of more pages count, headings and the opening block stay, and an article
of which most would go is a near copy and stays whole.

Not every suffix is shuffled. The anchor of a run is the smallest hash of its 3-grams, so equal runs have equal anchors;
a first pass counts the distinct anchors of each page (about one token in five, combined before the shuffle). Only runs
whose anchor is on enough pages can be boilerplate. These anchors go to the tasks as a bit set, whose false hits cost
work and change no result; the second pass counts the runs that it lets through exactly. No task gets a host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread_scan
from .common import small_side
from .repeats import _hashes, _prefix_sums
from .shingles import mix64, seeded

# a run of so many tokens on so many distinct pages of a host, and on such a share of them, is boilerplate
RUN_TOKENS, RUN_PAGES, RUN_SHARE = 10, 3, 0.2
# the same for runs inside an article element
MAIN_PAGES, MAIN_SHARE = 6, 0.5
ANCHOR_TOKENS = 3
# bits for each anchor in the set of frequent ones, and the least and most bits of the set, as powers of 2
ANCHOR_BITS, LEAST_BITS, MOST_BITS = 64, 16, 28
# stands among the anchors of a host for "has frequent ones"
ANY = 0x9E3779B9

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")

# Elements of the markup language.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# elements whose start ends an open paragraph, and those that a paragraph outside of them does not reach into
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
P_SCOPE = ("button", "caption", "object", "table", "td", "template", "th")
# elements whose start ends an open one of the same kind, up to the list or table around them
_CELLS, _SECTIONS, _TERMS = ("td", "th"), ("tbody", "thead", "tfoot"), ("dt", "dd")
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",))}
ENDS |= {n: (_CELLS, ("table",)) for n in _CELLS} | {n: (_SECTIONS, ("table",)) for n in _SECTIONS} | {n: (_TERMS, ("dl",)) for n in _TERMS}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CHROME = frozenset("head nav footer aside button select option menu dialog svg canvas object audio video template map fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments disqus respond reply "
    "replies share sharing social related recommended popup modal overlay login search widget toolbar skip".split())
# of these, words that a section of an article may be about; alone they say nothing there
TOPICS = frozenset("alert banner cookie cookies consent header footer login menu navigation notice notices overlay promotion recommended related reply replies search skip subscription toolbar widget".split())
# parts of a class name that go with them
BOX_WORDS = frozenset("area bar block bottom box button buttons container form icons inline inner item items left link links list list panel right section slot text top unit wrap wrapper".split())
# parts of a class name that tell a state or a topic and no function, as in no-sidebar or tag-social
STATE_WORDS = frozenset("no not has with without enabled disabled category tag".split())
MAIN_ROLES = frozenset(["main", "article"])
MAIN_WORDS = (frozenset(["articlebody"]), frozenset(["article"]), frozenset(["entry", "content"]), frozenset(["post", "content"]), frozenset(["post", "body"]), frozenset(["story"]), frozenset(["main", "content"]))


@dataclass
class Page:
    main: list[str] = field(default_factory=list)  # blocks of the element that holds the article
    other: list[str] = field(default_factory=list)  # blocks of which markup says nothing
    chrome: list[str] = field(default_factory=list)  # blocks that are no article
    found: bool = False
    fixed: list[int] = field(default_factory=list)  # blocks of main that stay: headings and the first other one


def _names_chrome(name: str) -> bool:
    """Does the whole of a class name or id tell of an element that is no part of the article around it."""
    parts = {x for x in _PARTS.split(name) if x}
    chrome = parts & CHROME_WORDS
    return bool(chrome) and parts <= CHROME_WORDS | BOX_WORDS and (len(chrome) > 1 or not chrome <= TOPICS)


def _role(name: str, rest: str, in_main: bool) -> str:
    """``chrome``, ``wrapper`` (chrome unless an article stands in it), ``article``, ``main`` (weaker), ``content`` (a main one by its class) or nothing."""
    if name in CHROME:
        return "chrome"
    words, chrome, role = set(), False, ""
    for key, *values in _ATTRIBUTE.findall(rest) if rest else ():
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "chrome"
        if key == "role":
            role = value
        elif key in ("class", "id", "itemprop"):
            words.update(_PARTS.split(value))
            for own in value.split():
                parts = _PARTS.split(own)
                if in_main:
                    chrome = chrome or _names_chrome(own)
                elif STATE_WORDS.isdisjoint(parts):
                    chrome = chrome or not CHROME_WORDS.isdisjoint(parts)
    if role in CHROME_ROLES:
        return "chrome"
    if name == "form" or role == "form" or chrome and name not in ("body", "html"):
        return "wrapper"
    if name == "header":
        return "" if in_main else "chrome"
    if name == "article":
        return "article"
    if name == "main" or role in MAIN_ROLES:
        return "main"
    return "content" if any(w <= words for w in MAIN_WORDS) else ""


class _Open:
    """The open elements: all blocks, and inline ones that have a role or stand in one of their name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, *names: str) -> int:
        return max([self.places[n][-1] for n in names if self.places.get(n)], default=-1)

    def push(self, name: str, kind: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, kind))

    def pop(self) -> tuple[str, str]:
        name, kind = self.stack.pop()
        self.places[name].pop()
        if name not in INLINE:
            self.blocks.pop()
        return name, kind

    def ended_by_start(self, name: str) -> int:
        """The lowest element that the start of ``name`` ends though it was not closed, or the height of the stack."""
        at = len(self.stack)
        if name in ENDS:
            same, around = ENDS[name]
            if (spot := self.last(*same)) > self.last(*around):
                at = spot
        if name in ENDS_P and (spot := self.last("p")) > self.last(*P_SCOPE):
            at = min(at, spot)
        return at

    def ended_by_end(self, name: str) -> int:
        spot = self.last(name)
        # an inline element's end does not reach out of a block
        return len(self.stack) if spot < 0 or name in INLINE and self.blocks and self.blocks[-1] > spot else spot


def parse(html: str | None) -> Page:
    """Blocks in page order: white space inside is one space, character references are decoded, empty ones are left out.

    End tags may be missing where the language lets one omit them; an end tag closes all that is open inside its element;
    one without a start is ignored. An inline element that is no article goes out of its block and does not split it.
    """
    page = Page()
    strong, weak, wrapped = [], [], []
    open_ = _Open()
    parts: list[str] = []
    outer: list[list[str]] = []  # what stood in the block before an inline element that goes
    kinds = {"chrome": 0, "wrapper": 0, "article": 0, "main": 0, "content": 0, "wrapped": 0}
    around = [0]  # wrappers around each article or main element that stands in one; what is in no other is the article's
    headings = 0
    raw, at, text = None, 0, html or ""

    def flush() -> None:
        nonlocal parts
        if not parts:
            return
        block = " ".join("".join(parts).split())
        parts = []
        if block:
            if kinds["chrome"] or kinds["wrapper"] > around[-1]:
                page.chrome.append(block)
            elif kinds["wrapped"]:
                wrapped.append((block, headings > 0))
            elif kinds["article"]:
                strong.append((block, headings > 0))
            elif kinds["main"] or kinds["content"]:
                weak.append((block, headings > 0))
            else:
                page.other.append(block)

    def add(piece: str) -> None:
        parts.append(entities.unescape(piece) if "&" in piece else piece)

    def close_to(height: int) -> None:
        nonlocal parts, headings
        while len(open_.stack) > height:
            name, kind = open_.stack[-1]
            if kind or name not in INLINE:
                flush()
            open_.pop()
            if kind:
                kinds[kind] -= 1
                if kind == "wrapped":
                    around.pop()
                elif name in INLINE and kind in ("chrome", "wrapper"):
                    parts = outer.pop()
            headings -= name in HEADINGS

    while at < len(text):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            at, raw = end.end() if end else len(text), None
            continue
        found = _MARKUP.search(text, at)
        if not found:
            add(text[at:])
            break
        if found.start() > at:
            add(text[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if found["close"]:
            close_to(open_.ended_by_end(name))
            continue
        if name in RAW:
            raw = name
            continue
        close_to(open_.ended_by_start(name))
        if name in VOID or found["rest"].endswith("/"):
            continue
        kind = _role(name, found["rest"], any(kinds[k] for k in ("article", "main", "content", "wrapped")))
        if kind in ("article", "main") and kinds["wrapper"] > around[-1]:
            kind = "wrapped"
        if name in INLINE:
            if kind in ("chrome", "wrapper"):
                outer.append(parts)
                parts = []
            elif kind:
                flush()
            elif not open_.places.get(name):
                continue
        open_.push(name, kind)
        headings += name in HEADINGS
        if kind:
            kinds[kind] += 1
        if kind == "wrapped":
            around.append(kinds["wrapper"])
    flush()
    close_to(0)
    flush()
    # an article in a wrapper is the page's if none stands outside, or else a teaser or a comment
    size = lambda blocks: sum(len(b) for b, _ in blocks)
    if wrapped and not strong and size(wrapped) > (size(weak) if weak else sum(map(len, page.other))):
        strong = wrapped
    else:
        page.chrome += [b for b, _ in wrapped]
    main = strong or weak
    page.main = [b for b, _ in main]
    opening = next((i for i, (_, heading) in enumerate(main) if not heading), 0)
    page.fixed = [i for i, (_, heading) in enumerate(main) if heading or i == opening]
    page.found = bool(page.main)
    if strong:
        page.other += [b for b, _ in weak]
    return page


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else ""


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


class Runs:
    """All runs of a page's blocks: ``block``, first token ``at`` and 32-bit ``anchor``. A block shorter than a run is one run."""

    def __init__(self, blocks: list[str], run_tokens: int) -> None:
        data = np.frombuffer("\n".join(blocks).encode("utf-8", "replace"), np.uint8)
        sums = _prefix_sums(data)
        # blocks have single spaces and no line feed
        gaps = np.flatnonzero((data == 32) | (data == 10)) if blocks else np.zeros(0, np.int64)
        begins, ends = (np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))) if blocks else (gaps, gaps)
        self.tokens = _hashes(sums, begins, ends)
        last = np.concatenate((np.flatnonzero(data[gaps] == 10) + 1, [len(begins)])) if blocks else gaps
        sizes = np.diff(last, prepend=0)
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.flatnonzero(np.arange(len(of)) + run_tokens <= last[of])
        self.place = seeded(41, run_tokens) | np.uint64(1)
        short = np.flatnonzero(sizes < run_tokens)
        self.short = _hashes(sums, begins[(last - sizes)[short]], ends[last[short] - 1])
        smallest = np.zeros(0, np.uint64)
        if len(self.first):
            gram = min(ANCHOR_TOKENS, run_tokens)
            smallest = mix64(self._sums(np.arange(len(of) - gram + 1), gram))
            span, width = 1, run_tokens - gram + 1
            while span < width:
                step = min(span, width - span)
                smallest = np.minimum(smallest[:-step], smallest[step:])
                span += step
        self.anchor = np.concatenate((smallest[self.first] if len(self.first) else smallest, self.short)) >> np.uint64(32)
        self.block = np.concatenate((of[self.first], short)).astype(np.int32)
        self.at = np.concatenate((self.first - (last - sizes)[of[self.first]], np.zeros(len(short), np.int64))).astype(np.int32)

    def _sums(self, first: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(first), np.uint64)
        for i in range(n):
            out += self.tokens[first + i] * self.place[i]
        return out

    def run(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the runs at these positions."""
        n = len(self.first)
        return np.concatenate((mix64(self._sums(self.first[which[which < n]], len(self.place))), self.short[which[which >= n] - n])).view(np.int64)


def _host_hash(host: str) -> int:
    return zlib.crc32(host.encode("utf-8", "replace"))


def _outside(page: Page) -> list[str]:
    return page.chrome + (page.other if page.found else [])


def _stream(page: Page) -> int:
    """Digest of the text that the page has without host runs; equal ones are one distinct page."""
    return _digest("\n".join(page.main or page.other or page.chrome)) - (1 << 63)


_PARSED = "page_id long, url string, _h long, host string, stream long, main boolean, blocks array<string>, fixed array<int>, outside array<string>"
_PARSED_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("_h", pa.int64()), ("host", pa.string()), ("stream", pa.int64()), ("main", pa.bool_()),
                           ("blocks", pa.list_(pa.string())), ("fixed", pa.list_(pa.int32())), ("outside", pa.list_(pa.string()))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's host, digest, text that it may keep, and blocks outside of that."""
    for batch in batches:
        for begin in range(0, len(batch), 256):
            part = batch.slice(begin, 256)
            out = []
            for page_id, url, h, html in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "_h", "html")], strict=True):
                page = parse(html)
                out.append((page_id, url, h, host_of(url), _stream(page), page.found, page.main or page.other, page.fixed, _outside(page)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARSED_ARROW, strict=True)], schema=_PARSED_ARROW)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """A few rows at a time become Python objects."""
    for begin in range(0, len(batch), 256):
        part = batch.slice(begin, 256)
        yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _anchors(run_tokens: int):
    """``host, key, target``: the pages' streams with their host, and without it the anchors of each page, keyed with the host's hash.

    ``target`` tells the anchors that are in the text that the page may keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, streams, keys, targets = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for host, stream, blocks, outside in _rows(batch, "host", "stream", "blocks", "outside"):
                if not (blocks or outside):
                    continue
                hosts.append(host)
                streams.append(stream)
                own = np.unique(Runs(blocks, run_tokens).anchor)
                others = np.setdiff1d(Runs(outside, run_tokens).anchor, own)
                keys += [np.concatenate((own, others)) | np.uint64(_host_hash(host) << 32)]
                targets += [np.arange(len(own) + len(others)) < len(own)]
            key = pa.array(np.concatenate(keys).view(np.int64))
            names = ["host", "key", "target"]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(streams, pa.int64()), pa.array([True] * len(hosts), pa.bool_())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), key, pa.array(np.concatenate(targets))], names=names)

    return run


def _least(pages, share: float, run_pages: int):
    return F.greatest(F.lit(run_pages), F.ceil(F.round(pages * share, 6)))


def _anchor_bits(keys: DataFrame) -> np.ndarray:
    """The set of frequent anchors, and of the hosts that have any, as bits; several may share one."""
    hosts = keys.select(F.shiftright("key", 32).alias("host")).distinct()
    keys = keys.union(hosts.select(F.shiftleft("host", 32).bitwiseOR(F.lit(ANY)).alias("key")))
    bits = min(max((ANCHOR_BITS * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    spot = F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 32)).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 31))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _passing(anchors: np.ndarray, host: str, bits: np.ndarray) -> np.ndarray:
    spot = (anchors ^ np.uint64(_host_hash(host))) & np.uint64(len(bits) * 32 - 1)
    return np.flatnonzero(bits[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32) & np.uint32(1))


def _has_frequent(host: str, bits: np.ndarray) -> bool:
    return len(_passing(np.array([ANY], np.uint64), host, bits)) > 0


def _candidates(run_tokens: int, bits: np.ndarray):
    """Runs that may be boilerplate, by page: those of its text, with the text, and those outside of it (``main`` is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found = [], [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))]
            for page_id, h, host, stream, main, blocks, fixed, outside in _rows(batch, "page_id", "_h", "host", "stream", "main", "blocks", "fixed", "outside"):
                if not _has_frequent(host, bits):
                    continue
                for part, kind in ((blocks, main), (outside, None)):
                    if part and len(which := _passing((runs := Runs(part, run_tokens)).anchor, host, bits)):
                        out.append((page_id, h, host, stream, kind, part if kind is not None else None, fixed if kind is not None else None))
                        found.append((runs.block[which], runs.at[which], runs.run(which)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()))
            ends = np.cumsum([len(x[0]) for x in found]).astype(np.int32)
            spots = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["block", "at", "run"])
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], pa.ListArray.from_arrays(pa.array(ends), spots)],
                                             names=["page_id", "_h", "host", "stream", "main", "blocks", "fixed", "runs"])

    return run


def _without_runs(run_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for main, blocks, fixed, spots in _rows(batch, "main", "blocks", "fixed", "spots"):
                blocks = [b.split(" ") for b in blocks]
                kept = [[True] * len(b) for b in blocks]
                stays = set(fixed or ())
                for s in spots or ():
                    own = kept[s["block"]]
                    if s["block"] not in stays:
                        own[s["at"] : s["at"] + run_tokens] = [False] * min(run_tokens, len(own) - s["at"])
                if main and 2 * sum(map(sum, kept)) < sum(map(len, kept)):
                    kept = [[True] * len(b) for b in blocks]
                lines = [" ".join(t for t, k in zip(b, own, strict=True) if k) for b, own in zip(blocks, kept, strict=True)]
                texts.append("\n".join(x for x in lines if x))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("_h"), pa.array(texts, pa.string())], names=["page_id", "_h", "text"])

    return run


def host_limits(counted: DataFrame, run_pages: int, run_share: float, main_pages: int, main_share: float) -> DataFrame:
    """``host, least, least_main``: on how many distinct pages of the host a run is boilerplate, outside and inside an article element."""
    hosts = counted.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("pages"))
    return hosts.select("host", _least(F.col("pages"), run_share, run_pages).alias("least"), _least(F.col("pages"), main_share, main_pages).alias("least_main"))


def host_runs(candidates: DataFrame, limits: DataFrame, run_pages: int = RUN_PAGES) -> DataFrame:
    """``page_id, _h, block, at``: places in the pages' texts where a run starts that enough distinct pages of the host have.

    For text inside an article element only pages that have the run inside theirs count.
    """
    spots = candidates.select("page_id", "_h", "host", "stream", "main", F.explode("runs").alias("r")).select("page_id", "_h", "host", "stream", "main", "r.*")
    pages = spots.groupBy("host", "run", "stream").agg(F.max(F.coalesce("main", F.lit(False)).cast("int")).alias("main"))
    pages = pages.groupBy("host", "run").agg(F.count("*").alias("n"), F.sum("main").alias("n_main"))
    common = pages.where(F.col("n") >= run_pages).join(limits, "host").select("host", "run", (F.col("n") >= F.col("least")).alias("in_other"), (F.col("n_main") >= F.col("least_main")).alias("in_main"))
    common = small_side(cut_lineage(common.where("in_other OR in_main")))
    marked = spots.where(F.col("main").isNotNull()).join(common, ["host", "run"])
    return marked.where(F.when(F.col("main"), F.col("in_main")).otherwise(F.col("in_other"))).select("page_id", "_h", "block", "at")


def main_text(pages: DataFrame, run_tokens: int = RUN_TOKENS, run_pages: int = RUN_PAGES, run_share: float = RUN_SHARE, main_pages: int = MAIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """Per page row: ``page_id, url, text`` (blocks joined by a line feed, empty if none).

    A null html is empty; pages without a url are of one nameless host; repeated rows get a row each; a null page_id is
    kept; markup that is cut off ends where the page ends; an empty table gives no rows; other columns are ignored.
    """
    rows = spread_scan(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html", "url").alias("_h"), "html"))
    parsed = cut_lineage(rows.mapInArrow(_parsed, _PARSED))
    anchors = parsed.select("host", "stream", "blocks", "outside").mapInArrow(_anchors(run_tokens), "host string, key long, target boolean")
    counted = anchors.groupBy("host", "key").agg(F.count("*").alias("n"), F.max("target").alias("target"))
    counted = cut_lineage(counted.where(F.col("host").isNotNull() | F.col("target") & (F.col("n") >= run_pages)))
    limits = small_side(cut_lineage(host_limits(counted, run_pages, run_share, main_pages, main_share)))
    # hosts with one hash have the lower limit, repeated pages count twice: no frequent anchor is missed
    by_hash = limits.groupBy(F.crc32("host").alias("hash")).agg(F.min(F.least("least", "least_main")).alias("least"))
    keys = counted.where(F.col("host").isNull()).withColumn("hash", F.shiftrightunsigned("key", 32))
    bits = _anchor_bits(cut_lineage(keys.join(by_hash, "hash").where(F.col("n") >= F.col("least")).select("key")))
    candidates = cut_lineage(parsed.drop("url").mapInArrow(_candidates(run_tokens, bits), "page_id long, _h long, host string, stream long, main boolean, blocks array<string>, "
                                                           "fixed array<int>, runs array<struct<block: int, at: int, run: long>>"))
    spots = host_runs(candidates, limits, run_pages).groupBy("page_id", "_h").agg(F.collect_set(F.struct("block", "at")).alias("spots"))
    # repeated rows are one here
    texts = candidates.where(F.col("main").isNotNull()).select(F.col("page_id").alias("_p"), F.col("_h").alias("_x"), "main", "blocks", "fixed").dropDuplicates(["_p", "_x"])
    same = (F.col("_h") == F.col("_x")) & F.col("page_id").eqNullSafe(F.col("_p"))
    cleaned = spots.join(texts, same).select("page_id", "_h", "main", "blocks", "fixed", "spots").mapInArrow(_without_runs(run_tokens), "page_id long, _h long, text string")
    cleaned = cut_lineage(cleaned).select(F.col("page_id").alias("_p"), F.col("_h").alias("_x"), F.col("text").alias("_cleaned"))
    known = parsed.select("page_id", "url", "_h", F.array_join("blocks", "\n").alias("text"))
    if cleaned.isEmpty():
        return known.select("page_id", "url", "text")
    return known.join(cleaned, same, "left").select("page_id", "url", F.coalesce("_cleaned", "text").alias("text"))
