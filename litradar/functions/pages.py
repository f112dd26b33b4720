"""Abstract extraction from article pages by per-publisher rules.

All regular expressions run in the JVM; only entity decoding of the few texts a rule
found goes through Python, once per row.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import bind, collapse_spaces, decode_common, empty_to_null, has_rare_entities, one_space, strip, strip_tags

MIN_ABSTRACT = 100


@dataclass(frozen=True)
class Rules:
    """Where a publisher keeps its abstracts."""

    domains: tuple[str, ...]
    meta: tuple[tuple[str, str], ...]
    selectors: tuple[str, ...]
    selectors_first: bool = False


# Domains, meta tags and page patterns of each publisher, in the order they are tried.
PUBLISHERS: dict[str, Rules] = {
    "acm": Rules(
        ("dl.acm.org",),
        (("property", "og:description"), ("name", "dcterms.abstract"), ("name", "description")),
        (
            r'<div[^>]*role=["\']paragraph["\'][^>]*>(.*?)</div>',
            r'<section[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</section>',
        ),
    ),
    "ieee": Rules(
        ("ieeexplore.ieee.org",),
        (("property", "og:description"), ("property", "twitter:description"), ("name", "description")),
        (
            # possessive, so that a long text does not end in deep recursion
            r'"abstract"\s*:\s*"((?:[^"\\]++|\\.)++)"',
            r'<div[^>]*class=["\'][^"\']*abstract-text[^"\']*["\'][^>]*>(.*?)</div>',
        ),
        selectors_first=True,
    ),
    "springer": Rules(
        ("link.springer.com", "nature.com", "springeropen.com", "biomedcentral.com"),
        (("name", "dc.description"), ("property", "og:description"), ("name", "description")),
        (
            r'<div[^>]*id=["\']Abs1-content["\'][^>]*>(.*?)</div>',
            r'<section[^>]*aria-labelledby=["\']Abs1["\'][^>]*>(.*?)</section>',
            r'<div[^>]*class=["\'][^"\']*c-article-section__content[^"\']*["\'][^>]*>(.*?)</div>',
            r'<p[^>]*id=["\']Par1["\'][^>]*>(.*?)</p>',
        ),
    ),
    "elsevier": Rules(
        ("sciencedirect.com", "linkinghub.elsevier.com"),
        (("property", "og:description"), ("name", "dc.description"), ("name", "description")),
        (
            r'<div[^>]*(?:data-testid|id)=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</div>',
            r'<div[^>]*class=["\']abstract author["\'][^>]*>.*?<h2[^>]*>Abstract</h2>.*?<div[^>]*id=["\']sp\d+["\'][^>]*>(.*?)</div>',
            r'<div[^>]*class=["\']abstract author["\'][^>]*>.*?<h2[^>]*>Abstract</h2>.*?<div[^>]*id=["\']abss\d+["\'][^>]*>(.*?)</div>',
            r'<div[^>]*class=["\']abstract author["\'][^>]*>.*?<h2[^>]*>Abstract</h2>.*?<div[^>]*class=["\']u-margin-s-bottom["\'][^>]*>(.*?)</div>',
            r'<div[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>.*?<h2[^>]*>.*?</h2>\s*<div[^>]*>(.*?)</div>',
            r'<section[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>.*?<p[^>]*>(.*?)</p>',
            r'<div[^>]*id=["\']abs000\d["\'][^>]*>(.*?)</div>',
            r'<section[^>]*id=["\']abstracts?["\'][^>]*>.*?<div[^>]*>(.*?)</div>',
        ),
        selectors_first=True,
    ),
    "spie": Rules(
        ("spiedigitallibrary.org",),
        (("name", "citation_abstract"), ("property", "og:description"), ("name", "description")),
        (r'<div[^>]*class=["\'][^"\']*abstractSection[^"\']*["\'][^>]*>(.*?)</div>',),
    ),
    "mdpi": Rules(
        ("mdpi.com",),
        (("name", "dc.description"), ("property", "og:description")),
        (
            r'<div[^>]*class=["\'][^"\']*art-abstract[^"\']*["\'][^>]*>(.*?)</div>',
            r'<section[^>]*class=["\'][^"\']*html-abstract[^"\']*["\'][^>]*>(.*?)</section>',
        ),
    ),
    "taylor_francis": Rules(
        ("tandfonline.com",),
        (("property", "og:description"), ("name", "dc.description")),
        (
            r'<div[^>]*class=["\'][^"\']*hlFld-Abstract[^"\']*["\'][^>]*>.*?<p[^>]*>(.*?)</p>',
            r'<div[^>]*class=["\'][^"\']*abstractSection[^"\']*["\'][^>]*>.*?<p[^>]*>(.*?)</p>',
            r'<div[^>]*class=["\'][^"\']*abstractInFull[^"\']*["\'][^>]*>.*?<p[^>]*>(.*?)</p>',
            r'<div[^>]*class=["\'][^"\']*abstractSection[^"\']*["\'][^>]*>(.*?)</div>',
        ),
        selectors_first=True,
    ),
    "wiley": Rules(
        ("onlinelibrary.wiley.com",),
        (("property", "og:description"), ("name", "dc.description")),
        (
            r'<section[^>]*class=["\'][^"\']*article-section__abstract[^"\']*["\'][^>]*>(.*?)</section>',
            r'<div[^>]*class=["\'][^"\']*abstract-group[^"\']*["\'][^>]*>(.*?)</div>',
        ),
    ),
    "arxiv": Rules(
        ("arxiv.org",),
        (("property", "og:description"), ("name", "citation_abstract")),
        (r'<blockquote[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</blockquote>',),
    ),
}
GENERIC = Rules(
    (),
    (("name", "citation_abstract"), ("property", "og:description"), ("name", "dc.description"), ("name", "description")),
    (
        r'<div[^>]*id=["\']abstracts?["\'][^>]*>(.*?)</div>',
        r'<section[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</section>',
        r'<div[^>]*class=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</div>',
    ),
)
# The article state that one publisher embeds as JSON.
STATE = r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\});"
STATE_ABSTRACTS = r'(?s)"abstracts":\{"content":\[(.*?)\]\}'
STATE_BLOCK = r'(?s)\{"\$\$":\[(.*?)\],"\$":\{[^}]*"class":"(author(?:-highlights)?)"\},"#name":"abstract"\}'
STATE_PARAGRAPH = r'"#name":"(?:para|simple-para)","_":"([^"]+)"'


def host_of(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def detect_publisher(url: Column) -> Column:
    """Publisher whose domain the host is or ends with, else ``unknown``."""
    host = host_of(F.coalesce(url, F.lit("")))
    result = F.lit("unknown")
    for name, rules in reversed(PUBLISHERS.items()):
        hit = F.lit(False)
        for domain in rules.domains:
            hit = hit | (host == domain) | host.endswith("." + domain)
        result = F.when(hit, name).otherwise(result)
    return result


def meta_content(page: Column, attribute: str, value: str) -> Column:
    """Content of a meta tag, whichever attribute comes first; null if there is none."""
    after = rf'(?i)<meta[^>]*content=["\']([^"\']+)["\'][^>]*{attribute}=["\']?{value}["\']?[^>]*>'
    before = rf'(?i)<meta[^>]*{attribute}=["\']?{value}["\']?[^>]*content=["\']([^"\']+)["\'][^>]*>'
    return strip(F.coalesce(*[bind(F.regexp_extract(page, p, 1), empty_to_null) for p in (after, before)]))


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(values: pd.Series) -> pd.Series:
    return values.map(lambda items: [html.unescape(x) for x in items], na_action="ignore")


def _undo_json_escapes(text: Column) -> Column:
    """``\\n`` and ``\\t`` become blanks, ``\\"`` a quote; an escaped backslash is left alone until the end."""
    text = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for old, new in (('\\"', '"'), ("\\n", " "), ("\\t", " "), ("\\r", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.replace(text, F.lit("\0"), F.lit("\\"))


def _tidy(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(strip_tags(text), r"(?i)^\s*Abstract\s*:?\s*", ""))


def decode_texts(texts: Column) -> Column:
    """Entities of an array of texts; only arrays with other than the usual ones go to Python."""
    usual = F.transform(texts, lambda t: F.when(t.contains("&"), decode_common(t)).otherwise(t))
    return F.coalesce(_unescape_all(F.when(F.exists(texts, has_rare_entities), texts)), usual)


def clean_texts(texts: Column) -> Column:
    """Clean an array of extracted texts: JSON escapes, entities, tags, heading, white space."""
    plain = F.transform(texts, lambda t: bind(F.coalesce(t, F.lit("")), lambda x: F.when(x.contains("\\"), _undo_json_escapes(x)).otherwise(x)))
    return F.transform(decode_texts(plain), _tidy)


def is_highlights(text: Column) -> Column:
    """Bullet lists are no abstracts."""
    bullets = F.regexp_count(text, F.lit("[•●◆]"))
    ends = F.regexp_count(text, F.lit(r"\.\s|\.$"))
    return (text == "") | F.lower(text).startswith("highlights") | ((bullets > 2) & (bullets >= ends))


def _has_text(raw: Column) -> Column:
    """Whether anything is left after cleaning; only tags, coded tags, white space and the heading vanish."""
    tags = strip_tags(F.regexp_replace(F.regexp_replace(raw, "(?i)&lt;?|&#60;?|&#x3c;?", "<"), "(?i)&gt;?|&#62;?|&#x3e;?", ">"))
    spaces = F.regexp_replace(tags, r"&(?:nbsp|ensp|emsp|thinsp|Tab|NewLine|#(?:9|10|13|32|160)|#x(?:9|[aAdD]|20|[aA]0));?", " ")
    return _tidy(spaces) != ""


def _long_meta(page: Column, rules: Rules) -> Column:
    """First meta tag that is long enough as it is; later ones are not searched. One without any text does not count."""
    tries = [bind(meta_content(page, a, v), lambda m: F.when(F.length(m) >= MIN_ABSTRACT, m)) for a, v in rules.meta]
    return bind(F.coalesce(*tries), lambda m: F.when(_has_text(m), m))


def own_meta(page: Column, publisher: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, rules in PUBLISHERS.items():
        result = F.when(publisher == name, _long_meta(page, rules)).otherwise(result)
    return result


def generic_meta(page: Column) -> Column:
    return _long_meta(page, GENERIC)


def _selected(page: Column, rules: Rules) -> Column:
    return F.array(*[F.regexp_extract(page, "(?is)" + s, 1) for s in rules.selectors])


def rule_finds(page: Column, publisher: Column, own: Column, meta: Column) -> Column:
    """Raw finds in trial order as (is_meta, raw).

    A meta tag (``own`` publisher's, or the generic ones in ``meta`` after it) ends the trial, so the
    patterns that come after it are not run; a selector find is judged after cleaning.
    """
    none = F.array().cast("array<string>")
    selected, meta_first = none, F.lit(False)
    for name, rules in PUBLISHERS.items():
        selected = F.when(publisher == name, _selected(page, rules)).otherwise(selected)
        meta_first = meta_first | F.lit(not rules.selectors_first) & (publisher == name)
    last = F.when(page.rlike("(?i)abstract"), _selected(page, GENERIC)).otherwise(none)

    def tagged(finds: Column, is_meta: bool) -> Column:
        return F.transform(finds, lambda raw: F.struct(F.lit(is_meta).alias("is_meta"), raw.alias("raw")))

    found = tagged(F.array(meta), True)
    ends_first = meta_first & own.isNotNull()
    trial = F.when(ends_first, found).when(meta.isNotNull(), F.concat(tagged(selected, False), found)).otherwise(
        F.concat(tagged(selected, False), tagged(last, False))
    )
    return F.filter(trial, lambda f: F.length(f["raw"]) >= MIN_ABSTRACT)


def state_paragraphs(page: Column) -> Column:
    """Paragraphs of the author abstract in the embedded JSON (highlights blocks left out)."""
    content = F.regexp_extract(F.regexp_extract(page, STATE, 1), STATE_ABSTRACTS, 1)
    blocks = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(STATE_BLOCK), F.lit(1)).alias("body"),
        F.regexp_extract_all(content, F.lit(STATE_BLOCK), F.lit(2)).alias("kind"),
    )
    own = F.filter(blocks, lambda b: b["kind"] == "author")
    return F.flatten(F.transform(own, lambda b: F.regexp_extract_all(b["body"], F.lit(STATE_PARAGRAPH), F.lit(1))))


def joined_paragraphs(cleaned: Column) -> Column:
    text = F.array_join(F.filter(cleaned, lambda p: p != ""), "\n")
    return F.when(F.length(text) >= MIN_ABSTRACT, text)


# Parts of a page a model does not need, and where an abstract section starts.
PAGE_NOISE = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"(?is)<nav[^>]*>.*?</nav>",
    r"(?is)<header[^>]*>.*?</header>",
    r"(?is)<footer[^>]*>.*?</footer>",
)
OG_DESCRIPTION = (
    r'(?i)<meta[^>]*(?:property=["\']og:description["\'][^>]*content=["\']([^"\']+)["\']'
    r'|content=["\']([^"\']+)["\'][^>]*property=["\']og:description["\'])'
)
# the plain description is known in one order of its attributes only
DESCRIPTION = r'(?i)<meta[^>]*name=["\']description["\'][^>]*content=["\']([^"\']+)["\']'
SECTIONS = (
    r"<h2[^>]*>\s*Abstract\s*</h2>\s*(.*?)</div",
    r"<h2[^>]*>\s*Abstract\s*</h2>\s*<div[^>]*>(.*?)</div",
    r'id=["\']?abstracts?["\']?[^>]*>(.*?)</(?:div|section)',
    r'id=["\']?abstract-content["\']?[^>]*>(.*?)</(?:div|section)',
    r'class=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</(?:div|section|p)',
    r'class=["\'][^"\']*Abstract[^"\']*["\'][^>]*>(.*?)</(?:div|section|p)',
    r'data-title=["\']Abstract["\'][^>]*>(.*?)</section',
    r'<section[^>]*aria-labelledby=["\'][^"\']*abstract[^"\']*["\'][^>]*>(.*?)</section',
)


LEAD_DESCRIPTION, LEAD_SECTION = "The page describes itself as: ", "What looks like the abstract: "


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.left(text, F.lit(most))


def abstract_section(page: Column, most: int | None = None) -> Column:
    """The part of a page that looks like an abstract, with a lead-in for the model; null if none."""
    def found(pattern: str, group: int) -> Column:
        return bind(F.regexp_extract(page, pattern, group), empty_to_null)

    lead, section_lead = F.lit(LEAD_DESCRIPTION), F.lit(LEAD_SECTION)
    # none of the patterns can match a page without its word
    og = F.when(page.rlike("(?i)og:description"), strip(F.coalesce(found(OG_DESCRIPTION, 1), found(OG_DESCRIPTION, 2))))
    described = F.when(page.rlike("(?i)description"), strip(found(DESCRIPTION, 1)))
    tries = [
        bind(og, lambda text: F.when((F.length(text) > 200) & ~text.startswith("IEEE"), F.concat(lead, text))),
        bind(described, lambda text: F.when(F.length(text) > 200, F.concat(lead, text))),
    ]

    def section(text: Column) -> Column:
        usable = (F.length(text) > 100) & ~F.lower(text).contains("show more")
        return F.when(usable, F.concat(section_lead, _cut(text, most)))

    sections = [bind(collapse_spaces(strip_tags(F.regexp_extract(page, "(?is)" + pattern, 1))), section) for pattern in SECTIONS]
    return F.coalesce(*tries, F.when(page.rlike("(?i)abstract"), F.coalesce(*sections)))


def stripped_page(page: Column, most: int | None = None) -> Column:
    """Page without scripts, styles, comments and navigation, cut to the model's input size if there is one."""
    for pattern in PAGE_NOISE:
        page = F.regexp_replace(page, pattern, "")
    return _cut(one_space(page), most)


def shrink_page(page: Column, most_page: int | None = None, most_section: int | None = None) -> Column:
    return F.coalesce(abstract_section(page, most_section), stripped_page(page, most_page))
