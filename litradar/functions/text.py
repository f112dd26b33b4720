"""Text expressions: normalisation, hashing, embedding text, HTML cleanup."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# every kind of white space; the wide ones sit in one range, so that most texts pass one cheap test
_LATIN = r" \t-\r\x1c-\x1f\x85\xa0"
_WIDE = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WIDE_RANGE = r"[\u1680-\u3000]"
_ALL = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(_ALL))


def one_space(c: Column) -> Column:
    """Runs of white space become one blank."""
    plain = bind(c, lambda x: F.when(x.rlike(_WIDE_RANGE), F.regexp_replace(x, _WIDE, " ")).otherwise(x))
    return F.regexp_replace(plain, f"[{_LATIN}]+", " ")


def collapse_spaces(c: Column) -> Column:
    return F.trim(one_space(c))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a costly value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_identifier(c: Column) -> Column:
    """Lower-cased and stripped; null becomes empty."""
    return strip(F.lower(F.coalesce(c, F.lit(""))))


def normalize_doi(c: Column) -> Column:
    """As ``normalize_identifier`` but null for a missing or blank DOI, so that it never matches."""
    return empty_to_null(normalize_identifier(c))


def normalize_title(c: Column) -> Column:
    return F.lower(collapse_spaces(F.coalesce(c, F.lit(""))))


def clean_title(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


# The usual entities; the ampersand comes last, so that nothing is decoded twice.
COMMON_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#34", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\u00a0"), ("#160", "\u00a0"), ("amp", "&"))
_COMMON = "&(?:" + "|".join(name for name, _ in COMMON_ENTITIES) + ");"


def has_rare_entities(c: Column) -> Column:
    """Whether an ampersand is left that does not belong to a usual entity."""
    return c.contains("&") & F.regexp_replace(c, _COMMON, "").contains("&")


def decode_common(c: Column) -> Column:
    for name, char in COMMON_ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def unescape(c: Column) -> Column:
    """Decode entities. Only texts with other than the usual ones are sent to Python."""
    return F.coalesce(_unescape(F.when(has_rare_entities(c), c)), F.when(c.contains("&"), decode_common(c)).otherwise(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def clean_html(c: Column) -> Column:
    """Entities are decoded before tags go, so an escaped tag vanishes too; empty becomes null."""
    return empty_to_null(collapse_spaces(strip_tags(unescape(c))))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the non-empty parts; a NUL goes before each but the first position."""
    pieces = []
    for i, part in enumerate(parts):
        part = F.coalesce(part, F.lit(""))
        if i > 0:
            part = F.when(part == "", "").otherwise(F.concat(F.lit("\0"), part))
        pieces.append(part)
    return F.sha2(F.concat(*pieces), 256)


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")))


def encodable_text(c: Column) -> Column:
    """Providers refuse empty input."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit("[untitled]")).otherwise(c)


def person_name(first: Column, last: Column) -> Column:
    return strip(F.concat_ws(" ", empty_to_null(first), empty_to_null(last)))


def drop_blank(names: Column) -> Column:
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def keep_tags(tags: Column, excluded: Sequence[str]) -> Column:
    """Drop excluded tags (compared stripped) and missing ones; kept tags stay as they are."""
    banned = sorted({t.strip() for t in excluded if t and t.strip()})
    present = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    if not banned:
        return present
    return F.filter(present, lambda t: ~strip(t).isin(*banned))


def truncate_values(values: Column, max_len: int = 80) -> Column:
    """Cut long values of a string map."""
    return F.transform_values(
        values, lambda _, v: F.when(F.length(v) > max_len, F.concat(F.left(v, F.lit(max_len)), F.lit("..."))).otherwise(v)
    )


# Titles of journal pages that are no articles (matched without case, anywhere in the stripped title).
NON_ARTICLE_TITLES = (
    r"^table of contents$",
    r"^masthead$",
    r"^editorial board$",
    r"^errat(a|um)$",
    r"^correction(s)?$",
    r"^retraction$",
    r"^connect\. support\. inspire\.$",
    r"information for authors",
    r"publication information",
    r"author guidelines",
    r"instructions for authors",
    r"guide for authors",
    r"^ieee transactions on [a-z\s]+$",
    r"^ieee journal of [a-z\s]+$",
    r"^proceedings of the ieee$",
    r"^ieee [a-z\s]+ magazine$",
)


def is_non_article(title: Column, venue: Column) -> Column:
    stripped = strip(F.coalesce(title, F.lit("")))
    patterns = "(?i)" + "|".join(f"(?:{p})" for p in NON_ARTICLE_TITLES)
    same_as_venue = F.coalesce((venue != "") & (F.lower(stripped) == F.lower(venue)), F.lit(False))
    return F.coalesce(title, F.lit("")).eqNullSafe("") | stripped.rlike(patterns) | same_as_venue
