"""Feed texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import iso_format, moment, rfc822


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_xml(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def score_text(score: Column) -> Column:
    """Three decimals, ties to even."""
    return F.format_string("%.3f", F.bround(score, 3))


def description(abstract: Column, published: Column, venue: Column, score: Column, label: Column) -> Column:
    """Plain text for simple readers; a missing abstract leaves its line out."""
    return F.concat_ws(
        "\n", F.when(abstract != "", abstract),
        F.concat(F.lit("Published: "), F.coalesce(iso_format(published), F.lit("Unknown"))),
        F.concat(F.lit("Venue: "), F.coalesce(F.when(venue != "", venue), F.lit("Unknown"))),
        F.concat(F.lit("Score: "), score_text(score), F.lit(" ("), label, F.lit(")")),
    )


def content(authors: Column, venue: Column, doi: Column, score: Column, label: Column, abstract: Column) -> Column:
    """HTML paragraphs; absent parts are left out."""

    def paragraph(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<p><strong>{name}:</strong> "), value, F.lit("</p>"))

    link = escape_html(doi)
    return F.concat_ws(
        "\n", F.when(F.size(authors) > 0, paragraph("Authors", escape_html(F.array_join(authors, "; ")))),
        F.when(venue != "", paragraph("Journal", escape_html(venue))),
        F.when(doi != "", paragraph("DOI", F.concat(F.lit('<a href="https://doi.org/'), link, F.lit('">'), link, F.lit("</a>")))),
        paragraph("Relevance", F.concat(score_text(score), F.lit(" ("), label, F.lit(")"))),
        F.when(abstract != "", F.concat(F.lit("<p>"), escape_html(abstract), F.lit("</p>"))),
    )


def publication_date(published: Column, as_of) -> Column:
    return rfc822(F.coalesce(published, moment(as_of)))
