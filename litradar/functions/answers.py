"""Model answers: strip the code fence, parse by contract, fall back on failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The JSON contracts.
BULLETS = "research_question string, methodology string, key_findings string, innovation string, relevance_note string"
DETAILED = "background string, methodology_details string, results string, limitations string, future_directions string, relevance_to_interests string"
INTERESTS = "refined_query string, include_keywords array<string>, exclude_keywords array<string>"
OVERVIEW = "overview string, topics array<struct<topic_name:string,paper_count:bigint,description:string>>"
DOMAINS = "domains array<struct<domain:string,paper_count:bigint,sample_titles:array<string>>>"
INSIGHTS = "research_focus_summary string, strength_areas string, interdisciplinary_notes string, trend_observations string, recommendations string"
TITLES = "translations array<struct<id:string,translated:string>>"
INSIGHT_FIELDS = ("research_focus_summary", "strength_areas", "interdisciplinary_notes", "trend_observations", "recommendations")
NO_ANALYSIS = "暂无分析"
ANALYSIS_FAILED = "分析生成失败，请重试。"
UNNAMED = "未命名"


def unfence(answer: Column) -> Column:
    """Text between the first pair of code fences, without a ``json`` tag."""
    text = strip(answer)
    inner = F.get(F.split(text, "```"), F.lit(1))
    return F.when(text.startswith("```"), strip(F.regexp_replace(inner, "^json", ""))).otherwise(text)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse(answer: Column, contract: str) -> Column:
    """Struct of the contract; null when the answer is no JSON."""
    text = unfence(answer)
    return F.when(is_json(text), F.from_json(text, contract))


def _with_defaults(parsed: Column, defaults: dict[str, Column]) -> Column:
    return F.struct(*[F.when(parsed.isNull(), d).otherwise(parsed[n]).alias(n) for n, d in defaults.items()])


# What callers find where an answer could not be read.
UNREAD = {
    "research_question": "Unable to extract research question",
    "methodology": "Unable to extract methodology",
    "key_findings": "Unable to extract findings",
    "innovation": "Unable to extract innovation",
    "background": "Unable to extract background",
    "methodology_details": "Unable to extract methodology details",
    "results": "Unable to extract results",
    "limitations": "Unable to extract limitations",
    "relevance_to_interests": "Unable to determine relevance",
}
OVERVIEW_UNREAD = ("本期共推荐 ", " 篇论文。")


def bullets(answer: Column) -> Column:
    text = unfence(answer)
    return _with_defaults(parse(answer, BULLETS), {
        **{name: F.lit(UNREAD[name]) for name in ("research_question", "methodology", "key_findings", "innovation")},
        "relevance_note": F.when(text != "", F.left(text, F.lit(200))),
    })


def detailed(answer: Column) -> Column:
    text = unfence(answer)
    return _with_defaults(parse(answer, DETAILED), {
        **{name: F.lit(UNREAD[name]) for name in ("background", "methodology_details", "results", "limitations")},
        "future_directions": F.lit(None).cast("string"),
        "relevance_to_interests": F.when(text != "", F.left(text, F.lit(200))).otherwise(F.lit(UNREAD["relevance_to_interests"])),
    })


def interests(answer: Column) -> Column:
    parsed, none = parse(answer, INTERESTS), F.array().cast("array<string>")
    query = F.when(parsed.isNull(), F.left(unfence(answer), F.lit(500))).otherwise(F.coalesce(parsed["refined_query"], F.lit("")))
    return F.struct(
        query.alias("refined_query"), F.coalesce(parsed["include_keywords"], none).alias("include_keywords"),
        F.coalesce(parsed["exclude_keywords"], none).alias("exclude_keywords"),
    )


def overview(answer: Column, paper_count: Column) -> Column:
    parsed = parse(answer, OVERVIEW)
    fallback = F.concat(F.lit(OVERVIEW_UNREAD[0]), paper_count.cast("string"), F.lit(OVERVIEW_UNREAD[1]))
    topics = F.transform(
        F.coalesce(parsed["topics"], F.array().cast("array<struct<topic_name:string,paper_count:bigint,description:string>>")),
        lambda t: F.struct(F.coalesce(t["topic_name"], F.lit(UNNAMED)).alias("topic_name"),
                           F.coalesce(t["paper_count"], F.lit(0).cast("long")).alias("paper_count"),
                           F.coalesce(t["description"], F.lit("")).alias("description")),
    )
    return F.struct(F.when(parsed.isNull(), fallback).otherwise(F.coalesce(parsed["overview"], F.lit(""))).alias("overview"), topics.alias("topics"))


def domains(answer: Column) -> Column:
    """Array of (domain, paper_count, sample_titles); empty on failure."""
    parsed = parse(answer, DOMAINS)
    return F.transform(
        F.coalesce(parsed["domains"], F.array().cast("array<struct<domain:string,paper_count:bigint,sample_titles:array<string>>>")),
        lambda d: F.struct(
            F.coalesce(d["domain"], F.lit(UNNAMED)).alias("domain"), F.coalesce(d["paper_count"], F.lit(0).cast("long")).alias("paper_count"),
            F.slice(F.coalesce(d["sample_titles"], F.array().cast("array<string>")), 1, 3).alias("sample_titles"),
        ),
    )


def insights(answer: Column) -> Column:
    parsed = parse(answer, INSIGHTS)
    return F.struct(*[
        F.when(parsed.isNull(), F.lit(ANALYSIS_FAILED)).otherwise(F.coalesce(parsed[n], F.lit(NO_ANALYSIS))).alias(n) for n in INSIGHT_FIELDS
    ])


def translations(answer: Column) -> Column:
    """Array of (id, translated), incomplete entries dropped; empty on failure."""
    parsed = parse(answer, TITLES)
    pairs = F.coalesce(parsed["translations"], F.array().cast("array<struct<id:string,translated:string>>"))
    return F.filter(pairs, lambda t: (t["id"] != "") & (t["translated"] != ""))


def _unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["']+|["']+$""", "")


def cluster_labels(answer: Column, expected: Column) -> Column:
    """Labels for ``expected`` clusters: a JSON list of that length, else one per line, padded."""
    text = F.regexp_replace(F.regexp_replace(strip(answer), r"^```(?:json)?\n?", ""), r"\n?```$", "")
    text = F.when(strip(answer).startswith("```"), text).otherwise(strip(answer))
    parsed = F.transform(F.from_json(F.when(is_json(text), text), "array<string>"), _unquote)
    complete = (F.size(parsed) == expected) & ~F.exists(parsed, lambda x: F.coalesce(x, F.lit("")) == "")
    lines = F.transform(F.split(text, "\n"), lambda x: _unquote(strip(F.regexp_replace(strip(x), r"^[\d\.\-\*\s]+", ""))))
    lines = F.slice(F.filter(lines, lambda x: x != ""), F.lit(1), expected)
    padding = F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda i: F.concat(F.lit("聚类 "), i.cast("string")))
    padded = F.slice(F.concat(lines, F.slice(padding, F.size(lines) + 1, expected)), F.lit(1), expected)
    return F.when(F.coalesce(complete, F.lit(False)), parsed).otherwise(padded)


def fallback_label(keywords: Column, titles: Column, cluster_id: Column) -> Column:
    """First keyword, else the start of the first title, else a numbered name."""
    return F.coalesce(F.get(keywords, F.lit(0)), F.left(F.get(titles, F.lit(0)), F.lit(30)), F.concat(F.lit("聚类 "), cluster_id.cast("string")))


def needs_label(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).eqNullSafe("") | label.rlike(r"^聚类 \d+$")
