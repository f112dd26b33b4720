"""Prompt texts. A template is a plain string with ``{names}`` filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_ONLY = "Answer with one JSON object and nothing else."

BULLET_SUMMARY = (
    "Summarise this paper in Chinese, one sentence of at most 50 characters per key.\n\n"
    "Title: {title}\nAbstract: {abstract}\nAuthors: {authors}\nVenue: {venue}\n\n"
    "Keys: research_question, methodology, key_findings, innovation, relevance_note.\n" + _JSON_ONLY
)
DETAILED_ANALYSIS = (
    "Analyse this paper in Chinese, two to four sentences per key.\n\n"
    "Title: {title}\nAbstract: {abstract}\nAuthors: {authors}\nVenue: {venue}\n\n"
    "Keys: background, methodology_details, results, limitations, future_directions, relevance_to_interests.\n" + _JSON_ONLY
)
INTEREST_REFINEMENT = (
    "Turn this description of research interests into a search query for papers.\n\n{user_interests}\n\n"
    "Keys: refined_query (English, 50 to 100 words), include_keywords (5 to 10 terms), exclude_keywords "
    "(only topics the description rules out itself, else an empty list).\n" + _JSON_ONLY
)
SECTION_OVERVIEW = (
    "Group these {paper_count} papers ({section_type}) by topic, in Chinese.\n\n{papers_list}\n\n"
    "Keys: overview (one sentence with the number of papers per topic), topics (list of topic_name, paper_count, "
    "description; put paper names in 《》).\n" + _JSON_ONLY
)
DOMAIN_CLASSIFICATION = (
    "Sort these {paper_count} papers into at most {max_domains} research domains with short Chinese names, "
    "at least two papers each.\n\n{papers_list}\n\nKey: domains (list of domain, paper_count, sample_titles with three titles).\n" + _JSON_ONLY
)
LIBRARY_INSIGHTS = (
    "These are statistics of what a researcher collects and reads, not of what they publish. Describe their interests in Chinese.\n\n"
    "Papers: {total_papers}\nCollected over: {collection_duration}\nPublication years: {year_range}\n\n"
    "Domains:\n{top_domains}\n\nAuthors:\n{top_authors}\n\nVenues:\n{top_venues}\n\nKeywords:\n{top_keywords}\n\n"
    "Papers per quarter:\n{quarterly_trends}\n\nRecently added:\n{recent_analysis}\n\n"
    "Keys: research_focus_summary, strength_areas, interdisciplinary_notes, trend_observations, recommendations.\n" + _JSON_ONLY
)
TITLE_TRANSLATION = (
    "Translate these paper titles into {target_language}; keep proper names and model names as they are. "
    'Each line is "ID: title".\n\n{titles_list}\n\nKey: translations (list of id, translated).\n' + _JSON_ONLY
)
CLUSTER_LABEL = "Name the common research topic in Chinese, at most 10 words, and answer with the name only.\n\nTitles:\n{titles}\n\nKeywords: {keywords}"
CLUSTER_LABELS = (
    "Name the research topic of each cluster in Chinese, at most 10 words each.\n\n{clusters_info}\n\n"
    "Answer with a JSON list of strings in the same order and nothing else."
)
PAGE_ABSTRACT = (
    "Copy the abstract from this page of a paper: plain text, all paragraphs, without a heading. "
    'If there is none, answer "NOT_FOUND".\n\n{html}'
)

# Language names by code.
LANGUAGES = {"zh-CN": "简体中文", "zh-TW": "繁体中文", "ja": "日语", "ko": "韩语", "de": "德语", "fr": "法语", "es": "西班牙语"}
# Section names.
# Words of the listed lines.
LINE_ABSTRACT, LINE_TAGS, NO_TAGS, PAPERS = "摘要片段：", "标签：", "无标签", "篇"
SECTIONS = {"interest": "精选推荐", "similarity": "相似度推荐"}


def render(template: str, **values: Column) -> Column:
    """Fill a template; a null value becomes empty."""
    parts = [
        F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")) if re.fullmatch(r"\{\w+\}", piece) else F.lit(piece)
        for piece in re.split(r"(\{\w+\})", template) if piece
    ]
    return F.concat(*parts)


def _or(text: Column, default: str) -> Column:
    return F.coalesce(F.when(text != "", text), F.lit(default))


def paper_prompt(template: str, title: Column, abstract: Column, authors: Column, venue: Column) -> Column:
    """Bullet or detailed prompt of one paper; the first five authors are named."""
    names = F.array_join(F.slice(authors, 1, 5), ", ")
    return render(template, title=title, abstract=_or(abstract, "No abstract available"), authors=_or(names, "Unknown"), venue=_or(venue, "Unknown"))


def overview_line(position: Column, title: Column, abstract: Column) -> Column:
    """Numbered entry with the first 200 characters of the abstract."""
    text = F.coalesce(abstract, F.lit(""))
    return F.concat(position.cast("string"), F.lit(". "), title, F.lit("\n   " + LINE_ABSTRACT), F.left(text, F.lit(200)),
                    F.when(F.length(text) > 200, "...").otherwise(""))


def classification_line(position: Column, title: Column, tags: Column) -> Column:
    """Numbered entry with up to five tags."""
    return F.concat(position.cast("string"), F.lit(". "), title, F.lit("\n   " + LINE_TAGS), _or(F.array_join(F.slice(tags, 1, 5), ", "), NO_TAGS))


def cluster_entry(position: Column, member_count: Column, titles: Column, keywords: Column) -> Column:
    quoted = F.array_join(F.transform(F.slice(titles, 1, 3), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    return F.concat(F.lit("Cluster "), position.cast("string"), F.lit(" ("), member_count.cast("string"), F.lit(" papers):\n  Titles: "), quoted,
                    F.lit("\n  Keywords: "), _or(F.array_join(F.slice(keywords, 1, 5), ", "), "N/A"))


def stat_line(name: Column, count: Column, kind: Column | None = None) -> Column:
    middle = F.lit("") if kind is None else F.concat(F.lit(" ["), kind, F.lit("]"))
    return F.concat(F.lit("- "), name, middle, F.lit(": "), count.cast("string"), F.lit(PAPERS))


def domain_line(domain: Column, count: Column, percent: Column) -> Column:
    return F.concat(F.lit("- "), domain, F.lit(": "), count.cast("string"), F.lit(PAPERS + " ("), F.format_string("%.1f", percent), F.lit("%)"))


def joined_lines(position: Column, line: Column, separator: str = "\n") -> Column:
    """Aggregate: the lines of a group in order. The caller limits the group with a row number first."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), line.alias("l")))), lambda x: x["l"]), separator)
