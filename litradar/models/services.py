"""Summaries, translations, labels, interests, domains and overviews with a text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers, prompts
from ..functions.clock import moment
from ..functions.text import strip
from ..operators.joins import missing_from_store
from ..operators.ranking import first_per_group, numbered_batches
from ..operators.stats import venue_type
from .providers import Completer, complete_prompts

# Words of the insight request for parts without data, and for what is new.
NO_DATA = {
    "top_domains": "暂无领域分类数据",
    "top_authors": "暂无作者数据",
    "top_venues": "暂无期刊/会议数据",
    "top_keywords": "暂无关键词数据",
    "quarterly_trends": "近期无新增论文",
}
RECENT = ("- 近期新增论文：", "篇\n- 新增关键词：", "无明显新增")
UNKNOWN = "未知"


def summary_signature(provider: str, model: str = "") -> Column:
    """Changes with the provider, the model and the prompts; part of the store key."""
    parts = [provider, model, prompts.BULLET_SUMMARY, prompts.DETAILED_ANALYSIS]
    return F.sha2(F.concat_ws("\0", *[F.lit(p) for p in parts]), 256)


def summary_prompts(works: DataFrame) -> DataFrame:
    """Two requests per work: ``(paper_id, kind, prompt)``."""
    def one(kind: str, template: str) -> DataFrame:
        text = prompts.paper_prompt(template, F.col("title"), F.col("abstract"), F.col("authors"), F.col("venue"))
        return works.select(F.col("identifier").alias("paper_id"), F.lit(kind).alias("kind"), text.alias("prompt"))

    return one("bullets", prompts.BULLET_SUMMARY).unionByName(one("detailed", prompts.DETAILED_ANALYSIS))


def parse_summaries(replies: DataFrame) -> DataFrame:
    """Answers of both kinds to one row per paper with a status.

    ``failed``: a call failed or a required key is missing; ``ok`` otherwise (an answer that is
    no JSON gives the default texts).
    """
    def one(kind: str, parsed: Column, required: list[str], name: str) -> DataFrame:
        whole = F.lit(True)
        for field in required:
            whole = whole & F.col(name)[field].isNotNull()
        return replies.where(F.col("kind") == kind).withColumn(name, F.when(F.col("answer").isNotNull(), parsed)).select(
            "paper_id", name, F.coalesce(F.col("answer").isNotNull() & whole, F.lit(False)).alias(f"{name}_ok"),
            F.col("tokens_used").alias(f"{name}_tokens"), F.col("model_used").alias(f"{name}_model"),
        )

    short = one("bullets", answers.bullets(F.col("answer")), ["research_question", "methodology", "key_findings", "innovation"], "bullets")
    long = one("detailed", answers.detailed(F.col("answer")), ["background", "methodology_details", "results", "limitations", "relevance_to_interests"], "detailed")
    return short.join(long, "paper_id", "full").select(
        "paper_id", "bullets", "detailed", F.col("bullets_model").alias("model_used"),
        (F.coalesce("bullets_tokens", F.lit(0)) + F.coalesce("detailed_tokens", F.lit(0))).alias("tokens_used"),
        F.when(F.col("bullets_ok") & F.col("detailed_ok"), "ok").otherwise("failed").alias("status"),
    )


def summarize(works: DataFrame, stored: DataFrame, completer: Completer, as_of, force: bool = False) -> DataFrame:
    """New summary rows for works that have none in the store (all of them with ``force``)."""
    unique = works.dropDuplicates(["identifier"])
    todo = unique if force else missing_from_store(unique, stored.select(F.col("paper_id").alias("identifier")))
    replies = complete_prompts(summary_prompts(todo), completer, ["paper_id", "kind"])
    return parse_summaries(replies).withColumn("signature", summary_signature(completer.name)).withColumn("generated_at", moment(as_of))


def translation_prompts(todo: DataFrame, language: str = "zh-CN", batch: int = 5) -> DataFrame:
    """One request per batch of titles: ``(batch_no, prompt)``."""
    rows = numbered_batches(todo.withColumn("_all", F.lit(0)), ["_all"], [F.asc("identifier")], batch)
    line = F.concat("identifier", F.lit(": "), "title")
    return rows.groupBy("batch_no").agg(prompts.joined_lines(F.col("identifier"), line).alias("titles")).select(
        "batch_no", prompts.render(prompts.TITLE_TRANSLATION, target_language=F.lit(prompts.LANGUAGES.get(language, language)), titles_list=F.col("titles")).alias("prompt")
    )


def translate(works: DataFrame, stored: DataFrame, completer: Completer, as_of, language: str = "zh-CN", batch: int = 5) -> DataFrame:
    """New translation rows for titles the store lacks in this language."""
    known = stored.where(F.col("target_language") == language).select(F.col("paper_id").alias("identifier"))
    todo = missing_from_store(works.select("identifier", "title").dropDuplicates(["identifier"]), known)
    replies = complete_prompts(translation_prompts(todo, language, batch), completer, ["batch_no"])
    pairs = replies.where("answer IS NOT NULL").select(F.explode(answers.translations(F.col("answer"))).alias("t"), "model_used")
    return pairs.select(F.col("t.id").alias("identifier"), F.col("t.translated").alias("translated_title"), "model_used").join(todo, "identifier").select(
        F.col("identifier").alias("paper_id"), F.lit(language).alias("target_language"), F.col("title").alias("original_title"),
        "translated_title", "model_used", moment(as_of).alias("generated_at"),
    ).dropDuplicates(["paper_id"])


def cluster_label_prompts(clusters: DataFrame) -> DataFrame:
    """One request per profile over its clusters without a label (a few dozen at most)."""
    todo = clusters.where(answers.needs_label(F.col("label")))
    placed = todo.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy("cluster_id")))
    entry = prompts.cluster_entry(F.col("position"), F.col("member_count"), F.col("titles"), F.col("keywords"))
    return placed.groupBy("profile_id").agg(
        prompts.joined_lines(F.col("position"), entry, "\n\n").alias("info"), F.count("*").cast("int").alias("expected"),
        F.array_sort(F.collect_list(F.col("cluster_id"))).alias("cluster_ids"),
    ).select("profile_id", "expected", "cluster_ids", prompts.render(prompts.CLUSTER_LABELS, clusters_info=F.col("info")).alias("prompt"))


def label_clusters(clusters: DataFrame, completer: Completer) -> DataFrame:
    """``(profile_id, cluster_id, label)`` for unlabelled clusters; the fallback name where the call failed."""
    requests = cluster_label_prompts(clusters)
    replies = complete_prompts(requests, completer, ["profile_id"], max_tokens=500).join(requests.select("profile_id", "expected", "cluster_ids"), "profile_id")
    named = replies.where("answer IS NOT NULL").select(
        "profile_id", F.explode(F.arrays_zip("cluster_ids", answers.cluster_labels(F.col("answer"), F.col("expected")).alias("names"))).alias("x")
    ).select("profile_id", F.col("x.cluster_ids").alias("cluster_id"), F.col("x.names").alias("named"))
    todo = clusters.where(answers.needs_label(F.col("label")))
    return todo.join(named, ["profile_id", "cluster_id"], "left").select(
        "profile_id", "cluster_id",
        F.coalesce("named", answers.fallback_label(F.col("keywords"), F.col("titles"), F.col("cluster_id"))).alias("label"),
    )


def refine_interests(interests: DataFrame, completer: Completer) -> DataFrame:
    """``(profile_id, description)`` to query and keywords; blank descriptions are left out."""
    asked = interests.where(strip(F.col("description")) != "").select(
        "profile_id", prompts.render(prompts.INTEREST_REFINEMENT, user_interests=F.col("description")).alias("prompt")
    )
    replies = complete_prompts(asked, completer, ["profile_id"]).where("answer IS NOT NULL")
    return replies.select("profile_id", answers.interests(F.col("answer")).alias("r")).select("profile_id", "r.*")


def domain_prompts(items: DataFrame, max_papers: int = 200, max_domains: int = 10) -> DataFrame:
    """One request per profile over its first papers: ``items(profile_id, key, title, tags)``."""
    first = first_per_group(items, ["profile_id"], [F.asc("key")], max_papers)
    line = prompts.classification_line(F.col("position"), F.col("title"), F.col("tags"))
    return first.groupBy("profile_id").agg(prompts.joined_lines(F.col("position"), line, "\n\n").alias("papers"), F.count("*").alias("n")).select(
        "profile_id", prompts.render(prompts.DOMAIN_CLASSIFICATION, paper_count=F.col("n"), max_domains=F.lit(max_domains), papers_list=F.col("papers")).alias("prompt")
    )


def domain_shares(replies: DataFrame, totals: DataFrame) -> DataFrame:
    """Domains with their share of the whole library: ``replies(profile_id, answer)``, ``totals(profile_id, total_papers)``."""
    rows = replies.where("answer IS NOT NULL").select("profile_id", F.explode(answers.domains(F.col("answer"))).alias("d"))
    return rows.join(totals, "profile_id").select(
        "profile_id", "d.domain", "d.paper_count", "d.sample_titles",
        F.when(F.col("total_papers") > 0, F.col("d.paper_count") / F.col("total_papers") * 100).otherwise(F.lit(0.0)).alias("percentage"),
    )


def classify_domains(items: DataFrame, completer: Completer, max_papers: int = 200, max_domains: int = 10) -> DataFrame:
    replies = complete_prompts(domain_prompts(items, max_papers, max_domains), completer, ["profile_id"])
    return domain_shares(replies, items.groupBy("profile_id").agg(F.count("*").alias("total_papers")))


def insight_prompts(stats: dict[str, DataFrame], domains: DataFrame) -> DataFrame:
    """One request per profile from its statistics; every list is cut to a fixed length first."""
    def listed(frame: DataFrame, line: Column, n: int, name: str, order: list[Column] | None = None, separator: str = "\n") -> DataFrame:
        top = first_per_group(frame, ["profile_id"], order or [F.asc("rank")], n)
        return top.groupBy("profile_id").agg(prompts.joined_lines(F.col("position"), line, separator).alias(name))

    quarters = first_per_group(stats["quarters"], ["profile_id"], [F.desc("quarter")], 12, "back").where("paper_count > 0")
    parts = [
        listed(domains, prompts.domain_line(F.col("domain"), F.col("paper_count"), F.col("percentage")), 5, "top_domains", [F.desc("paper_count"), F.asc("domain")]),
        listed(stats["authors"], prompts.stat_line(F.col("author"), F.col("paper_count")), 10, "top_authors"),
        listed(stats["venues"], prompts.stat_line(F.col("venue"), F.col("paper_count"), venue_type(F.col("venue"))), 10, "top_venues"),
        listed(stats["keywords"], F.concat("tag", F.lit("("), F.col("tag_count").cast("string"), F.lit(")")), 20, "top_keywords", separator=", "),
        listed(quarters, prompts.stat_line(F.col("quarter"), F.col("paper_count")), 12, "quarterly_trends", [F.asc("quarter")]),
        listed(stats["new_keywords"], F.col("tag"), 5, "new_tags", separator=", "),
    ]
    joined = stats["overview"]
    for part in parts:
        joined = joined.join(part, "profile_id", "left")
    recent = F.concat(F.lit(RECENT[0]), F.col("recent_count").cast("string"), F.lit(RECENT[1]), F.coalesce("new_tags", F.lit(RECENT[2])))
    values = {name: F.coalesce(F.col(name), F.lit(text)) for name, text in NO_DATA.items()}
    return joined.select("profile_id", prompts.render(
        prompts.LIBRARY_INSIGHTS, total_papers=F.col("total_papers"), collection_duration=F.coalesce("duration", F.lit(UNKNOWN)),
        year_range=F.concat(F.col("first_year").cast("string"), F.lit("-"), F.col("last_year").cast("string")), recent_analysis=recent, **values,
    ).alias("prompt"))


def generate_insights(stats: dict[str, DataFrame], domains: DataFrame, completer: Completer) -> DataFrame:
    replies = complete_prompts(insight_prompts(stats, domains), completer, ["profile_id"]).where("answer IS NOT NULL")
    return replies.select("profile_id", answers.insights(F.col("answer")).alias("i")).select("profile_id", "i.*")


def overview_prompts(works: DataFrame, section: str, max_papers: int = 10) -> DataFrame:
    """One request per profile over the first works of a section; the rest is only counted."""
    sizes = works.groupBy("profile_id").agg(F.count("*").alias("n"))
    first = first_per_group(works, ["profile_id"], [F.asc("rank")], max_papers)
    line = prompts.overview_line(F.col("position"), F.col("title"), F.col("abstract"))
    listed = first.groupBy("profile_id").agg(prompts.joined_lines(F.col("position"), line, "\n\n").alias("papers")).join(sizes, "profile_id")
    more = F.when(F.col("n") > max_papers, F.concat(F.lit("\n\n...还有 "), (F.col("n") - max_papers).cast("string"), F.lit(" 篇论文"))).otherwise("")
    return listed.select("profile_id", F.col("n").alias("paper_count"), prompts.render(
        prompts.SECTION_OVERVIEW, paper_count=F.col("n"), section_type=F.lit(prompts.SECTIONS[section]), papers_list=F.concat("papers", more),
    ).alias("prompt"))


def summarize_section(works: DataFrame, section: str, completer: Completer) -> DataFrame:
    requests = overview_prompts(works, section)
    replies = complete_prompts(requests, completer, ["profile_id", "paper_count"]).where("answer IS NOT NULL")
    return replies.select(
        "profile_id", F.lit(section).alias("section_type"), "paper_count", answers.overview(F.col("answer"), F.col("paper_count")).alias("o"), "model_used", "tokens_used"
    ).select("profile_id", "section_type", "paper_count", "o.*", "model_used", "tokens_used")
