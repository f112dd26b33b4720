"""Fill missing abstracts from the store and from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..models.providers import Completer, complete_prompts
from ..operators.extraction import as_store_rows, extract_abstracts, model_requests, with_answers
from ..operators.filters import abstract_route
from ..operators.joins import fill_abstracts
from ..operators.stats import enrichment_stats
from ..session import cut_lineage
from ..sources.stores import live


def extract_with_fallback(pages: DataFrame, completer: Completer | None = None) -> DataFrame:
    """Rules first; a text model for the pages they miss. ``pages(doi, title, url, html)``."""
    extracted = extract_abstracts(pages)
    if completer is None:
        return extracted
    # materialised: it feeds both the requests and the result
    extracted = cut_lineage(extracted)
    asked = model_requests(extracted)
    lead = F.when(F.col("title") != "", F.concat(F.lit("Paper title: "), "title", F.lit("\n\n"))).otherwise("")
    requests = asked.select("doi", F.concat(lead, prompts.render(prompts.PAGE_ABSTRACT, html=F.col("content"))).alias("prompt"))
    replies = cut_lineage(complete_prompts(requests, completer, ["doi"]))
    return with_answers(extracted, replies)


def enrich(candidates: DataFrame, store: DataFrame, pages: DataFrame, as_of, completer: Completer | None = None) -> dict[str, DataFrame]:
    """Enriched candidates, counters and new store rows. Pages of known DOIs are not parsed."""
    cached = live(store, as_of).select("doi", "abstract")
    wanted = candidates.where(abstract_route() == "needs_abstract").select(F.lower("doi").alias("doi")).distinct().join(
        cached.where("abstract <> ''").select(F.lower("doi").alias("doi")), "doi", "left_anti"
    )
    todo = pages.withColumn("doi", F.lower("doi")).join(wanted, "doi", "left_semi")
    fresh = extract_with_fallback(todo, completer)
    rows = cut_lineage(as_store_rows(fresh, as_of).dropDuplicates(["doi"]))
    filled = fill_abstracts(candidates, cached, rows.select("doi", "abstract"))
    return {"candidates": filled, "stats": enrichment_stats(filled), "new_store_rows": rows}
