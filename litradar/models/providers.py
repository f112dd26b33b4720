"""Plug-in points for embedding, rerank and text models, and local stand-ins.

A provider is a small picklable object that is shipped to the tasks. Requests go out in batches from as
many tasks as their input has, or from ``concurrency`` tasks where a service allows only so many callers.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import encodable_text
from ..operators.skew import MOST_HOT_KEYS, hot_keys, skew_join


class Embedder(Protocol):
    name: str
    dimensions: int

    def encode(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray: ...


class Reranker(Protocol):
    max_documents: int

    def rerank(self, query: str, documents: Sequence[str]) -> Sequence[float]: ...


class Completer(Protocol):
    name: str

    def complete(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> tuple[str, int]: ...


_WORD = re.compile(r"\w+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class HashingEmbedder:
    """Stand-in: hashed word counts."""

    name = "hashing"

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def encode(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in _words(text) or [text]:
                out[row, zlib.crc32(word.encode()) % self.dimensions] += 1.0
        return out


class OverlapReranker:
    """Stand-in: cosine of word sets."""

    max_documents = 1000

    def rerank(self, query: str, documents: Sequence[str]) -> Sequence[float]:
        wanted = set(_words(query))
        scores = []
        for text in documents:
            words = set(_words(text))
            scores.append(len(wanted & words) / np.sqrt(len(wanted) * len(words)) if wanted and words else 0.0)
        return scores


class EchoCompleter:
    """Stand-in: answers each contract with values taken from the prompt."""

    name = "echo"

    def complete(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> tuple[str, int]:
        keys = re.search(r"Keys?: (.*)", prompt)
        title = re.search(r"Title: (.*)", prompt)
        seed = title.group(1) if title else prompt
        if "translations (list" in prompt:
            lines = re.findall(r"^(\S+): (.*)$", prompt.split("\n\n", 1)[1].rsplit("\n\nKey", 1)[0], re.M)
            answer = json.dumps({"translations": [{"id": i, "translated": f"译 {t}"} for i, t in lines]}, ensure_ascii=False)
        elif "JSON list of strings" in prompt:
            answer = json.dumps([f"主题 {n}" for n in re.findall(r"^Cluster (\d+)", prompt, re.M)], ensure_ascii=False)
        elif "domains (list" in prompt:
            answer = json.dumps({"domains": [{"domain": "综合", "paper_count": len(re.findall(r"^\d+\. ", prompt, re.M)), "sample_titles": []}]}, ensure_ascii=False)
        elif "topics (list" in prompt:
            answer = json.dumps({"overview": seed, "topics": []}, ensure_ascii=False)
        elif "refined_query" in prompt:
            text = prompt.split("\n\n")[1]
            answer = json.dumps({"refined_query": text, "include_keywords": _words(text)[:5], "exclude_keywords": []}, ensure_ascii=False)
        elif "NOT_FOUND" in prompt:
            answer = "NOT_FOUND"
        elif keys:
            names = [k.strip(" .") for k in re.sub(r"\(.*?\)", "", keys.group(1)).split(",")]
            answer = json.dumps({k: f"{k}: {seed}" for k in names}, ensure_ascii=False)
        else:
            answer = seed
        return f"```json\n{answer}\n```" if answer.startswith("{") else answer, len(prompt.split())


def _spread(rows: DataFrame, concurrency: int | None) -> DataFrame:
    return rows if concurrency is None else rows.repartition(concurrency)


def encode_texts(texts: DataFrame, embedder: Embedder, input_type: str = "document", batch_rows: int = 128, concurrency: int | None = None) -> DataFrame:
    """``(content_hash, text)`` to unit vectors ``(content_hash, embedding)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at : at + batch_rows]
                vectors = np.asarray(embedder.encode(part["text"].tolist(), input_type), dtype=np.float64)
                vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12)
                yield pd.DataFrame({"content_hash": part["content_hash"].to_numpy(), "embedding": list(vectors.astype(np.float32))})

    ready = texts.select("content_hash", encodable_text(F.col("text")).alias("text"))
    return _spread(ready, concurrency).mapInPandas(run, "content_hash string, embedding array<float>")


def complete_prompts(requests: DataFrame, completer: Completer, keys: Sequence[str], max_tokens: int = 1024, temperature: float = 0.3,
                     concurrency: int | None = None) -> DataFrame:
    """``(keys…, prompt)`` to ``(keys…, answer, tokens_used, model_used, error)``.

    A failed call gives a null answer and its message; the caller writes the result before using
    it, so that a repeated stage does not pay again.
    """
    fields = [f for f in requests.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", answer string, tokens_used long, model_used string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                try:
                    text, tokens = completer.complete(prompt, max_tokens, temperature)
                    out.append((text, tokens, None))
                except Exception as exc:  # a provider may raise anything
                    out.append((None, 0, str(exc)))
            result = pdf[[f.name for f in fields]].copy()
            result["answer"] = [o[0] for o in out]
            result["tokens_used"] = [o[1] for o in out]
            result["model_used"] = completer.name
            result["error"] = [o[2] for o in out]
            yield result

    return _spread(requests.select(*[f.name for f in fields], "prompt"), concurrency).mapInPandas(run, schema)


_SCORED = "profile_id long, ordinal long, rerank_score double"


def _scored_at_once(documents: DataFrame, reranker: Reranker) -> DataFrame:
    """One request per profile; too many documents for one are an error."""
    limit = reranker.max_documents

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if (rows := int(pdf["_rows"].iloc[0])) > limit:
            raise ValueError(f"{rows} documents exceed the reranker limit of {limit}; select by similarity first")
        pdf = pdf.sort_values("ordinal")
        scores = reranker.rerank(pdf["query"].iloc[0], pdf["document"].tolist())
        return pd.DataFrame({"profile_id": pdf["profile_id"], "ordinal": pdf["ordinal"], "rerank_score": np.asarray(scores, dtype=float)})

    # of a profile with too many one row is enough to tell so: the group stays bounded
    counts = documents.groupBy("profile_id").agg(F.count("*").alias("_rows"), F.min("ordinal").alias("_first"))
    counted = skew_join(documents, counts, ["profile_id"], "inner", ["ordinal"])
    bounded = counted.where((F.col("_rows") <= limit) | (F.col("ordinal") == F.col("_first"))).drop("_first")
    return bounded.groupBy("profile_id").applyInPandas(run, _SCORED)


def _scored_in_requests(documents: DataFrame, reranker: Reranker) -> DataFrame:
    """As many requests per profile as its documents need. A task holds one batch of rows and the documents of one request."""
    limit = reranker.max_documents
    names = ["profile_id", "query", "ordinal", "document"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        for (profile, query), own in itertools.groupby(rows, key=lambda row: row[:2]):
            while asked := list(itertools.islice(own, limit)):
                scores = np.asarray(reranker.rerank(query, [row[3] for row in asked]), dtype=float)
                yield pa.RecordBatch.from_arrays([
                    pa.array([profile] * len(asked), pa.int64()), pa.array([row[2] for row in asked], pa.int64()), pa.array(scores, pa.float64(), from_pandas=True),
                ], ["profile_id", "ordinal", "rerank_score"])

    known = documents.select(*names).where("profile_id IS NOT NULL")
    # the parts of a large profile go to different tasks; one beyond the limit stays whole and is only slower
    hot = hot_keys(known.select("profile_id"), ["profile_id"], limit).orderBy(F.desc("_parts"), "profile_id").limit(MOST_HOT_KEYS)
    part = F.pmod(F.xxhash64("ordinal", "document"), F.coalesce(F.col("_parts"), F.lit(1).cast("long")))
    placed = known.join(F.broadcast(hot), "profile_id", "left").withColumn("_part", part)
    dealt = placed.repartition("profile_id", "_part").sortWithinPartitions("profile_id", "query", "ordinal")
    return dealt.select(*names).mapInArrow(run, _SCORED)


def rerank(documents: DataFrame, reranker: Reranker, top_k: int, split: bool = False) -> DataFrame:
    """``(profile_id, ordinal, query, document)`` to the best ``(profile_id, ordinal, rerank_score, rank)``.

    One request per profile, so a profile may bring at most ``max_documents``; more is an error. With ``split`` a profile
    has as many requests as it needs: for rerankers that score a document by itself, not against the others of its request.
    Their scores are ties when equal up to 9 digits.
    """
    scored = _scored_in_requests(documents, reranker) if split else _scored_at_once(documents, reranker)
    score = F.round("rerank_score", 9) if split else F.col("rerank_score")
    best = Window.partitionBy("profile_id").orderBy(score.desc(), "ordinal")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top_k)
