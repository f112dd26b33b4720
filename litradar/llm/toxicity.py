"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over the words of the whole text (presence only). A
later model also gets the probabilities of the earlier categories. In training these come from models that did not see
the row (out-of-fold), so a later model learns how far to trust predictions, not labels. The fit uses a bounded sample of
labelled rows; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, spread_scan
from .shingles import NOT_WORD, word_hashes

# the bound of the labelled sample: rows with and rows without the last category
TRAIN_ROWS = 6_000
FOLDS = 3
# words in fewer rows of the sample are not used; the most telling ones are
LEAST_ROWS, MOST_WORDS = 4, 4_000
STEPS, PENALTY = 300, 1.0
THRESHOLD = 0.5


def _words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([(t or "").lower().encode("utf-8", "replace") for t in texts], NOT_WORD)


@dataclass
class Rows:
    """Distinct words of each text: ``words[start[i]:start[i + 1]]``."""

    words: np.ndarray
    start: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.start)[at]
        index = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Rows(self.words[index], np.concatenate(([0], np.cumsum(size))))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    earlier: np.ndarray  # weights of the earlier categories' log odds
    bias: float

    def margins(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        n = len(rows.start) - 1
        out = np.full(n, self.bias)
        if len(self.words) and len(rows.words):
            at = np.minimum(np.searchsorted(self.words, rows.words), len(self.words) - 1)
            hit = self.words[at] == rows.words
            out += np.bincount(rows.row()[hit], weights=self.weights[at[hit]], minlength=n)
        return out + _logit(earlier) @ self.earlier if earlier.shape[1] else out


def fit_linear(rows: Rows, target: np.ndarray, earlier: np.ndarray) -> Linear:
    """Logistic regression with a squared penalty, both classes weighing the same, by accelerated gradient steps."""
    n = len(target)
    positive = target.sum()
    if positive in (0, n):
        return Linear(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), 8.0 if positive and n else -8.0)
    row = rows.row()
    words, which, count = np.unique(rows.words, return_inverse=True, return_counts=True)
    with_it = np.bincount(which, weights=target[row], minlength=len(words))
    rate, other = (with_it + 0.5) / (positive + 1), (count - with_it + 0.5) / (n - positive + 1)
    telling = np.abs(np.log(rate / other)) / np.sqrt(1 / (with_it + 0.5) + 1 / (count - with_it + 0.5))
    telling[count < LEAST_ROWS] = -1
    chosen = np.sort(np.argsort(-telling, kind="stable")[:MOST_WORDS])
    chosen = chosen[telling[chosen] > 0]
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[which] >= 0
    row, column = row[use], place[which[use]]
    dense = np.column_stack([_logit(earlier), np.ones(n)]) if earlier.shape[1] else np.ones((n, 1))
    weight = np.where(target == 1, 0.5 * n / positive, 0.5 * n / (n - positive))
    # words are in few rows: a step for each column by its own curvature bound
    size = np.concatenate([np.bincount(column, weights=weight[row], minlength=len(chosen)), (weight[:, None] * dense**2).sum(axis=0)])
    per_row = np.bincount(row, minlength=n).max(initial=0) + dense.shape[1]
    penalty = np.full(len(size), PENALTY)
    penalty[-1] = 1e-6
    step = 1.0 / (0.25 * size * min(per_row, 40) + penalty)
    w = np.zeros(len(size))
    ahead, momentum = w, 1.0
    for _ in range(STEPS):
        margin = np.bincount(row, weights=ahead[column], minlength=n) + dense @ ahead[len(chosen) :]
        error = weight * (_sigmoid(margin) - target)
        gradient = np.concatenate([np.bincount(column, weights=error[row], minlength=len(chosen)), error @ dense]) + penalty * ahead
        new = ahead - step * gradient
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return Linear(words[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_chain(rows: Rows, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model per column of ``labels``, in order. Row i is in fold i mod ``folds``."""
    n, k = labels.shape
    fold = np.arange(n) % folds
    earlier, models = np.zeros((n, 0)), []
    for c in range(k):
        models.append(fit_linear(rows, labels[:, c], earlier))
        if c + 1 < k:
            unseen = np.zeros(n)
            for f in range(folds):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = fit_linear(rows.take(rest), labels[rest, c], earlier[rest])
                unseen[own] = _sigmoid(model.margins(rows.take(own), earlier[own]))
            earlier = np.column_stack([earlier, unseen])
    return models


def distinct_words(texts: Sequence[str | None]) -> Rows:
    words, bounds = _words(texts)
    parts = [np.unique(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return Rows(np.concatenate(parts) if parts else words, np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


def chain_probabilities(models: Sequence[Linear], texts: Sequence[str | None]) -> np.ndarray:
    """Only words that some model knows are made distinct; the others cannot change a margin."""
    words, bounds = _words(texts)
    known = np.unique(np.concatenate([m.words for m in models])) if models else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        pairs = np.unique(row[hit] * len(known) + at[hit])
    else:
        pairs = np.zeros(0, dtype=np.int64)
    size = np.bincount(pairs // max(len(known), 1), minlength=len(texts))
    rows = Rows(known[pairs % max(len(known), 1)] if len(known) else known, np.concatenate(([0], np.cumsum(size))))
    out = np.zeros((len(texts), 0))
    for model in models:
        out = np.column_stack([out, _sigmoid(model.margins(rows, out))])
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            rows = distinct_words(part.column("text").to_pylist())
            words = [rows.words[a:b].tobytes() for a, b in zip(rows.start[:-1].tolist(), rows.start[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "labels": part.column("labels"), "words": pa.array(words, pa.binary())})


def train(documents: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]], rows: int = TRAIN_ROWS) -> list[Linear]:
    """Fit on documents with a row in ``labels`` (by ``doc_id``); ``categories`` are names with 0/1 expressions over ``labels``.

    At most ``rows`` rows with and ``rows`` without the last category are used, always the same. Labels that are null in
    a category, contradict each other for a doc_id, or belong to no text are not used.
    """
    names = [n for n, _ in categories]
    marked = labels.select("doc_id", *[F.expr(c).cast("int").alias(n) for n, c in categories]).dropna()
    agreed = marked.groupBy("doc_id").agg(*[F.min(n).alias(n) for n in names], *[F.max(n).alias(f"_{n}") for n in names])
    for n in names:
        agreed = agreed.where(F.col(n) == F.col(f"_{n}"))
    agreed = cut_lineage(agreed.select("doc_id", *names, F.xxhash64("doc_id").alias("_key")))
    # two classes are counted first; of a frequent one only keys with a small hash go on, about eight times as many as needed
    counts = agreed.groupBy(F.col(names[-1]).alias("_class")).agg(F.count("*").alias("_n"))
    place = F.pmod(F.col("_key"), F.lit(1 << 30)) / (1 << 30)
    few = agreed.join(F.broadcast(counts), F.col(names[-1]) == F.col("_class")).where(place < 8.0 * rows / F.col("_n"))
    order = Window.partitionBy(names[-1]).orderBy("_key", "doc_id")
    chosen = few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    chosen = chosen.select("doc_id", F.array(*names).alias("labels"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    # the sample is at most twice ``rows`` rows
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "labels", "text")
    taken = found.mapInArrow(_packed, "doc_id long, labels array<int>, words binary").collect()
    taken = sorted((r["doc_id"], r["labels"], bytes(r["words"])) for r in taken)
    words = [np.frombuffer(w, dtype=np.uint64) for _, _, w in taken]
    start = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    held = Rows(np.concatenate(words) if words else np.zeros(0, dtype=np.uint64), start)
    # folds go by place, so the order must not follow the ids
    mixed = np.argsort([hash_of(d) for d, _, _ in taken], kind="stable") if taken else np.zeros(0, dtype=np.int64)
    table = np.array([x for _, x, _ in taken], dtype=np.float64).reshape(len(taken), len(names))
    return fit_chain(held.take(mixed), table[mixed])


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20


def score(documents: DataFrame, models: Sequence[Linear], names: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: ``doc_id``, a probability ``p_<category>`` for each, and the last category as ``flagged``.

    Null and empty texts have the probabilities of a text without known words and are never flagged, and without labels
    nothing is; repeated rows are scored alike; a null doc_id is kept; an empty table gives no rows.
    """
    columns = [f"p_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                p = chain_probabilities(models, texts)
                flagged = (p[:, -1] >= threshold) & np.array([bool(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(columns))], pa.array(flagged)], names=["doc_id", *columns, "flagged"])

    rows = spread_scan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in columns) + ", flagged boolean")
