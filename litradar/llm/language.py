"""Language identification with a string kernel.

Two texts are as similar as the sets of their byte n-grams, 1 to 4 letters long (blended spectrum, presence only):
k(x, y) = |x and y| / sqrt(|x| |y|). A bounded sample of labelled texts is fitted by one-versus-rest kernel ridge
regression in the Nystroem form: some of the sample are landmarks, a text is described by its kernel values against
them, whitened by the landmarks' own kernel matrix. The whole chain is linear in a text's n-grams, so scoring a batch
of texts is one product of its presence matrix with the fitted matrix; whole texts are read, in one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, spread_scan
from .common import small_side
from .shingles import seeded

LONGEST = 4
# n-grams are hashed to so many places
PLACES = 1 << 15
UNDETERMINED = "und"
# the bound of the labelled sample, and landmarks taken from it, both for each language
TRAIN_ROWS, LANDMARKS = 400, 32
RIDGE = 1e-2

_LETTER = re.compile(r"[^\W\d_]")
# letters keep their byte; everything else in ASCII is a gap
_LETTERS = np.arange(256, dtype=np.uint32)
_LETTERS[:65] = _LETTERS[91:97] = _LETTERS[123:128] = 32
_MIX = (seeded(31, LONGEST) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which n-gram places occur."""
    out = np.zeros((len(texts), PLACES), dtype=np.uint8)
    shift = np.uint32(32 - PLACES.bit_length() + 1)
    for row, text in zip(out, texts, strict=True):
        data = _LETTERS[np.frombuffer(f" {text} ".lower().encode("utf-8", "replace"), dtype=np.uint8)]
        gaps = data == 32
        data = data[~(gaps & np.concatenate(([False], gaps[:-1])))]  # one gap between words
        code = np.zeros(len(data), dtype=np.uint32)
        for n in range(LONGEST):
            if len(data) <= n:
                break
            code = (code[: len(data) - n] << np.uint32(8)) | data[n:]
            row[((code ^ (code >> np.uint32(15))) * _MIX[n]) >> shift] = 1
            code = code[:-1] if n + 1 < LONGEST else code
    return out


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # places x languages
    bias: np.ndarray


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows`` of presence, in an order that does not depend on the labels."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((PLACES, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    norm = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)[:, None]
    names = np.array(labels)
    marks = np.concatenate([np.flatnonzero(names == x)[:landmarks] for x in languages])
    anchors = rows[marks].astype(np.float32) / norm[marks]
    values, vectors = np.linalg.eigh((anchors @ anchors.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    # a few rows at a time: the presence matrix is small only as bytes
    kernel = [(rows[at : at + 128].astype(np.float32) / norm[at : at + 128]) @ anchors.T for at in range(0, len(rows), 128)]
    inputs = np.concatenate(kernel).astype(np.float64) @ whiten
    inputs = np.column_stack([inputs, np.ones(len(inputs))])
    targets = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # every language weighs the same, however many rows it has
    weight = np.zeros(len(names))
    for x in languages:
        weight[names == x] = 1.0 / (names == x).sum()
    weight *= len(names) / len(languages)
    penalty = ridge * np.eye(inputs.shape[1])
    penalty[-1, -1] = 0.0
    solved = np.linalg.solve((inputs * weight[:, None]).T @ inputs + penalty * len(names), (inputs * weight[:, None]).T @ targets)
    matrix = anchors.T.astype(np.float64) @ (whiten @ solved[:-1])
    return Model(languages, matrix.astype(np.float32), solved[-1].astype(np.float32))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    rows = presence(texts)
    size = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    return (rows.astype(np.float32) @ model.matrix) / size[:, None] + model.bias


def sampled(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``lang, text`` of at most ``rows`` rows of each language, the same ones each time.

    Languages are counted first; of a frequent one only keys with a small hash go on, about eight times as many as
    needed, so no task gets a whole language and no text is shuffled.
    """
    texts = labelled.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_key"))
    counts = small_side(cut_lineage(texts.groupBy("lang").agg(F.count("*").alias("_n"))))
    place = F.pmod(F.col("_key"), F.lit(1 << 30)) / (1 << 30)
    few = texts.select("doc_id", "lang", "_key").join(counts, "lang").where(place < 8.0 * rows / F.col("_n"))
    order = Window.partitionBy("lang").orderBy("_key", "doc_id")
    chosen = few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    chosen = chosen.groupBy(F.col("lang").alias("_lang"), F.col("doc_id").alias("_doc")).agg(F.lit(1).alias("_one"))
    found = texts.join(small_side(cut_lineage(chosen)), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("lang") == F.col("_lang")))
    # a doc_id may repeat
    again = Window.partitionBy("lang").orderBy("_key", "doc_id", F.xxhash64("text"))
    return found.withColumn("_rank", F.row_number().over(again)).where(F.col("_rank") <= rows).select("lang", "text")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = presence(part.column("text").to_pylist())
            yield pa.record_batch({"lang": part.column("lang"), "grams": pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())})


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on ``lang, text, doc_id``; at most ``rows`` texts of each language come to the driver, as bits."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    taken = sampled(usable, rows).mapInArrow(_packed, "lang string, grams binary").collect()
    taken = sorted((r["lang"], bytes(r["grams"])) for r in taken)
    bits = np.array([np.frombuffer(g, dtype=np.uint8) for _, g in taken]) if taken else np.zeros((0, PLACES // 8), dtype=np.uint8)
    return fit(np.unpackbits(bits, axis=1), [x for x, _ in taken], landmarks, ridge)


def identify(documents: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``.

    A null text and one without a letter is ``und`` with score 0, and so is every text if nothing was learned. Other
    texts get the language with the highest margin (ties: the first name); the score is that margin, -1 to 1, moved
    and cut to 0 to 1. Languages with one name are one; repeated rows are scored alike; an empty table gives no rows.
    """
    kept = documents.select(*keep, F.col("text").alias("_text"))
    if len(set(kept.columns) | {"lang_pred", "score"}) < len(kept.columns) + 2:
        raise ValueError("kept columns may not be named _text, lang_pred or score")
    names = [c for c in kept.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.array([UNDETERMINED] * len(batch), dtype=object), np.zeros(len(batch))
            for at in range(0, len(batch) if model.languages else 0, 128):
                texts = batch.column("_text").slice(at, 128).to_pylist()
                able = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
                if able:
                    margins = scores(model, [texts[i] for i in able])
                    first, rows = margins.argmax(axis=1), np.array(able) + at
                    best[rows] = [model.languages[k] for k in first]
                    score[rows] = np.clip((margins[np.arange(len(able)), first].astype(np.float64) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(best.tolist(), pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return spread_scan(kept).mapInArrow(run, f"{schema}, lang_pred string, score double" if names else "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Every third document by the checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
