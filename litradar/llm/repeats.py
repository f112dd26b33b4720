"""Removal of long repeated byte strings, by sorting sampled suffixes and inducing the rest.

Asked for are all strings of ``width`` bytes that start at two places. Of every such string one place is sampled: its
leftmost k-gram with the smallest hash. Equal strings have their sample at the same offset, so it is enough to sort the
sampled suffixes (about one byte in 75) and to induce the strings between them, as suffix sorting by induction does from
its sampled suffixes. The tuples (k-gram, context, place) are sorted externally by Spark, which spills to disk:

1. *Sort.* A sample stands for the run of strings that chose it; its context is the hash of all bytes of that run. In
   sorted order equal k-grams are neighbours, and within them equal contexts: these runs repeat as a whole. A k-gram
   that occurs once is dropped.
2. *Induce.* What is left are samples whose k-gram repeats in another context: the ends of matches. Their bytes are
   fetched, and the strings at each offset before the sample are compared by hash within the k-gram.

Matches never cross documents, and a string that repeats within its document counts. Contexts that repeat within a batch
are settled there, one stands for all. K-grams that are very frequent in a sample of the documents are spread over tasks
by context, and those with very many contexts are compared by a shuffle on the string instead of in one task; both
change the distribution of the work, not the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread_scan
from .shingles import mix64, seeded

WIDTH, GRAM = 200, 50
# windows of a long text that are worked on at once
CHUNK = 1 << 20
# more rows of one k-gram than this do not go to one task
HOT = 20_000
# one document in so many is looked at to find such k-grams, at most so many of which are spread
SAMPLE_SHARE, MOST_HOT = 64, 100_000
_BYTES = seeded(21, 256)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data)), dtype=np.uint64, out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[begin]) * _powers(len(sums), _INVERSE)[begin])


def _leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of every window, by doubling."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


def samples(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """``gram hash, context hash, first, last``: samples of a text and the first and last of the windows that chose them."""
    parts = []
    for begin in range(0, len(data) - width + 1, CHUNK):
        piece = data[begin : begin + CHUNK + width - 1]
        sums = _prefix_sums(piece)
        spots = np.arange(len(piece) - gram + 1)
        grams = _hashes(sums, spots, spots + gram)
        chosen = _leftmost_smallest(grams, width - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:], [len(chosen)])) - 1
        at = chosen[first]
        shape = (at - first).astype(np.uint64) * np.uint64(1000003) + (last - first).astype(np.uint64)
        parts.append((grams[at], mix64(_hashes(sums, first, last + width) + shape), first + begin, last + begin))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint, not touching ones, in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[new], reach[np.concatenate((new[1:], [len(begin)])) - 1]


def _text_pieces(batch: pa.RecordBatch, size: int = 1 << 23) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and texts of slices with about ``size`` bytes."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    begin, held, out = 0, 0, []
    for i in range(len(texts)):
        value = texts[i].as_buffer() if texts[i].is_valid else None
        out.append(np.frombuffer(value, dtype=np.uint8) if value else np.zeros(0, dtype=np.uint8))
        held += len(out[-1])
        if held >= size or i + 1 == len(texts):
            yield begin, out
            begin, held, out = i + 1, 0, []


def _sampled(width: int, gram: int):
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("_h", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("settled", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _text_pieces(batch):
                found = [samples(t, width, gram) for t in texts]
                doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
                grams, contexts, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(grams):
                    continue
                # a context that repeats here is settled; one of its samples stands for it
                _, place, which, n = np.unique(contexts, return_index=True, return_inverse=True, return_counts=True)
                twice = n[which] > 1
                stands = np.zeros(len(grams), dtype=bool)
                stands[place] = True
                rows = np.flatnonzero(~twice | stands)
                known = np.flatnonzero(twice)
                spans = [(d, *merged(first[known[doc[known] == d]], last[known[doc[known] == d]] + width)) for d in np.unique(doc[known])] if len(known) else []
                own = np.concatenate([np.full(len(b), d) for d, b, _ in spans]) if spans else np.zeros(0, dtype=np.int64)
                index = np.concatenate((doc[rows], own)) + at
                put = lambda a, b: pa.array(np.concatenate((a.view(np.int64), b)).astype(np.int64))
                begins = np.concatenate([b for _, b, _ in spans]) if spans else own
                ends = np.concatenate([e for _, _, e in spans]) if spans else own
                # settled spans travel along under a random key
                key = mix64(contexts[0] + (own + at).astype(np.uint64) * np.uint64(7919) + begins.astype(np.uint64)).view(np.int64)
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays([
                    put(grams[rows], key), put(contexts[rows], key), batch.column("doc_id").take(take), batch.column("_h").take(take),
                    put(first[rows], begins), put(last[rows] + width, ends),
                    pa.array(np.concatenate((twice[rows].astype(np.int8), np.full(len(own), 2, dtype=np.int8))))], schema=schema)

    return run


# what is known of a span: it repeats; its strings are to be compared; it repeats and others are compared with it
REPEATS, OPEN, WITNESS = 0, 1, 2


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gram, part, context) and leave as ``doc_id, _h, begin, end, gram, state``.

    Contexts of a gram in several parts are compared with what the others may hold. Else a row needs its neighbours
    only. The last row of a batch waits for the next batch; of the row before the first one its key is kept, and whether
    its gram had another context before.
    """
    waiting, before, other_before = None, None, False

    def judge(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
        nonlocal before, other_before
        gram, context, mark, parts = (rows.column(c).to_numpy() for c in ("gram", "context", "settled", "parts"))
        spread = parts > 1
        same_gram = np.concatenate(([before is not None and before[0] == gram[0]], gram[1:] == gram[:-1]))
        same_context = same_gram & np.concatenate(([before is not None and before[1] == context[0]], context[1:] == context[:-1]))
        next_gram, next_context = np.append(same_gram[1:], False), np.append(same_context[1:], False)
        run = np.maximum.accumulate(np.where(same_context, -1, np.arange(len(gram))))
        earlier = np.where(run < 0, other_before, (same_gram & ~same_context)[run])
        span = mark == 2
        repeats = same_context | next_context | (mark == 1) | span
        witness = repeats & ~span & ~next_context & (earlier | next_gram | spread)
        is_open = ~repeats & (same_gram | next_gram | spread)
        take = [np.flatnonzero(x[:n]) for x in (repeats, is_open, witness)]
        if n:
            before, other_before = (gram[n - 1], context[n - 1]), bool(earlier[n - 1])
        out = rows.select(["doc_id", "_h", "begin", "end", "gram"]).take(pa.array(np.concatenate(take)))
        state = np.repeat(np.array([REPEATS, OPEN, WITNESS], dtype=np.int8), [len(t) for t in take])
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(state)], names=[*out.schema.names, "state"])

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if waiting is None else pa.concat_batches([waiting, batch])
        yield judge(rows, len(rows) - 1)
        waiting = rows.slice(len(rows) - 1)
    if waiting is not None:
        yield judge(waiting, 1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans of each text."""
    for batch in batches:
        for at, texts in _text_pieces(batch):
            spans = batch.column("spans").slice(at, len(texts))
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(texts)), np.diff(spans.offsets.to_numpy()))
            begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
            data = [texts[d][b:e].tobytes() for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True)]
            take = pa.array(doc + at)
            yield pa.record_batch({"gram": flat.field("gram"), "doc_id": batch.column("doc_id").take(take), "_h": batch.column("_h").take(take), "begin": flat.field("begin"), "bytes": pa.array(data, pa.binary())})


def _window_hashes(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings in the rows' bytes: hash with the row's gram, row, offset in the row."""
    texts = rows.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + offset
    sums = _prefix_sums(data)
    grams = mix64(rows.column("gram").to_numpy().view(np.uint64))
    return _hashes(sums, start, start + width) ^ grams[row], row, offset


def _induced(width: int):
    """Rows come sorted by gram; the strings that occur twice under a gram leave as spans."""

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, offset = _window_hashes(rows, width)
        _, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = n[which] > 1
        row, offset = row[hit], offset[hit]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))) if len(row) else row
        last = np.append(first[1:], len(row))[: len(first)] - 1
        take = pa.array(row[first])
        begin = rows.column("begin").to_numpy()[row[first]]
        return pa.record_batch({"doc_id": rows.column("doc_id").take(take), "_h": rows.column("_h").take(take), "begin": pa.array(begin + offset[first]), "end": pa.array(begin + offset[last] + width)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            # cut into pieces of about a thousand rows that end with a gram
            ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)) if len(gram) else []
            begin = 0
            if waiting and len(gram) and waiting[-1].column("gram")[0].as_py() != gram[0]:
                yield judge(pa.concat_batches(waiting))
                waiting = []
            for end in list(ends)[:-1]:
                if end - begin + sum(map(len, waiting)) >= 1000:
                    yield judge(pa.concat_batches([*waiting, batch.slice(begin, end - begin)]))
                    waiting, begin = [], end
            if begin < len(batch):
                tail = batch.slice(begin)
                # only the last gram may go on in the next batch
                cut = int(ends[-2]) - begin if len(ends) > 1 else 0
                if cut > 0:
                    yield judge(pa.concat_batches([*waiting, tail.slice(0, cut)]))
                    waiting = []
                waiting.append(tail.slice(max(cut, 0)))
        if waiting:
            yield judge(pa.concat_batches(waiting))

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000)
                hashes, row, offset = _window_hashes(rows, width)
                take, begin = pa.array(row), rows.column("begin").to_numpy()[row] + offset
                yield pa.record_batch({"string": pa.array(hashes.view(np.int64)), "doc_id": rows.column("doc_id").take(take), "_h": rows.column("_h").take(take), "begin": pa.array(begin), "end": pa.array(begin + width)})

    return run


def _by_text(spans: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text with the list of its spans; a list is as long as its text allows."""
    lists = spans.groupBy("doc_id", "_h").agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return lists.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_x"), "spans")


def repeated_spans(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, _h, begin, end``: spans (they may overlap) that cover exactly the bytes in a string of ``width`` bytes that starts at two places."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    tuple_schema = "gram long, context long, doc_id long, _h long, begin long, end long, settled byte"
    tuples = spread_scan(texts).mapInArrow(_sampled(width, gram), tuple_schema)
    few = texts.where(F.pmod(F.xxhash64("_h", "doc_id"), F.lit(SAMPLE_SHARE)) == 0).mapInArrow(_sampled(width, gram), tuple_schema)
    often = few.where("settled < 2").groupBy(F.col("gram").alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") * SAMPLE_SHARE > hot)
    often = cut_lineage(often.orderBy(F.desc("_n"), "_g").limit(MOST_HOT).select("_g", F.ceil(F.col("_n") * SAMPLE_SHARE / hot).cast("int").alias("_parts")))
    tuples = tuples.join(F.broadcast(often), F.col("gram") == F.col("_g"), "left").withColumn("parts", F.coalesce("_parts", F.lit(1))).drop("_g", "_parts")
    tuples = tuples.withColumn("part", F.pmod("context", F.col("parts")).cast("int"))
    tuples = tuples.repartition("gram", "part").sortWithinPartitions("gram", "part", "context")
    states = cut_lineage(tuples.mapInArrow(_settled, "doc_id long, _h long, begin long, end long, gram long, state byte"))
    open_spans = _by_text(states.where(F.col("state") != REPEATS), ["gram", "begin", "end"])
    match = (F.col("_h") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    contexts = texts.join(open_spans, match).select("doc_id", "_h", "text", "spans")
    contexts = cut_lineage(contexts.mapInArrow(_contexts, "gram long, doc_id long, _h long, begin long, bytes binary"))
    crowded = contexts.groupBy("gram").count().where(F.col("count") > hot).select("gram")
    crowded = cut_lineage(crowded)
    span = "doc_id long, _h long, begin long, end long"
    calm = contexts.join(crowded, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    found = calm.select("gram", "doc_id", "_h", "begin", "bytes").mapInArrow(_induced(width), span)
    if not crowded.isEmpty():
        strings = cut_lineage(contexts.join(crowded, "gram").select("gram", "doc_id", "_h", "begin", "bytes").mapInArrow(_windows(width), "string long, " + span))
        twice = strings.groupBy("string").count().where("count > 1").select("string")
        found = found.union(strings.join(twice, "string").select("doc_id", "_h", "begin", "end"))
    return states.where(F.col("state") == REPEATS).select("doc_id", "_h", "begin", "end").union(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _text_pieces(batch):
            out = []
            for text, spans in zip(texts, batch.column("spans").slice(at, len(texts)).to_pylist(), strict=True):
                kept, removed, n = hashlib.sha256(), 0, 0
                done = 0
                if spans:
                    begin, end = merged(np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]))
                    n = len(begin)
                    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                        kept.update(text[done:b])
                        removed += e - b
                        done = e
                kept.update(text[done:])
                out.append((len(text), removed, n, kept.hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, len(texts)), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of its UTF-8 bytes.

    Null texts count as empty; texts shorter than ``width`` keep everything; a repeated row repeats all its strings; a
    null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    spans = _by_text(repeated_spans(documents, width, gram, hot).distinct(), ["begin", "end"])
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    match = (F.col("_h") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    rows = texts.join(spans, match, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
