"""Near-duplicate groups by banded MinHash, odd sketches and exact verification.

Each document becomes a set of word shingles. Texts with equal sets form a class at once, by a digest. The MinHash
samples of a class are cut into bands; classes that share a band are candidates. All samples are also folded into a
parity bitmap (odd sketch): a sample in which two sets differ flips at most two bits of the XOR of their bitmaps, so a
population count above twice the differences that a link can have rules the pair out. What is left is compared on the
full sets.

No list of all pairs is made. Classes that hang together by bands form a cluster; a cluster is cut into tiles of bounded
size, each pair of tiles is one bounded piece of work, and only the links of a spanning forest leave it.

With 25 bands of 5 samples a pair at the threshold 0.85 shares no band with probability 5e-7 (less above it), and is
ruled out by the sketch with probability 6e-8. Work inside a cluster is quadratic in its distinct sets, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread_scan
from .common import small_side
from .components import components
from .shingles import mix64, seeded, shingle_sets

BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
# differing samples of a pair at 0.85: 18.75 expected; more than this many with probability 6e-8
MOST_DIFFERING = 45
TILE = 256
LINK, WHOLE = 85, 100

_FACTORS, _TERMS = seeded(1, SAMPLES) | np.uint64(1), seeded(2, SAMPLES)
_BAND = seeded(3, ROWS) | np.uint64(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of samples for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SAMPLES), dtype=np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _TERMS[k], starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    banded = samples.reshape(len(samples), BANDS, ROWS)
    return mix64((banded * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words."""
    bits = mix64(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(samples), SKETCH_BITS), dtype=np.uint8)
    np.bitwise_xor.at(parity, (np.arange(len(samples))[:, None], bits.astype(np.int64)), 1)
    return np.packbits(parity, axis=1, bitorder="little").view(np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about ``size`` bytes of text."""
    texts = batch.column(column).cast(pa.large_binary())
    begin = held = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= size or i + 1 == len(texts):
            yield batch.slice(begin, i + 1 - begin), [t or b"" for t in texts.slice(begin, i + 1 - begin).to_pylist()]
            begin, held = i + 1, 0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import pyarrow.compute  # noqa: F401

    for batch in batches:
        for rows, texts in _pieces(batch, "text"):
            sets = shingle_sets(texts)
            at = [i for i, s in enumerate(sets) if len(s)]
            take = np.full(len(sets), len(at))
            take[at] = np.arange(len(at))
            samples = minhashes([sets[i] for i in at]) if at else np.zeros((0, SAMPLES), dtype=np.uint64)
            put = pa.array(take, mask=take == len(at))
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"), "_h": rows.column("_h"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "cid": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "bands": _lists(band_keys(samples)).take(put), "odd": _lists(odd_sketches(samples)).take(put)})


def sketches(documents: DataFrame) -> DataFrame:
    """``doc_id, _h`` (hash of the text), ``n_shingles``, class ``cid``, ``bands``, ``odd``; without words the last three are null."""
    rows = spread_scan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text"))
    return rows.mapInArrow(_sketched, "doc_id long, _h long, n_shingles long, cid binary, bands array<long>, odd array<long>")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        for rows, texts in _pieces(batch, "text"):
            yield pa.record_batch({"cid": rows.column("cid"), "shingles": pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())})


def tile_links(cids: list[bytes], left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], odd: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links of a spanning forest among the pairs (left row, right row). ``left`` and ``right`` mark the two tiles."""
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(size)))
    cols = np.flatnonzero(right)
    flat = np.concatenate([ids[bounds[c] : bounds[c + 1]] for c in cols])
    starts = np.concatenate(([0], np.cumsum(size[cols])[:-1]))
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    root = list(range(len(cids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for r in np.flatnonzero(left).tolist():
        able = np.bitwise_count(odd[cols] ^ odd[r]).sum(axis=1) <= 2 * MOST_DIFFERING
        able &= (WHOLE * np.minimum(size[cols], size[r]) >= LINK * np.maximum(size[cols], size[r])) & (cols != r)
        if not able.any():
            continue
        own = ids[bounds[r] : bounds[r + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        linked = able & (WHOLE * shared >= LINK * (size[cols] + size[r] - shared))
        for c in cols[linked].tolist():
            if top(r) != top(c):
                root[top(c)] = top(r)
                out.append((cids[r], cids[c]))
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cluster, i, j); a piece of work may span batches."""
    held, key = [], None

    def finish() -> pa.RecordBatch:
        cids, sets = [r[1] for r in held], [np.frombuffer(r[2], dtype=np.uint64) for r in held]
        odd = np.array([r[3] for r in held], dtype=np.int64).view(np.uint64)
        tiles = np.array([r[0] for r in held])
        links = tile_links(cids, tiles == key[1], tiles == key[2], sets, odd) if len(held) > 1 and key[2] in tiles and key[1] in tiles else []
        return pa.record_batch({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("cluster", "i", "j", "tile", "cid", "shingles", "odd")], strict=True):
            if row[:3] != key:
                if held:
                    yield finish()
                held, key = [], row[:3]
            held.append(row[3:])
    if held:
        yield finish()


def links(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Links ``a, b`` between classes that connect all classes with linked sets; ``rows`` is what ``sketches`` gave, written."""
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min(F.struct("doc_id", "_h")).alias("at"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = cut_lineage(classes)
    members = classes.select("cid", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("cid").alias("hub"), F.max("cid").alias("other")).where(F.col("hub") != F.col("other"))
    spokes = members.join(shared.select("band", "hub"), "band").where(F.col("cid") != F.col("hub"))
    clusters = components(spokes.select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tiled = clusters.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.join(classes.withColumnRenamed("cid", "node"), "node")
    tiled = cut_lineage(tiled.select(F.col("component").alias("cluster"), "tile", "tiles", F.col("node").alias("cid"), "at.doc_id", "at._h", "odd"))
    # the texts of candidates are read again instead of storing the sets of all documents; copies of a class meet in its first row
    wanted = small_side(tiled.select("cid", F.col("doc_id").alias("_d"), F.col("_h").alias("_x")))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    texts = texts.join(wanted, (F.col("_h") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("cid", "text")
    sets = texts.mapInArrow(_full_sets, "cid binary, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))
    work = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    work = work.select("cluster", "tile", "cid", "odd", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    pieces = work.join(sets, "cid").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return pieces.select("cluster", "i", "j", "tile", "cid", "shingles", "odd").mapInArrow(_verified, "a binary, b binary")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links), ``kept``, and ``_h``, the hash of its text.

    Texts with fewer than five words are one shingle; null and empty texts and such without words have none, link with
    nothing and are kept. Repeated rows are linked, so each names the same component and each with its doc_id is kept.
    A null doc_id takes part, never is a component id, and is kept only if its group has no other id. An empty table
    gives no rows; other columns are ignored.
    """
    rows = cut_lineage(sketches(documents))
    found = components(cut_lineage(links(documents, rows)))
    firsts = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first"))
    named = firsts.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = cut_lineage(named)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = cut_lineage(named.join(smallest, "component").select("cid", "component_id"))
    out = rows.select("doc_id", "_h", "n_shingles", "cid").join(by_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "_h")
