"""Token ids in grammar-compressed files.

Texts are encoded in ascending order of their ids, and the ids of neighbouring texts are gathered in blocks. A block is
compressed by Re-Pair: the most frequent pairs of neighbouring symbols are replaced by new symbols, many in a round, for
a few rounds (``ROUNDS``; most of the gain is in the first ones) or until no pair is frequent. Rules are kept with the
length of what they expand to, so a text is decoded by skipping whole symbols up to its first id (``read_documents``). No
symbol reaches over the end of a text.

The file format is a Parquet table with a row per block: ``part, block`` (order of the blocks), ``doc_ids, text_hashes,
sizes`` (ids of each text), ``left, right`` (the pair of each rule; rule r is symbol ``base + r``), ``lengths`` (ids a
rule expands to), ``symbols`` (unsigned 16-bit, little-endian), ``base``. Spark's writer commits it, so lost executors
leave no half-written block.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import small_side
from .shingles import mix64, seeded

END_ID = 1
BLOCK_IDS = 1 << 20
# at most so many pairs are replaced in a round, and rounds end when no pair occurs so often
ROUND_PAIRS, ROUNDS, LEAST = 512, 8, 16
SYMBOLS = 1 << 16
# words and pieces whose ids a Python worker keeps as strings; longer words are not kept
KEPT_WORDS, KEPT_PIECES, KEPT_LENGTH = 100_000, 100_000, 64
# pieces of plain texts it keeps by their hashes, about 20 bytes each, and the ids of all of them
KEPT_HASHES, KEPT_IDS = 1_500_000, 8_000_000
_SLOTS = 20

BLOCKS = ("part int, block int, doc_ids array<bigint>, text_hashes array<bigint>, sizes array<bigint>, left array<int>, right array<int>, "
          "lengths array<bigint>, symbols binary, base int")
# white space on which a plain split and the tokenizer might differ
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


# printable ASCII and Latin letters that are lower-cased alike everywhere, one by one
_PLAIN = re.compile("[!-~\xc0-\u012f\u0131-\u024f]+")
# texts of these are cut into pieces all at once: no apostrophe, which may start a piece of its own, no marker, no endless word
_SIMPLE = re.compile("(?:[\t-\r ]*+[!-&(-~\xc0-\u012f\u0131-\u024f]{1,500}+(?=[\t-\r ]|\\Z))*+[\t-\r ]*+")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(0x250, _SIGN, dtype=np.uint8)
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(48, 58)]] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]] = _LETTER
_KIND[[0xD7, 0xF7]] = _SIGN
_UNIT = seeded(41, 0x250)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Encoder:
    """Ids of texts as unsigned 16-bit bytes.

    The tokenizer drops white space and splits the rest into pieces, each of which it encodes by itself. So words are
    encoded once and remembered; a new word of plain letters and signs is put together from remembered pieces, and only
    new pieces and other words go to the tokenizer. Texts of plain characters alone are cut into pieces by array
    operations.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > SYMBOLS:
            raise ValueError("ids do not fit the file format")
        settings = json.loads(self.tokenizer.to_str())
        splits = [s["pattern"]["Regex"] for s in settings["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        suffix = settings["model"].get("end_of_word_suffix")
        # pieces are known only for a tokenizer of this kind; any other gets whole words
        self.split = regex.compile(splits[0]) if len(splits) == 1 and suffix and _lowers(settings) else None
        self.last = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 10_000):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u2").tobytes() for e in found]
        return out

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has. Many pieces are one text; the last id of each is one that ends a word."""
        ids, many = [np.zeros(0, dtype="<u2")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(pieces), 10_000):
            parts = [pieces[i : i + 200] for i in range(at, min(at + 10_000, len(pieces)), 200)]
            for some, text in zip(parts, self._ids([" ".join(p) for p in parts]), strict=True):
                found = np.frombuffer(text, dtype="<u2")
                ends = np.flatnonzero(self.last[found]) + 1
                if len(ends) != len(some) or ends[-1] != len(found):
                    single = self._ids(some)
                    found, ends = np.frombuffer(b"".join(single), dtype="<u2"), np.cumsum([len(i) // 2 for i in single])
                ids.append(found)
                many.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(many)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        plain, other = {}, []
        for word in new:
            if self.split is not None and len(word) <= KEPT_LENGTH and _PLAIN.fullmatch(word) and "<|" not in word:
                plain[word] = self.split.findall(word.lower())
            else:
                other.append(word)
        pieces = list(set(chain.from_iterable(plain.values())))
        known = dict(zip(pieces, self._remembered(pieces), strict=True))
        found = {w: b"".join(map(known.__getitem__, p)) for w, p in plain.items()}
        found.update(zip(other, self._ids(other), strict=True))
        return found

    def _remembered(self, pieces: list[str]) -> list[bytes]:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        unknown = [p for p in pieces if p not in self.pieces]
        ids, many = self._piece_ids(unknown)
        ends = np.cumsum(many)
        fresh = {p: ids[a:b].tobytes() for p, a, b in zip(unknown, (ends - many).tolist(), ends.tolist(), strict=True)}
        self.pieces.update((p, i) for p, i in fresh.items() if len(p) <= KEPT_LENGTH)
        return [self.pieces.get(p) or fresh[p] for p in pieces]

    def _forget(self) -> None:
        """Hashes of pieces in ascending order, and where the ids of each begin and how many there are."""
        self.hashes, self.ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype="<u2")
        self.begin, self.many = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16)

    def _places(self, hashes: np.ndarray, piece: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Where each of the distinct ascending hashes is kept; ``piece`` gives the texts of those not yet known."""
        if len(self.hashes) > KEPT_HASHES or len(self.ids) > KEPT_IDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        if known.all():
            return at
        new = np.flatnonzero(~known)
        fresh, many = self._piece_ids(piece(new))
        begin = (len(self.ids) + np.cumsum(many) - many).astype(np.int32)
        self.ids = np.concatenate([self.ids, fresh])
        self.begin, self.many = np.insert(self.begin, at[new], begin), np.insert(self.many, at[new], many)
        self.hashes = np.insert(self.hashes, at[new], hashes[new])
        return np.searchsorted(self.hashes, hashes)

    def _encode_simple(self, texts: list[str]) -> list[bytes]:
        """All pieces of all texts as places in one array; each distinct one is looked up once."""
        whole = " ".join(texts).lower() + " "
        units = np.frombuffer(whole.encode("utf-16-le"), dtype=np.uint16)
        kind = _KIND[units]
        same = np.concatenate(([False], (kind[1:] == kind[:-1]) & (kind[1:] != _DIGIT)))
        start = np.flatnonzero((kind != _SPACE) & ~same)
        # a piece ends where the next unit is not of it
        end = np.flatnonzero((kind != _SPACE) & np.append(~same[1:], True)) + 1
        size = end - start
        keys, todo = np.zeros(len(start), dtype=np.uint64), np.arange(len(start))
        for i in range(int(size.max(initial=0))):
            todo = todo[size[todo] > i]
            keys[todo] = keys[todo] * _STEP + _UNIT[units[start[todo] + i]]
        hashes, first, which = np.unique(mix64(keys), return_index=True, return_inverse=True)
        place = self._places(hashes, lambda new: [whole[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        flat, begin, n = self.ids, self.begin[place].astype(np.int64)[which], self.many[place].astype(np.int64)[which]
        after = np.cumsum(n)
        ids = flat[np.repeat(begin - (after - n), n) + np.arange(int(after[-1]) if len(after) else 0)].astype("<u2")
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cut = np.concatenate(([0], after))[np.searchsorted(start, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        simple = [i for i, t in enumerate(texts) if self.split is not None and "<|" not in t and _SIMPLE.fullmatch(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(simple, self._encode_simple([texts[i] for i in simple]), strict=True):
            out[i] = ids
        rest = sorted(set(range(len(texts))).difference(simple))
        for i, ids in zip(rest, self._encode_words([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """Texts with unusual white space are encoded as a whole."""
        split = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        found = self._learn(list(set(chain.from_iterable(s for s in split if s)).difference(self.words)))
        self.words.update((w, i) for w, i in found.items() if len(w) <= KEPT_LENGTH)
        look = (self.words if all(len(w) <= KEPT_LENGTH for w in found) else self.words | found).__getitem__
        odd = iter(self._ids([t for t, s in zip(texts, split, strict=True) if s is None]))
        return [next(odd) if s is None else b"".join(map(look, s)) for s in split]


def _lowers(settings: dict) -> bool:
    """Whether letters are composed and lower-cased one by one and nothing else is changed."""
    steps = settings.get("normalizer") or {}
    kinds = [s["type"] for s in steps.get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and steps["normalizers"][1]["pattern"] == {"Regex": "\\s+"}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, which goes on to later tasks with the words it has seen."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def _alternate(spots: np.ndarray) -> np.ndarray:
    """Marks, of neighbouring places, every other one from the left: pairs must not overlap."""
    place = np.arange(len(spots))
    first = np.ones(len(spots), dtype=bool)
    first[1:] = spots[1:] != spots[:-1] + 1
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``symbols, left, right``. A round counts all pairs, takes the most frequent ones and replaces them at once.

    Pairs are counted by hash slot first. Of each of the fullest slots one pair is counted exactly; another one in the
    same slot has its turn in a later round.
    """
    symbols = ids.astype(np.uint32)
    left, right = [], []
    rules = 0
    # symbols that end with the end of a text; none of them begins a pair
    closed = np.zeros(SYMBOLS, dtype=bool)
    closed[end_id] = True
    begins = (~closed).astype(np.uint32)
    for _ in range(ROUNDS):
        room = min(ROUND_PAIRS, SYMBOLS - base - rules)
        if len(symbols) < 2 or room <= 0:
            break
        a, b = symbols[:-1], symbols[1:]
        mixed = a * np.uint32(0x9E3779B1)
        mixed ^= b * np.uint32(0x85EBCA6B)
        mixed >>= np.uint32(32 - _SLOTS)
        mixed *= begins[a]
        slot = mixed.astype(np.intp)
        full = np.bincount(slot, minlength=1 << _SLOTS)
        full[0] = 0
        chosen = np.flatnonzero(full >= LEAST)
        if not len(chosen):
            break
        # at most so many slots, all that are as full as the least full one of them
        if len(chosen) > 2 * room:
            chosen = chosen[full[chosen] > np.partition(full[chosen], -2 * room - 1)[-2 * room - 1]]
            if not len(chosen):
                break
        place = np.full(1 << _SLOTS, -1, dtype=np.int16)
        place[chosen] = np.arange(len(chosen))
        at = place[slot]
        spots = np.flatnonzero(at >= 0)
        at = at[spots].astype(np.intp)
        pair = np.zeros((len(chosen), 2), dtype=np.uint32)
        pair[at[::-1], 0], pair[at[::-1], 1] = a[spots[::-1]], b[spots[::-1]]  # the first one of a slot stays
        same = ~closed[a[spots]] & (a[spots] == pair[at, 0]) & (b[spots] == pair[at, 1])
        spots, at = spots[same], at[same]
        count = np.bincount(at, minlength=len(chosen))
        best = np.argsort(-count, kind="stable")[:room]
        best = np.sort(best[count[best] >= LEAST])
        if not len(best):
            break
        rule = np.full(len(chosen), -1, dtype=np.int64)
        rule[best] = base + rules + np.arange(len(best))
        taken = rule[at] >= 0
        spots, at = spots[taken], at[taken]
        single = _alternate(spots)
        spots, at = spots[single], at[single]
        closed[base + rules : base + rules + len(best)] = closed[pair[best, 1]]
        begins = (~closed).astype(np.uint32)
        left.append(pair[best, 0].astype(np.int32))
        right.append(pair[best, 1].astype(np.int32))
        rules += len(best)
        symbols[spots] = rule[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[spots + 1] = False
        symbols = symbols[keep]
    none = np.zeros(0, dtype=np.int32)
    return symbols.astype("<u2"), np.concatenate(left) if left else none, np.concatenate(right) if right else none


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids each rule expands to; a rule uses only earlier ones."""
    out = np.ones(base + len(left), dtype=np.int64)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[base + r] = out[a] + out[b]
    return out[base:]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """All ids: each different symbol is opened once, all its rules one step in a pass; then the symbols take their ids."""
    symbols = symbols.astype(np.int64)
    present = np.bincount(symbols, minlength=1) > 0
    ids = np.flatnonzero(present)
    owner = np.arange(len(ids))
    while len(ids) and ids.max() >= base:
        is_rule = ids >= base
        out, owner = np.repeat(ids, 1 + is_rule), np.repeat(owner, 1 + is_rule)
        at = np.flatnonzero(is_rule) + np.arange(is_rule.sum())
        rules = ids[is_rule] - base
        out[at], out[at + 1] = left[rules], right[rules]
        ids = out
    many = np.bincount(owner)
    begin = np.cumsum(many) - many
    which = (np.cumsum(present) - 1)[symbols]
    size = many[which]
    after = np.cumsum(size)
    return ids.astype("<u4")[np.repeat(begin[which] - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)]


def decode_range(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a block: whole symbols are skipped by their lengths."""
    size = np.concatenate([np.ones(base, dtype=np.int64), lengths])[symbols.astype(np.int64)]
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + n, side="left")
    ids = expand(symbols[first : last + 1], left, right, base)
    skip = start - int(ends[first] - size[first]) if n else 0
    return ids[skip : skip + n]


def _blocks(path: str, end_id: int, block_ids: int):
    names = ["part", "block", "doc_ids", "text_hashes", "sizes", "left", "right", "lengths", "symbols", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block = encoder(path), TaskContext.get().partitionId(), 0
        docs, hashes, ids, held = [], [], [], 0
        end = np.array([end_id], dtype="<u2").tobytes()

        def finish() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(ids), dtype="<u2")
            symbols, left, right = compress(data, encode.size, end_id)
            lengths = rule_lengths(left, right, encode.size)
            values = [part, block, docs, hashes, [len(i) // 2 for i in ids], left.tolist(), right.tolist(), lengths.tolist(), symbols.tobytes(), encode.size]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc, h, found in zip(some.column("doc_id").to_pylist(), some.column("_h").to_pylist(), encode.encode(texts), strict=True):
                    docs.append(doc)
                    hashes.append(h)
                    ids.append(found + end)
                    held += len(ids[-1]) // 2
                    if held >= block_ids:
                        yield finish()
                        docs, hashes, ids, held, block = [], [], [], 0, block + 1
        if docs:
            yield finish()

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``doc_id, text`` with the tokenizer file and write the blocks; a null text is empty, null ids come first.

    The texts are range-partitioned by id, so a block holds neighbours; a block is the largest piece in memory, beside
    the longest text.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_h")
    ordered.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCKS).write.mode("overwrite").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
            left, right = np.array(row["left"], dtype=np.int64), np.array(row["right"], dtype=np.int64)
            ids = expand(np.frombuffer(row["symbols"], dtype="<u2"), left, right, row["base"])
            sizes = np.array(row["sizes"], dtype=np.int64)
            ends = np.cumsum(sizes)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError(f"block {row['part']}, {row['block']} is damaged")
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            n = len(sizes)
            yield pa.record_batch({"part": pa.array([row["part"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                                   "before": pa.array(ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per text in the files: ``doc_id, start`` (ids of all texts before it), ``n_tokens, ids_crc32`` of the decoded ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    held = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = held.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per task of the writer, then one row per block within each
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_block")).join(parts, "part")
    offsets = small_side(offsets.select("part", "block", (F.col("_part") + F.col("_block")).alias("_from")))
    rows = blocks.mapInArrow(_decoded, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("_from") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            left, right, lengths = (np.array(row[c], dtype=np.int64) for c in ("left", "right", "lengths"))
            symbols, ends = np.frombuffer(row["symbols"], dtype="<u2"), np.cumsum(row["sizes"])
            for at in row["places"]:
                n = row["sizes"][at]
                ids = decode_range(symbols, left, right, lengths, row["base"], int(ends[at]) - n, n)
                yield pa.record_batch({"doc_id": pa.array([row["doc_ids"][at]], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` (with the end id) of the texts whose ``doc_id`` is in ``wanted``; only their ranges of a block are decoded.

    The ids of all blocks are looked through first, without their symbols. A doc_id of several texts gives a row each,
    an unknown one none; a null doc_id asks for nothing.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    found = places.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = small_side(cut_lineage(found.groupBy("part", "block").agg(F.collect_list("place").alias("places"))))
    return blocks.join(found, ["part", "block"]).mapInArrow(_picked, "doc_id long, ids array<int>")
