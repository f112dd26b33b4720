"""Hand-made tables with the rows that break things, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["an", "the", "or", "sun", "mi", "ét", "ka", "lo"]) for _ in range(r.randint(1, 3))) for _ in range(n)]


def edited(words: list[str], every: int) -> list[str]:
    return [w + "x" if i % every == every - 1 else w for i, w in enumerate(words)]


LONG = prose(1, 400)
PASSAGE = prose(2, 80)
ITEM = "Which of the Seven rivers, runs north from the old mill to the sea? nobody knows"


def documents() -> pd.DataFrame:
    texts = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, "ONE  two\nthree"), (5, " ".join(LONG)), (6, " ".join(edited(LONG, 100))),
        (7, " ".join(edited(LONG, 12))), (8, " ".join(edited(edited(LONG, 100), 90))), (8, " ".join(edited(edited(LONG, 100), 90))),
        (9, " ".join(PASSAGE + prose(3, 60))), (10, " ".join(prose(4, 50) + PASSAGE)), (11, " ".join(PASSAGE[:20] + prose(5, 3))),
        (12, "so: which of the seven rivers runs NORTH from the old mill to the sea?? nobody. " + ITEM), (13, "ha ha ha ha ha ha ha ha ha ha ha ha " * 60),
        (14, "1234 %% · 5"), (15, "x" * 5000), (16, "Released under the MIT License.\n" + " ".join(prose(6, 30))), (None, "a text without an id " * 3), (None, None),
        (17, "tiny"), (18, " ".join(prose(7, 30_000))), (19, "a b c\x1cd <|endoftext|> don't 3.14 \U0001f600́"),
    ]
    n = len(texts)
    frame = pd.DataFrame({"doc_id": pd.array([d for d, _ in texts], dtype="Int64"), "text": [t for _, t in texts]})
    frame["lang"] = [None if i % 7 == 3 else ["en", "fr"][i % 2] for i in range(n)]
    frame["source"] = [None if i % 5 == 4 else f"src{i % 3}" for i in range(n)]
    frame["n_chars"] = [len(t or "") for _, t in texts]
    # columns that an operator might use itself
    for name in ("_h", "cid", "words", "pos", "token", "size", "score", "lang_pred", "held_out", "epoch", "budget", "n_tokens", "hub", "gram", "spans", "_text", "_d", "_x"):
        frame[name] = 1
    return frame


def benchmark() -> pd.DataFrame:
    return pd.DataFrame({"item_id": [1, 2, 3, 4, 10], "text": [ITEM, None, "", "tiny", " ".join(PASSAGE[5:20])], "window": 1, "token": 2})


def words(text: str | None, pattern: str) -> list[str]:
    return re.findall(pattern, (text or "").translate(LOW))


def near_groups(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, t in rows:
        w = words(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        component = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), component, bool(d == component)))
    return out


def hits(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for item, t in items:
        w = words(t, pattern)
        if w:
            windows += [(str(item), w[i : i + 10]) for i in range(max(len(w) - 10, 0) + 1)]
    out = []
    for d, t in rows:
        w = words(t, pattern)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def without_repeats(rows: list[tuple], width: int = 200) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out
