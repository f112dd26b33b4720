"""Token-set ratio and the title joins against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from litradar.functions.titles import common_length, token_set_ratio
from litradar.operators import dedupe
from litradar.operators.dedupe import near_equal_titles, overlapping_titles, similar_titles


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def slow_ratio(a, b):
    """From whole strings: S against S+A, S+B, and S+A against S+B."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    s = " ".join(sorted(left & right))
    one = (s + " " + " ".join(sorted(left - right))).strip()
    two = (s + " " + " ".join(sorted(right - left))).strip()
    if s and (s == one or s == two):
        return 100.0
    pairs = [(one, two)] + ([(s, one), (s, two)] if s else [])
    return max(100.0 * 2 * slow_common(x, y) / (len(x) + len(y)) for x, y in pairs)


words = st.lists(st.text("abc", min_size=1, max_size=5), max_size=6).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_ratio_equals_whole_string_form(a, b):
    assert abs(token_set_ratio(a, b) - slow_ratio(a, b)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=80), st.text("abcd ", max_size=80))
def test_common_length(a, b):
    assert common_length(a, b) == slow_common(a, b)


def test_known_ratios():
    assert token_set_ratio("deep learning", "a survey of deep learning") == 100.0
    assert token_set_ratio("", "deep") == 0.0
    assert token_set_ratio("machine lerning for images", "machine learning for images") > 90


def titles(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    out = set()
    for _ in range(n):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4 and out:
            tokens = rng.choice(sorted(out)).split()
            i = rng.randrange(len(tokens))
            word = list(tokens[i])
            word[rng.randrange(len(word))] = rng.choice("abcdefgh")
            tokens[i] = "".join(word)
            if rng.random() < 0.3:
                tokens.append(rng.choice(vocabulary))
        out.add(" ".join(sorted(set(tokens))))
    return sorted(out)


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "tkey string")


def test_similar_titles_equal_all_pairs(spark):
    for threshold in (0.9, 0.8):
        a, b = titles(1, 150), titles(2, 150) + titles(1, 40)
        want = {(x, y) for x in a for y in b if token_set_ratio(x, y) / 100 >= threshold}
        got = {tuple(r) for r in similar_titles(frame(spark, a), frame(spark, b), threshold).collect()}
        assert got == want
        assert len(want) > 40


def test_small_blocks_change_nothing(spark):
    keys = frame(spark, titles(3, 200))
    whole = {tuple(r) for r in near_equal_titles(keys, keys, self_join=True).collect()}
    cut = {tuple(r) for r in near_equal_titles(keys, keys, self_join=True, block_rows=7).collect()}
    assert whole == cut and whole


def test_containment_is_found_through_rare_tokens(spark):
    small = frame(spark, ["deep learning"])
    big = frame(spark, [" ".join(sorted(["deep", "learning", f"topic{i}"])) for i in range(50)] + ["deep sea"])
    assert overlapping_titles(small, big).count() == 50


def test_a_long_title_is_written_once_not_once_per_token(spark, monkeypatch):
    """Token rows carry numbers, so what is shuffled and stored follows the tokens and not their square."""
    stored = []

    def watched(df):
        stored.append(sum(len(v) for row in df.collect() for v in row if isinstance(v, str)))
        return spark.createDataFrame(df.collect(), df.schema)

    monkeypatch.setattr(dedupe, "cut_lineage", watched)
    long = " ".join(f"w{i:04d}" for i in range(300))
    found = {tuple(r) for r in overlapping_titles(frame(spark, [long]), frame(spark, [long, "w0007"])).collect()}
    assert found == {(long, long), (long, "w0007")}
    assert sum(stored) <= 2 * (len(long) + 5)


def test_marks_lose_no_overlap(spark):
    """Titles that miss tokens of every length class, up to what the threshold allows."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 20, 24)]
    a = [" ".join(sorted(set(base)))]
    b = sorted({" ".join(sorted(set(rng.sample(base, rng.randint(6, 12)) + ["zz" * rng.randint(1, 9)]))) for _ in range(200)})
    want = {(x, y) for x in a for y in b if token_set_ratio(x, y) / 100 >= 0.9}
    assert {tuple(r) for r in similar_titles(frame(spark, a), frame(spark, b)).collect()} == want and want
