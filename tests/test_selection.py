"""Order statistics and the top n of groups against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from litradar.operators import selection
from litradar.operators.filters import newest_per_source
from litradar.operators.ranking import top_ranked


def groups(seed, sizes):
    r = random.Random(seed)
    kinds = [lambda: r.random(), lambda: round(r.random(), 2), lambda: 5.0, lambda: r.choice([-1e9, 0.0, 1e9]) + r.random(), lambda: r.choice([None, 1.0, 2.0])]
    rows = []
    for g, n in enumerate(sizes):
        rows += [(g, i, kinds[g % len(kinds)]()) for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_rows", [5, 100_000])
def test_values_at_places(spark, monkeypatch, range_rows):
    monkeypatch.setattr(selection, "BINS", 8)
    rows = groups(1, (300, 200, 50, 200, 60, 1))
    frame = spark.createDataFrame(rows, "g int, ordinal long, v double")
    want, asked = {}, []
    for g in range(6):
        ordered = sorted((v for k, _, v in rows if k == g and v is not None), reverse=True)
        for at in {0, len(ordered) // 20, len(ordered) // 2, len(ordered) - 1}:
            asked.append((g, at))
            want[g, at] = ordered[at]
    asked += [(0, 300), (0, -1), (9, 0)]  # no such places
    got = selection.values_at(frame, ["g"], spark.createDataFrame(asked, "g int, at long"), "v", range_rows).collect()
    assert {(r.g, r["at"]): r.v for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n", [1, 7, 150, 1000])
def test_top_n_of_each_group(spark, monkeypatch, n):
    monkeypatch.setattr(selection, "BINS", 8)
    rows = groups(2, (300, 200, 50, 200, 400)) + [(None, i, float(i % 3)) for i in range(30)]
    frame = spark.createDataFrame(rows, "g int, ordinal long, v double").withColumn("_tie", F.lit(1))
    got = selection.top_n(frame, ["g"], F.col("v"), "ordinal", n, range_rows=5)
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None else -math.inf), r[1]))[:n]
    assert got.columns == frame.columns
    assert sorted(((r.g, r.ordinal, r.v) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_large_limits_equal_the_window(spark):
    r = random.Random(3)
    rows = [(r.choice(["arxiv", "crossref", None]), i, 1_700_000_000 + r.randrange(900)) for i in range(9_000)]
    works = spark.createDataFrame(rows, "source string, ordinal long, s long").withColumn("published", F.when(F.col("ordinal") % 50 > 0, F.timestamp_seconds("s")))
    got = {(x.source, x.ordinal) for x in newest_per_source(works, 2_500).collect()}
    want = set()
    for source in ("arxiv", "crossref", None):
        own = sorted((x for x in rows if x[0] == source), key=lambda x: (x[1] % 50 == 0, -x[2] if x[1] % 50 else 0, x[1]))
        want |= {(source, x[1]) for x in own[:2_500]}
    assert got == want
    scored = works.select(F.lit(1).alias("profile_id"), "ordinal", (F.col("s") % 7).alias("score"))
    best = top_ranked(scored, 3_000).collect()
    assert [x.ordinal for x in sorted(best, key=lambda x: x["rank"])] == [x[1] for x in sorted(rows, key=lambda x: (-(x[2] % 7), x[1]))[:3_000]]
