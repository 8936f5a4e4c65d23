"""Running sums, last rows before a place, weighted draws and evolved anchors, against plain loops."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import sampling as D
from furrow.operators import scenes as S


@pytest.fixture(scope="module")
def items(spark):
    """One group holds nearly all items; weights of 0, a group of which all are 0, a group of one."""
    draws = np.random.default_rng(1)
    rows = [(1, i, int(w)) for i, w in enumerate(draws.integers(0, 50, 3000))] + [(2, 5, 7)] + [(3, i, 0) for i in range(4)] + [(4, i, i % 3) for i in range(30)]
    return rows, spark.createDataFrame(rows, "g long, item long, w long").repartition(7)


def test_cumulated(items):
    rows, df = items
    got = {(r["g"], r["item"]): r["before"] for r in D.cumulated(df, ["g"], [F.col("item")], "w").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        want |= {(g, r[1]): b for r, b in zip(own, accumulate([0, *(r[2] for r in own)]))}
    assert got == want


def test_weighted_draws(spark, items):
    rows, df = items
    draws = [(g, i, (i * 7919 % 10_007) / 10_007) for g in (1, 2, 3, 4, 5) for i in range(2000)]
    frame = spark.createDataFrame(draws, "g long, draw long, share double")
    got = {(r["g"], r["draw"]): r["item"] for r in D.weighted_draws(df, frame, ["g"], "item", "w").collect()}
    want = {}
    for g in (1, 2, 4):
        own = sorted(r for r in rows if r[0] == g and r[2])
        starts = [0, *accumulate(r[2] for r in own)]
        want |= {(g, i): own[bisect.bisect_right(starts, math.floor(s * starts[-1])) - 1][1] for h, i, s in draws if h == g}
    assert got == want
    drawn = Counter(v for (g, _), v in got.items() if g == 4)
    assert set(drawn) == {i for g, i, w in rows if g == 4 and w} and drawn[2] > drawn[1]


def test_last_before(spark):
    """Places before any item, at an item, and long after the last, over many ranges."""
    rng = np.random.default_rng(3)
    own = sorted({int(x) for x in rng.integers(0, 10**6, 300)})
    places = [int(x) for x in rng.integers(-1000, 2 * 10**6, 1000)] + own[:50]
    items = spark.createDataFrame([(1, x, x * 10) for x in own], "g long, at long, item long")
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(places)] + [(2, 0, 5)], "g long, i long, at long").repartition(6)
    got = {(r["g"], r["i"]): r["item"] for r in D.last_before(frame, items, ["g"], "at").collect()}
    want = {(1, i): own[bisect.bisect_right(own, x) - 1] * 10 if x >= own[0] else None for i, x in enumerate(places)} | {(2, 0): None}
    assert got == want


def fitness(sizes, anchors):
    r = sizes[:, None] / np.array(anchors)[None]
    best = np.minimum(r, 1 / r).min(2).max(1)
    return float((best * (best > S.FITS)).mean())


def test_evolved_anchors(spark):
    draws = np.random.default_rng(2)
    sizes = np.round(np.abs(draws.normal(size=(800, 2))) * [80, 30] + 3)
    df = spark.createDataFrame([tuple(map(float, s)) for s in sizes], "w double, h double")
    start = [(r["w"], r["h"]) for r in S.fitted_anchors(df, 4).orderBy("anchor").collect()]
    best, fit, own, rose = start, fitness(sizes, start), np.random.default_rng(5), 0
    for _ in range(5):
        sets = S.mutations(best, 32, own)
        scores = [fitness(sizes, s) for s in sets]
        at = int(np.argmax(scores))
        if scores[at] > fit:
            best, fit, rose = sets[at], scores[at], rose + 1
    got = S.evolved_anchors(df, 4, 5, 32, 5).orderBy("anchor").collect()
    assert rose and fit > fitness(sizes, start)
    assert [[r["w"], r["h"]] for r in got] == pytest.approx(np.array(sorted(best, key=lambda b: b[0] * b[1])))
    assert [r["fitness"] for r in got] == pytest.approx([fit] * 4)
    assert S.evolved_anchors(df.limit(0), 4, 2).count() == 0
