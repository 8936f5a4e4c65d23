"""Convex polygons and the best match among them, against plain loops over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import polygons as G
from furrow.operators import overlap as O
from furrow.plans import catalogue, fixtures

POINTS = "array<struct<x:double,y:double>>"


def inside(poly, c):
    turn = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b in zip(poly, [*poly[1:], poly[0]])]
    return all(t >= 0 for t in turn) or all(t <= 0 for t in turn)


def shared(p, q):
    """Area by the corners of both inside the other and all crossings, in order around their middle."""
    found = [c for c in p if inside(q, c)] + [c for c in q if inside(p, c)]
    for a, b in zip(p, [*p[1:], p[0]]):
        for c, d in zip(q, [*q[1:], q[0]]):
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    found.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    if len(found) < 3:
        return 0.0
    mx, my = np.mean(found, 0)
    found.sort(key=lambda c: math.atan2(c[1] - my, c[0] - mx))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(found, [*found[1:], found[0]]))) / 2


def apart(p, q):
    def side(c, a, b):
        a, b, c = map(np.array, (a, b, c))
        t = np.clip((c - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1)
        return float(np.linalg.norm(a + t * (b - a) - c))

    return min(side(c, a, b) for u, v in ((p, q), (q, p)) for c in u for a, b in zip(v, [*v[1:], v[0]]))


def polygon(draws, spread, size):
    """Corners on an ellipse, so that they are convex, either way round."""
    n = int(draws.integers(3, 8))
    turn = np.sort(draws.uniform(0, 2 * np.pi, n))[:: int(draws.choice([1, -1]))]
    cx, cy = draws.uniform(0, spread, 2)
    return [(float(cx + size * np.cos(t)), float(cy + 0.6 * size * np.sin(t))) for t in turn]


def test_overlap_and_distance(spark):
    draws = np.random.default_rng(7)
    pairs = [(polygon(draws, 30, 12), polygon(draws, 30, 12)) for _ in range(200)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    pairs += [(square, square), (square, [(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]), (square, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)]), ([(-9.0, -9.0), (20.0, -9.0), (20.0, 30.0)], square)]
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], f"i int, p {POINTS}, q {POINTS}")
    for r in df.select("i", G.overlap(F.col("p"), F.col("q")).alias("o"), G.distance(F.col("p"), F.col("q")).alias("d"), G.area(F.col("p")).alias("a")).collect():
        p, q = pairs[r["i"]]
        assert r["o"] == pytest.approx(shared(p, q), abs=1e-9)
        assert r["a"] == pytest.approx(shared(p, p))
        if not r["o"]:
            assert r["d"] == pytest.approx(apart(p, q), abs=1e-9)


@pytest.mark.parametrize("reach", [16.0, 1.0])
def test_best_or_nearest(spark, reach):
    """Crowds, lone shapes far away, ties, and a group without any other shape."""
    draws = np.random.default_rng(9)
    shape = lambda g: polygon(draws, 60 if g == 1 else 3000, 6)
    queries = [(g, i, shape(g)) for g in (1, 2, 3) for i in range(40)]
    others = [(g, i, shape(g)) for g in (1, 2) for i in range(25)]
    others += [(2, 100, others[30][2]), (2, 99, others[30][2])]

    def frame(rows):
        df = spark.createDataFrame(rows, f"g long, id long, shape {POINTS}")
        return df.select("*", *[c.alias(n) for c, n in zip(G.bounds(F.col("shape")), O.CORNERS)])

    got = {(r["g"], r["a_id"]): (r["b_id"], r["overlap"], r["distance"]) for r in O.best_or_nearest(frame(queries), frame(others), ["g"], G.overlap, G.distance, reach).collect()}
    want = {}
    for g, i, p in queries:
        own = [(j, q) for h, j, q in others if h == g]
        if not own:
            continue
        areas = [(-round(shared(p, q), 9), j) for j, q in own]
        area, j = min(areas)
        want[g, i] = (j, pytest.approx(-area, abs=1e-6), 0) if area else (min((round(apart(p, q), 9), j) for j, q in own)[1], 0, pytest.approx(min(apart(p, q) for _, q in own)))
    assert got == want


def test_pairs_are_not_interpreted(spark):
    """Pairs of polygons go to numpy in batches; a polygon without corners shares nothing and is nowhere."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(0, square, None), (1, None, square), (2, [], square), (3, square, square)], f"i int, p {POINTS}, q {POINTS}").repartition(3)
    got = df.select("i", G.overlap(F.col("p"), F.col("q")).alias("o"), G.distance(F.col("p"), F.col("q")).alias("d"))
    assert "lambda" not in got._jdf.queryExecution().toString()
    assert {r["i"]: (r["o"], r["d"]) for r in got.collect()} == {0: (0, None), 1: (0, None), 2: (0, None), 3: (16, 0)}


def test_few_rounds_and_one_read(spark, sf_dir, monkeypatch):
    """What is far away is found in few rounds, and a query reads its table once."""
    rounds, join = [], O.overlap_join
    monkeypatch.setattr(O, "overlap_join", lambda *a, **k: rounds.append(1) or join(*a, **k))
    frame = lambda rows: spark.createDataFrame(rows, "g long, id long, x1 double, y1 double, x2 double, y2 double").select("*", F.struct(*O.CORNERS).alias("shape"))
    got = O.best_or_nearest(frame([(1, 0, 0.0, 0.0, 1.0, 1.0), (1, 1, 899.5, 0.0, 900.5, 1.0), (2, 2, 0.0, 0.0, 1.0, 1.0)]), frame([(1, 7, 900.0, 0.0, 901.0, 1.0), (1, 8, 901.0, 0.0, 903.0, 1.0)]), ["g"], reach=1.0)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 7, 0.0, 899.0), (1, 1, 7, 0.5, 0.0)]
    assert len(rounds) <= 6
    reads, table = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda *a: reads.append(a[2]) or table(*a))
    for name in ("best_match_or_nearest", "quad_best_match"):
        reads.clear()
        catalogue.QUERIES[name](spark, sf_dir)
        assert reads == ["lineitem"]
