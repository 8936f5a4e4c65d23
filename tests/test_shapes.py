"""Axes, percentiles, hulls and smoothing splines as aggregates, against numpy on whole clouds."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import shapes as H
from furrow.operators import splines as L
from furrow.plans import point_queries as Q


def cloud(spark, groups):
    rows = [(g, *map(float, p)) for g, own in groups.items() for p in own]
    return spark.createDataFrame(rows, "g long, x double, y double, z double").repartition(5)


def test_axes(spark):
    draws = np.random.default_rng(2)
    turn = np.linalg.qr(draws.normal(size=(3, 3)))[0]
    groups = {
        1: draws.normal(size=(300, 3)) * [3, 1, 0.2] @ turn + 5, 2: draws.normal(size=(40, 3)) * [1e-3, 1e3, 1], 3: np.array([[1.0, 2, 3]]), 4: np.array([[0.0, 0, 0], [1, 1, 1], [2, 2, 2]]),
        5: np.array(list(itertools.product((0, 1), repeat=3)), float), 6: draws.normal(size=(9, 3)) * [1, 1, 0],
    }
    for r in H.frames(cloud(spark, groups), "g").collect():
        p = groups[r["g"]]
        cov = np.cov(p.T) if len(p) > 1 else np.zeros((3, 3))
        values = np.sort(np.linalg.eigvalsh(cov))[::-1]
        axes = np.array(r["axes"]).reshape(3, 3)
        assert np.allclose(r["values"], values, atol=1e-12 * max(1, values[0])) and np.allclose(r["centre"], p.mean(0))
        assert np.allclose(axes @ axes.T, np.eye(3)) and np.allclose(axes @ cov @ axes.T, np.diag(r["values"]), atol=1e-9 * max(1, values[0]))
        assert all(v[np.abs(v).argmax()] > 0 for v in axes)


def test_percentiles(spark):
    """One group holds nearly all rows, one a single row, and values repeat."""
    draws = np.random.default_rng(1)
    groups = {1: np.round(draws.normal(size=5000), 1), 2: np.array([4.0]), 3: draws.normal(size=7), 4: np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own], "g long, v double")
    shares = [0.005, 0.25, 0.5, 0.995, 1.0, 0.0]
    got = {r["g"]: r["p"] for r in H.percentiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, own in groups.items():
        assert got[g] == pytest.approx(np.percentile(own, [100 * s for s in shares]).tolist())


def brute_hull(p):
    """Volume from every triangle that has all points on one side."""
    total, inside = 0.0, p.mean(0)
    for a, b, c in itertools.combinations(range(len(p)), 3):
        side = (p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            total += abs(np.linalg.det(np.stack((p[a] - inside, p[b] - inside, p[c] - inside)))) / 6
    return total


def test_hulls_of_whole_clouds(spark):
    for r in H.hull_volumes(Q.cloud(spark, "/root/testdata/sf0.001"), "file_id").collect():
        own = np.array([(x["x"], x["y"], x["z"]) for x in Q.cloud(spark, "/root/testdata/sf0.001").filter(F.col("file_id") == r["file_id"]).collect()])
        assert r["volume"] == pytest.approx(brute_hull(own))


def test_hulls_in_parts(spark):
    """Flat, small, repeated and boxed clouds; one whose points are all corners, in more chunks than one."""
    draws = np.random.default_rng(4)
    ball = draws.normal(size=(900, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    grid = np.array(list(itertools.product(range(6), repeat=3)), float)
    groups = {1: ball, 2: grid, 3: grid[:, [0, 1, 1]] * [1, 1, 0], 4: np.array([[1.0, 1, 1]]), 5: np.repeat(grid[:8] ** 2 + [[0, 0, 1]] * 8, 3, 0), 6: draws.uniform(size=(3000, 3))}
    want = {g: H.volume(p) for g, p in groups.items()}
    assert want[2] == pytest.approx(125) and want[3] == want[4] == 0 and want[1] == pytest.approx(4 / 3 * np.pi, rel=0.02)
    for chunk in (H.CHUNK, 100):
        got = {r["g"]: r["volume"] for r in H.hull_volumes(cloud(spark, groups), "g", chunk).collect()}
        assert got == {g: pytest.approx(v, abs=1e-12) for g, v in want.items()}


def test_a_million_points(spark):
    """One cloud over all tasks: its box's eight corners are far out, so that the volume is known."""
    n = 1_000_000
    inner = spark.range(n).select(F.lit(1).cast("long").alias("g"), *[((F.xxhash64("id", F.lit(k)) % 1_000_003) / 1_000_003.0).alias(c) for k, c in enumerate("xyz")])
    outer = spark.createDataFrame([(1, *map(float, p)) for p in itertools.product((-2, 2), repeat=3)], inner.schema)
    (row,) = H.hull_volumes(inner.unionByName(outer), "g").collect()
    assert row["volume"] == pytest.approx(64)


def dense(x, y, value):
    """The same spline from all points at once: least squares on the points, and the residual met by halving."""
    order = np.lexsort((y, x))
    x, y, m = x[order], y[order], len(x)
    ranks, before, adds = [], 0.0, 0

    def design(t, at):
        rows = np.zeros((len(at), len(t) - 4))
        for i, v in enumerate(at):
            span = min(max(int(np.searchsorted(t, v, "right")) - 1, 3), len(t) - 5)
            rows[i, span - 3 : span + 1] = L.bases(t, np.array([v]), span)[0]
        return rows

    while True:
        t = np.concatenate(([x[0]] * 4, np.sort(x[ranks]), [x[-1]] * 4)).astype(float)
        a = design(t, x)
        c = np.linalg.lstsq(a, y, rcond=None)[0]
        miss = (a @ c - y) ** 2
        over = miss.sum() - value
        if abs(over) < 1e-3 * value or over < 0:
            break
        if adds:
            fell = before - miss.sum()
            adds = min(adds * 2, max(int(adds * over / fell) if fell > 1e-3 * value else adds * 2, adds // 2, 1))
        adds, before = adds or 1, miss.sum()
        cuts = sorted(ranks)
        left = [miss[i + 1 : j].sum() + (miss[i] / (1 if i == 0 else 2)) + miss[j] / (1 if j == m - 1 else 2) for i, j in zip([0, *cuts], [*cuts, m - 1])]
        ranks += L.more_knots(cuts, m - 1, left, adds)
    if over < -1e-3 * value and ranks:
        rough = L.jumps(t)
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            c = np.linalg.lstsq(np.concatenate((a, np.exp(mid) * rough)), np.concatenate((y, np.zeros(len(rough)))), rcond=None)[0]
            low, high = (mid, high) if ((a @ c - y) ** 2).sum() < value else (low, mid)
    at = np.linspace(*np.percentile(x, [0.5, 99.5]), 1000)
    fit = design(t, at) @ c
    length = np.hypot(np.diff(at), np.diff(fit)).sum()
    return length, length / np.hypot(at[-1] - at[0], fit[-1] - fit[0]), len(ranks)


def test_splines_follow_curves(spark):
    draws = np.random.default_rng(6)
    x = np.sort(draws.uniform(0, 10, 240))
    groups = {
        1: (x, np.sin(3 * x) * 2), 2: (x, np.abs(x - 4) * 3 + draws.normal(0, 0.05, 240)), 3: (x, 0.01 * x**3 - x), 4: (x[:60], np.sign(x[:60] - 1) + draws.normal(0, 0.2, 60)),
        5: (np.round(x), np.sin(x) * 3), 6: (np.array([0.0, 1, 2, 2]), np.array([0.0, 1, 3, 5])), 7: (np.array([1.0, 1]), np.array([0.0, 2])),
    }
    rows = spark.createDataFrame([(g, float(a), float(b)) for g, own in groups.items() for a, b in zip(*own)], "g long, x double, y double").repartition(3)
    got = {r["g"]: (r["length"], r["curvature"]) for r in L.axis_lengths(rows, "g").collect()}
    assert got.keys() == groups.keys()
    knots = {}
    for g in (1, 2, 3, 4):
        length, curvature, knots[g] = dense(*groups[g], 1.0)
        assert got[g] == pytest.approx((length, curvature), rel=1e-6)
    assert knots[3] == 0 and knots[1] > 8 and knots[2] > 0
    assert got[1][0] == pytest.approx(np.hypot(np.diff(np.linspace(*np.percentile(x, [0.5, 99.5]), 4000)), np.diff(2 * np.sin(3 * np.linspace(*np.percentile(x, [0.5, 99.5]), 4000)))).sum(), rel=0.05)
    assert got[6][0] > 0 and got[7][0] == 0 and np.isnan(got[7][1])
