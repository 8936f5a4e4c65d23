"""Neighbours and density clusters found by joins, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import points as P
from furrow.operators.graph import components


@pytest.fixture(scope="module")
def clouds(spark):
    """Groups: clumps with far outliers and repeated points, a few points, one point."""
    draws = np.random.default_rng(3)
    clumps = np.concatenate([draws.normal(c, 0.05, (170, 3)) for c in ((0, 0, 0), (1, 1, 0), (5, 0, 2), (0.35, 0, 0))])
    first = np.concatenate((clumps, draws.uniform(-30, 30, (15, 3)), np.repeat(clumps[:1], 6, 0)))
    rows = [(1, i, *map(float, p)) for i, p in enumerate(first)] + [(2, 10_000 + i, float(i), 0.0, 0.0) for i in range(5)] + [(3, 20_000, 1.0, 2.0, 3.0)]
    return rows, spark.createDataFrame(rows, "file_id long, pid long, x double, y double, z double").repartition(3)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {g: (np.array([r[1] for r in own]), np.array([r[2:] for r in own])) for g, own in out.items()}


@pytest.mark.parametrize("small", [P.SMALL, 1])
def test_neighbours(clouds, monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)
    rows, df = clouds
    got = {}
    for r in P.neighbours(df, "file_id", 4).collect():
        got.setdefault(r["pid"], []).append((r["n"], r["d"], r["other"]))
    for ids, at in by_group(rows).values():
        d = np.sqrt(((at[:, None] - at) ** 2).sum(2))
        for i, pid in enumerate(ids):
            near = [k for k in np.lexsort((ids, d[i])) if k != i][:4]
            own = sorted(got.get(pid, []))
            assert [x[0] for x in own] == list(range(1, len(near) + 1))
            assert [x[1] for x in own] == pytest.approx(d[i][near])
            assert all(x[1] > 0 or x[2] in ids for x in own)


def test_mean_distance_of_one_point(clouds):
    _, df = clouds
    got = {r["pid"]: r["near"] for r in P.mean_neighbour_distance(df, "file_id", 3).collect()}
    assert np.isnan(got[20_000]) and got[10_000] == pytest.approx(2) and len(got) == df.count()


def brute_clusters(ids, at, eps, least):
    order = np.argsort(ids)
    ids, at = ids[order], at[order]
    near = ((at[:, None] - at) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    labels, number = np.full(len(ids), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        stack = [i]
        labels[i] = number
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if core[j] and labels[j] < 0:
                    labels[j] = number
                    stack.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        reached = labels[near[i] & core]
        labels[i] = reached.min() if len(reached) else -1
    return dict(zip(ids.tolist(), labels.tolist(), strict=True))


@pytest.mark.parametrize(("eps", "least"), [(0.12, 4), (0.03, 3), (1.0, 2)])
def test_clusters(clouds, eps, least):
    rows, df = clouds
    want = {}
    for ids, at in by_group(rows).values():
        want |= brute_clusters(ids, at, eps, least)
    assert {r["pid"]: r["cluster"] for r in P.clustered(df, "file_id", eps, least).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (300, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[40] == 0 and got[300] == 0 and got[102] == 100 and 200 not in got


def test_pairs_of_a_cell_are_no_rows(spark):
    points = spark.range(200).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("pid"), *[(F.col("id") * s % 17).cast("double").alias(c) for c, s in zip("xyz", (3, 5, 7), strict=True)])
    near = P.neighbours(points, "file_id", 4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and plan.count("Window [") == 1  # that of the arrays, not of the pairs
    assert near.count() == 800
