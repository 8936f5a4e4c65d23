"""Hierarchical density clusters on clouds whose clusters are known, and its parts against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from furrow.operators import hierarchy as H
from furrow.operators import scenes as S


def clumps(*parts, noise=0, seed=1):
    draws = np.random.default_rng(seed)
    p = np.concatenate([draws.normal(centre, spread, (n, 3)) for centre, spread, n in parts] + [draws.uniform(-20, 20, (noise, 3))])
    return p, np.repeat(np.arange(len(parts) + 1), [*(n for _, _, n in parts), noise])


def test_spanning_tree_is_least():
    p = np.random.default_rng(5).normal(size=(30, 3))
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    part, total = list(range(30)), 0.0
    for w, a, b in sorted((reach[a, b], a, b) for a, b in itertools.combinations(range(30), 2)):
        if part[a] != part[b]:
            total += w
            part = [part[a] if x == part[b] else x for x in part]
    u, v, w = H.spanning_tree(p, 4)
    assert w.sum() == pytest.approx(total) and len(u) == 29 and (np.diff(w) >= 0).all()


def prim(p, min_samples):
    """One point after the other over all pairs."""
    n = len(p)
    core = np.array([np.sort(((p - q) ** 2).sum(1))[min(min_samples, n) - 1] for q in p])
    best, link, out, at, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        out[at] = True
        d = np.maximum(np.maximum(((p - p[at]) ** 2).sum(1), core), core[at])
        nearer = ~out & (d < best)
        best[nearer], link[nearer] = d[nearer], at
        at = int(np.where(out, np.inf, best).argmin())
        edges.append((link[at], at, np.sqrt(best[at])))
    return sorted(edges, key=lambda e: e[2])


@pytest.mark.parametrize("kind", ["normal", "grid", "equal", "clumps"])
def test_tree_is_that_of_all_pairs(kind):
    """Edges and their order, also of equally near points, are those of a walk over all pairs."""
    draws, n = np.random.default_rng(11), 900
    p = {"normal": draws.normal(size=(n, 3)), "grid": draws.integers(0, 7, (n, 3)).astype(float), "equal": np.zeros((300, 3)), "clumps": clumps(((0, 0, 0), 0.05, n // 2), ((9, 0, 0), 0.4, n // 2))[0]}[kind]
    for k in (3, 70):
        assert list(zip(*(x.tolist() for x in H.spanning_tree(p, k)))) == prim(p, k)


def test_distances_grow_with_points(monkeypatch):
    """Four times the points take far less than sixteen times the distances."""
    looked, squares = [], H._squares
    monkeypatch.setattr(H, "_squares", lambda a, b: looked.append(np.broadcast(a, b).size // 3) or squares(a, b))
    sums = []
    for n in (2000, 8000):
        looked.clear()
        H.spanning_tree(np.random.default_rng(11).normal(size=(n, 3)), 3)
        sums.append(sum(looked))
    assert sums[1] < 8 * sums[0] and sums[1] < 8000**2


def test_clumps_of_different_density():
    p, truth = clumps(((0, 0, 0), 0.05, 80), ((3, 0, 0), 0.4, 80), ((0, 6, 0), 0.1, 60), noise=10)
    got = H.labels(p, 15, 5, single=False)
    for k in range(3):
        names, counts = np.unique(got[truth == k], return_counts=True)
        assert counts.max() >= 0.85 * (truth == k).sum() and names[counts.argmax()] >= 0
    assert len({int(np.bincount(got[truth == k] + 1).argmax()) for k in range(3)}) == 3
    assert (got[truth == 3] == -1).mean() >= 0.8


def test_one_clump():
    p, truth = clumps(((0, 0, 0), 0.1, 100), noise=5)
    assert (H.labels(p, 20, 5, epsilon=0.3)[truth == 0] == 0).mean() > 0.9
    assert set(H.labels(p[:8], 20, 5)) == {-1} and len(H.labels(p[:0], 20, 5)) == 0
    assert set(H.labels(np.zeros((30, 3)), 5, 3)) == {0}


def test_near_clusters_are_merged():
    p, _ = clumps(((0, 0, 0), 0.03, 60), ((0.3, 0, 0), 0.03, 60), ((9, 0, 0), 0.03, 60))
    assert len(set(H.labels(p, 10, 4, single=False)) - {-1}) == 3
    assert len(set(H.labels(p, 10, 4, single=False, epsilon=1.0)) - {-1}) == 2


def test_clustered_by_group(spark):
    p, truth = clumps(((0, 0, 0), 0.05, 40), ((3, 0, 0), 0.05, 40))
    rows = [(g, i, *map(float, x)) for g in (1, 2) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "file_id long, pid long, x double, y double, z double").repartition(3)
    got = {(r["file_id"], r["pid"]): r["cluster"] for r in H.clustered(df, "file_id", 10, 4, single=False).collect()}
    want = H.labels(p, 10, 4, single=False)
    assert got == {(g, i): want[i] for g in (1, 2) for i in range(80)}
    run = S.morphology(df, S.Morphology(outlier_k=8, clusterer="hdbscan", min_cluster_size=10))
    assert [r["n"] for r in run.orderBy("file_id").collect()] == [run.first()["n"]] * 2 and 30 <= run.first()["n"] <= 80
    with pytest.raises(ValueError):
        S.Morphology(clusterer="other")
