"""Hierarchical density clusters of point clouds: the most stable clusters over all densities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .points import XYZ


@dataclass
class Cluster:
    """A cluster of the condensed tree: where it comes from, and the density (1 over distance) at which it begins."""

    parent: int
    birth: float
    children: list[int] = field(default_factory=list)
    stability: float = 0.0


#: Points of a leaf into which a cloud is cut, and most distances that are held at a time, but for those of one point.
LEAF, MOST = 64, 1 << 20


def _leaves(p: np.ndarray) -> np.ndarray:
    """Points by leaf, halved at the median of the widest side; a row each in ascending order, filled up with -1."""
    rows, stack = [], [np.arange(len(p))]
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            rows.append(np.pad(np.sort(own), (0, LEAF - len(own)), constant_values=-1))
        else:
            half = np.argpartition(p[own, np.ptp(p[own], axis=0).argmax()], len(own) // 2)
            stack += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return np.array(rows)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points whose coordinates lie in the first axis."""
    d = a - b
    d *= d
    return d[0] + d[1] + d[2]


def _gaps(low: np.ndarray, high: np.ndarray, from_low: np.ndarray, from_high: np.ndarray) -> np.ndarray:
    """Least squared distances of boxes from a box: no point of one is nearer to the other, also when rounded."""
    return _squares(np.maximum(np.maximum(low - from_high, from_low - high), 0.0), np.zeros((3, 1)))


def spanning_tree(p: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, distance) of a minimum spanning tree by mutual reachability, by distance.

    The distance of two points is at least that of each to its min_samples-th point, itself
    included. One point joins at a time, of equally near ones the first, to the first that is so near. Points lie in
    leaves, and only those leaves are looked at that could be nearer to the new point than they are to the tree.
    """
    n, k = len(p), min(min_samples, len(p)) - 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at_leaf = _leaves(p)
    real, place = at_leaf >= 0, np.zeros((n, 2), np.int64)
    place[at_leaf[real]] = np.argwhere(real)
    own = np.ascontiguousarray(p[at_leaf].transpose(2, 0, 1))  # coordinate, leaf, slot
    low, high = (f(np.where(real, own, end), axis=2) for f, end in ((np.min, np.inf), (np.max, -np.inf)))
    core, filled = np.empty(n), real.sum(1)
    for i in range(len(at_leaf)):
        mine = own[:, i, : filled[i]]
        to_own = _squares(mine[:, :, None], mine[:, None])
        reach = np.partition(to_own, k, axis=1)[:, k].max() if k < filled[i] else np.inf
        near = _gaps(low, high, low[:, i, None], high[:, i, None]) <= reach
        others = own[:, near][:, real[near]]
        rows = max(1, MOST // others.shape[1])
        for j in range(0, filled[i], rows):
            core[at_leaf[i, j : min(j + rows, filled[i])]] = np.partition(_squares(mine[:, j : j + rows, None], others[:, None]), k, axis=1)[:, k]
    cores = np.where(real, core[at_leaf], np.inf)  # infinite where there is no point, or one that has joined
    best, link, joined = np.full(real.shape, np.inf), np.zeros(real.shape, np.int64), ~real
    least_core, farthest, nearest, first = cores.min(1), np.full(len(real), np.inf), np.full(len(real), np.inf), at_leaf[:, 0].copy()
    at, edges = 0, []
    for _ in range(n - 1):
        leaf, slot = place[at]
        here = p[at][:, None]
        joined[leaf, slot], cores[leaf, slot], best[leaf, slot] = True, np.inf, np.inf
        reached = np.maximum(np.maximum(_gaps(low, high, here, here), least_core), core[at]) < farthest
        reached[leaf] = True
        t = np.flatnonzero(reached)
        d = np.maximum(np.maximum(_squares(own[:, t], here[:, :, None]), cores[t]), core[at])
        nearer = d < best[t]
        now = np.where(nearer, d, best[t])
        best[t], link[t] = now, np.where(nearer, at, link[t])
        farthest[t] = np.where(joined[t], -np.inf, now).max(1)
        nearest[t], first[t] = now.min(1), at_leaf[t, now.argmin(1)]
        at = int(first[nearest == nearest.min()].min())
        edges.append((link[tuple(place[at])], at, best[tuple(place[at])]))
    u, v, w = (np.array(x) for x in zip(*edges, strict=True))
    order = np.argsort(w, kind="stable")
    return u[order], v[order], np.sqrt(w[order])


def condensed(u: np.ndarray, v: np.ndarray, d: np.ndarray, least: int) -> tuple[list[Cluster], np.ndarray, np.ndarray]:
    """(clusters, cluster that each point falls out of, density at which it does); cluster 0 holds all.

    Edges join parts from the nearest on; read backwards a part splits at each edge. A split
    into two parts of least points or more begins two clusters, else the small part falls out.
    """
    n = len(u) + 1
    top, size, parts = np.arange(2 * n - 1), np.ones(2 * n - 1, np.int64), {}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = root(a), root(b)
        parts[n + k] = (a, b)
        top[a] = top[b] = n + k
        size[n + k] = size[a] + size[b]
    clusters, fell, when = [Cluster(-1, 0.0)], np.zeros(n, np.int64), np.zeros(n)

    def drop(node: int, cluster: int, density: float) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                fell[x], when[x] = cluster, density
            else:
                stack += parts[x]
        clusters[cluster].stability += (density - clusters[cluster].birth) * int(size[node])

    stack = [(2 * n - 2, 0)] if n > 1 else []
    while stack:
        node, cluster = stack.pop()
        density = 1 / max(float(d[node - n]), 1e-300)
        large = [x for x in parts[node] if size[x] >= least and x >= n]
        if len(large) == 2:
            for x in large:
                clusters[cluster].stability += (density - clusters[cluster].birth) * int(size[x])
                clusters[cluster].children.append(len(clusters))
                stack.append((x, len(clusters)))
                clusters.append(Cluster(cluster, density))
        else:
            for x in parts[node]:
                if x in large:
                    stack.append((x, cluster))
                else:
                    drop(x, cluster, density)
    return clusters, fell, when


def chosen_clusters(clusters: list[Cluster], single: bool, epsilon: float) -> set[int]:
    """The clusters that are more stable than all that they split into; those that begin under epsilon are merged upwards.

    Cluster 0, which holds all points, counts only with single.
    """
    best, chosen = {}, set()
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(best[c] for c in clusters[i].children)
        if (i or single) and (not clusters[i].children or clusters[i].stability >= below):
            best[i] = clusters[i].stability
            chosen.add(i)
            stack = list(clusters[i].children)
            while stack:
                c = stack.pop()
                chosen.discard(c)
                stack += clusters[c].children
        else:
            best[i] = below
    if epsilon > 0:
        raised = set()
        for i in sorted(chosen):
            while clusters[i].birth > 1 / epsilon and clusters[i].parent >= (0 if single else 1):
                i = clusters[i].parent
            raised.add(i)

        def above(i: int) -> bool:
            while (i := clusters[i].parent) >= 0:
                if i in raised:
                    return True
            return False

        chosen = {i for i in raised if not above(i)}
    return chosen


def labels(p: np.ndarray, min_cluster_size: int, min_samples: int, single: bool = True, epsilon: float = 0.0) -> np.ndarray:
    """Cluster numbers by their first point; -1 is noise, also all of a cloud under min_cluster_size points."""
    if len(p) < max(2, min_cluster_size):
        return np.full(len(p), -1)
    clusters, fell, when = condensed(*spanning_tree(p, min_samples), min_cluster_size)
    chosen = chosen_clusters(clusters, single, epsilon)
    owner = {}
    for i in range(len(clusters)):
        owner[i] = i if i in chosen else owner.get(clusters[i].parent, -1)
    found = np.array([owner[c] for c in fell.tolist()])
    if 0 in chosen:  # of all points those that stay to a density count
        births = [clusters[c].birth for c in clusters[0].children]
        least = 1 / epsilon if epsilon > 0 else max([*when[fell == 0].tolist(), *births])
        found[(found == 0) & (fell == 0) & (when < least)] = -1
    names = [c for c in dict.fromkeys(found.tolist()) if c >= 0]
    number = {c: i for i, c in enumerate(names)} | {-1: -1}
    return np.array([number[c] for c in found.tolist()])


def clustered(points: DataFrame, by: str, min_cluster_size: int, min_samples: int, single: bool = True, epsilon: float = 0.0) -> DataFrame:
    """points (by, pid, x, y, z and more) with cluster; points are taken in order of pid.

    A cloud is a task's, as points join its tree one after the other. Each looks at the bounds of all leaves and at few
    points, so that time still grows by the square of the points, at a sixty-fourth of them, and memory by a multiple of them.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pid")
        p = np.stack([group[c].to_numpy() for c in XYZ], 1)
        return group.append_column("cluster", pa.array(labels(p, min_cluster_size, min_samples, single, epsilon), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(by).applyInArrow(run, f"{schema}, cluster long")
