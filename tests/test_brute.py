"""Queries that SQL cannot express, against brute force on the smallest tables."""

from __future__ import annotations

import itertools
import math
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from furrow.operators import scenes as S
from furrow.operators import shapes as H
from furrow.plans import catalogue
from furrow.plans.fixtures import boxes, points


@pytest.fixture(scope="module")
def clouds(spark, sf_dir):
    out = defaultdict(list)
    for p in sorted(points(spark, sf_dir).collect(), key=lambda p: p["pid"]):
        out[p["file_id"]].append((p["pid"], p["x"], p["y"], p["z"]))
    return {k: (np.array([r[0] for r in v]), np.array([r[1:] for r in v])) for k, v in out.items()}


def hull(p):
    """Volume from every triangle that has all points on one side."""
    total, inside = 0.0, p.mean(0)
    for a, b, c in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        side = (p - p[a]) @ n
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            total += abs(np.linalg.det(np.stack((p[a] - inside, p[b] - inside, p[c] - inside)))) / 6
    return total


def traits(p):
    centre = p.mean(0)
    _, _, axes = np.linalg.svd(p - centre)
    flat = np.abs((p - centre) @ axes.T)
    axis = axes[0] * (1 if axes[0][np.abs(axes[0]).argmax()] > 0 else -1)
    along, across = (p - centre) @ axis, (p - centre) @ axes[1]
    fit = np.polyfit(along, across, 3)
    low, high = np.percentile(along, [0.5, 99.5])
    at = np.linspace(low, high, 1000)
    y = np.polyval(fit, at)
    length = np.hypot(np.diff(at), np.diff(y)).sum()
    return {
        "x": centre[0], "y": centre[1], "z": centre[2], "n": len(p), "length": length, "width": 2 * np.percentile(flat[:, 2], 95), "volume": hull(p),
        "inclination": math.degrees(math.acos(axis[2])), "curvature": length / math.hypot(at[-1] - at[0], y[-1] - y[0]),
    }


def test_shape_traits(spark, sf_dir, clouds):
    got = {r["file_id"]: r for r in catalogue.QUERIES["shape_traits"](spark, sf_dir).collect()}
    assert got.keys() == clouds.keys()
    for k, (_, p) in clouds.items():
        want = traits(p)
        assert [got[k][n] for n in want] == pytest.approx(list(want.values()), rel=1e-6)


def test_oriented_boxes(spark, sf_dir, clouds):
    for r in H.oriented_boxes(points(spark, sf_dir), "file_id").collect():
        _, p = clouds[r["file_id"]]
        axes = np.array(r["axes"]).reshape(3, 3)
        assert np.allclose(axes @ axes.T, np.eye(3))
        spread = ((p - p.mean(0)) @ axes.T).var(0)
        assert (np.diff(spread) <= 1e-9).all() and np.allclose(np.cov(((p - p.mean(0)) @ axes.T).T) - np.diag(spread * len(p) / (len(p) - 1)), 0, atol=1e-9)
        local = (p - np.array(r["center"])) @ axes.T
        assert np.allclose(local.max(0), np.array(r["extent"]) / 2) and np.allclose(local.min(0), -np.array(r["extent"]) / 2)


def test_morphology_run(spark, sf_dir, clouds):
    settings = S.Morphology(outlier_k=8)
    got = {r["file_id"]: r for r in catalogue.QUERIES["morphology_run"](spark, sf_dir).collect()}
    for k, (ids, p) in clouds.items():
        d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
        near = np.sort(d, 1)[:, 1:9].mean(1)
        mid = np.median(near)
        keep = near < mid + settings.outlier_ratio * 1.4826 * np.median(np.abs(near - mid)) if len(p) > 8 else np.ones(len(p), bool)
        ids, p, d = ids[keep], p[keep], d[keep][:, keep]
        reach = d <= settings.epsilon
        core = reach.sum(1) >= settings.min_samples
        label, number = np.full(len(p), -1), 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                stack, label[i] = [i], number
                while stack:
                    for j in np.flatnonzero(reach[stack.pop()] & core & (label < 0)):
                        label[j] = number
                        stack.append(j)
                number += 1
        for i in np.flatnonzero(~core):
            label[i] = label[reach[i] & core].min(initial=number) if (reach[i] & core).any() else -1
        names, counts = np.unique(label, return_counts=True)
        main = p[label == names[counts.argmax()]]
        want = traits(main)
        want["width"] = 2 * np.percentile(np.abs((main - main.mean(0)) @ np.linalg.svd(main - main.mean(0))[2].T)[:, 2], settings.distance_percentile)
        assert [got[k][n] for n in want] == pytest.approx(list(want.values()), rel=1e-6, nan_ok=True)


def test_hierarchical_clusters(spark, sf_dir, clouds):
    got = {(r["file_id"], r["pid"]): r["cluster"] for r in catalogue.QUERIES["hierarchical_clusters"](spark, sf_dir).collect()}
    assert got.keys() == {(k, i) for k, (ids, _) in clouds.items() for i in ids}
    for k, (ids, p) in clouds.items():
        label = np.array([got[k, i] for i in ids])
        names = set(label.tolist()) - {-1}
        assert names == set(range(len(names))) and len(names) != 1
        assert all((label == c).sum() >= 5 for c in names)


def test_composed_labels(spark, sf_dir):
    """Objects laid down one after the other on a canvas, pixel by pixel."""
    want = {}
    for b in sorted(boxes(spark, sf_dir).collect(), key=lambda b: (b["image"], b["box_id"])):
        image, obj = b["image"], b["box_id"]
        own = {x + 100 * y: float(obj * 37 % 11 + (x + 100 * y) % 3) for x in range(int(b["x1"] // 8), int(b["x2"] // 8)) for y in range(int(b["y1"] // 8), int(b["y2"] // 8))}
        under = [px for px in own if (image, px) in want]
        behind = under and np.mean([want[image, px][1] for px in under]) < np.mean([own[px] for px in under])
        for px, depth in own.items():
            if not (behind and (image, px) in want):
                want[image, px] = (obj, depth)
    got = {(r["image"], r["px"]): r["obj"] for r in catalogue.QUERIES["composed_labels"](spark, sf_dir).collect()}
    assert got == {k: v[0] for k, v in want.items()}


def test_fitted_anchors(spark, sf_dir):
    sizes = np.array([[b["x2"] - b["x1"], b["y2"] - b["y1"]] for b in boxes(spark, sf_dir).collect()])
    scale = sizes.std(0)
    order = np.sort(sizes, 0)
    at = [math.ceil((i + 0.5) / 6 * len(sizes)) - 1 for i in range(6)]
    centres = order[at] / scale
    for _ in range(15):
        nearest = ((sizes[:, None] / scale - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([sizes[nearest == i].mean(0) / scale if (nearest == i).any() else centres[i] for i in range(6)])
    want = sorted((centres * scale).tolist(), key=lambda r: r[0] * r[1])
    got = [[r["w"], r["h"]] for r in catalogue.QUERIES["fitted_anchors"](spark, sf_dir).orderBy("anchor").collect()]
    assert np.allclose(got, want)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_deterministic_sample(spark, sf_dir):
    def hashed(pid, salt):
        first = xxhash.xxh64(struct.pack("<q", pid), seed=42).intdigest()
        return signed(xxhash.xxh64(struct.pack("<i", salt), seed=first).intdigest())

    files = defaultdict(list)
    for p in points(spark, sf_dir).collect():
        files[p["file_id"]].append((hashed(p["pid"], 7), p["pid"], p["x"]))
    want = []
    for k, own in files.items():
        for n, (_, pid, x) in enumerate(sorted(own)[:5], 1):
            u = hashed(pid, 11) % 1000
            want.append((k, pid, n, "train" if u < 900 else "val", n % 4, -math.log((u + 1) / 1001) / (1 + abs(x))))
    got = sorted(map(tuple, catalogue.QUERIES["deterministic_sample"](spark, sf_dir).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in sorted(want)])
