"""Queries do the whole job: every image, scene, threshold and row, against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry as G
from furrow.plans import catalogue
from furrow.plans.fixtures import boxes, points, truth


def rows(spark, sf_dir, name, *columns):
    """Sorted, repeated rows kept."""
    return sorted(tuple(x) for x in catalogue.QUERIES[name](spark, sf_dir).select(*columns).collect())


@pytest.fixture(scope="module")
def masks(spark, sf_dir):
    """The cells of each mask of every image, by hand."""
    out = {}
    for b in boxes(spark, sf_dir).collect():
        cells = {(x, y) for x in range(int(b["x1"] // 8), int(b["x2"] // 8)) for y in range(int(b["y1"] // 8), int(b["y2"] // 8))}
        if cells:
            out[b["image"], b["box_id"]] = cells
    assert len({image for image, _ in out}) == 70
    return out


def on_top(masks, order):
    """(image, px, mask) with the mask of least order(mask, size, px) in each cell."""
    best = {}
    for (image, mask), cells in masks.items():
        for x, y in cells:
            px = x + 100 * y
            key = order(mask, len(cells), px)
            best[image, px] = min(best.get((image, px), (key, mask)), (key, mask))
    return sorted((image, px, mask) for (image, px), (_, mask) in best.items())


def test_mask_iou_of_all_images(spark, sf_dir, masks):
    held, shared = defaultdict(list), Counter()
    for (image, mask), cells in sorted(masks.items()):
        for c in cells:
            shared.update((image, other, mask) for other in held[image, c])
            held[image, c].append(mask)
    got = rows(spark, sf_dir, "mask_iou", "image", "a", "b", "i", "iou", "precision", "recall")
    assert [x[:4] for x in got] == sorted((*k, n) for k, n in shared.items())
    for image, a, b, i, *scores in got:
        n, m = len(masks[image, a]), len(masks[image, b])
        assert scores == pytest.approx([i / (n + m - i + 1e-7), i / n, i / m], abs=1e-6)


def test_mask_bounds_of_all_images(spark, sf_dir, masks):
    want = []
    for k, cells in masks.items():
        x, y = zip(*cells, strict=True)
        want.append((*k, min(x), min(y), max(x), max(y), sum(10 <= a < 30 and 5 <= b < 25 for a, b in cells)))
    assert rows(spark, sf_dir, "mask_bounds", "image", "mask", "x1", "y1", "x2", "y2", "cropped") == sorted(want)


def test_mask_overlap_order_of_all_images(spark, sf_dir, masks):
    assert rows(spark, sf_dir, "mask_overlap_order", "image", "px", "mask") == on_top(masks, lambda mask, n, px: (n, -mask))


def test_mask_dilation_of_all_images(spark, sf_dir, masks):
    want = {(*k, x + dx + 100 * (y + dy)) for k, cells in masks.items() for x, y in cells for dx in (-1, 0, 1) for dy in (-1, 0, 1) if 0 <= x + dx <= 99}
    assert rows(spark, sf_dir, "mask_dilation", "image", "mask", "px") == sorted(want)


def test_composed_labels_of_all_images(spark, sf_dir, masks):
    got = rows(spark, sf_dir, "composed_labels", "image", "px", "obj")
    cells = {(image, x + 100 * y) for (image, _), own in masks.items() for x, y in own}
    assert [x[:2] for x in got] == sorted(cells)
    assert all((px % 100, px // 100) in masks[image, obj] for image, px, obj in got)


def test_polygon_resample_of_all_boxes(spark, sf_dir):
    want = {}
    for b in boxes(spark, sf_dir).collect():
        xs, ys = (b["x1"], b["x2"], b["x2"], b["x1"]), (b["y1"], b["y1"], b["y2"], b["y1"])
        for i in range(7):  # two steps a side
            k, half = divmod(i, 2)
            ends = (k, k + 1) if half else (k, k)
            want[b["image"], b["box_id"], i] = (sum(xs[e] for e in ends) / 2, sum(ys[e] for e in ends) / 2)
    got = rows(spark, sf_dir, "polygon_resample", "image", "box_id", "i", "x", "y")
    assert [x[:3] for x in got] == sorted(want)
    assert all(x[3:] == pytest.approx(want[x[:3]], abs=1e-6) for x in got)


def test_nearest_views_of_all_scenes(spark, sf_dir):
    scenes = defaultdict(list)
    for p in sorted(points(spark, sf_dir).collect(), key=lambda p: p["pid"]):
        scenes[p["file_id"]].append(p)
    assert len(scenes) == 10
    want = []
    for own in scenes.values():
        ids, at = np.array([p["pid"] for p in own]), np.array([[p["x"], p["y"], p["z"]] for p in own])
        for pid, d in zip(ids, np.sqrt(((at[:, None] - at) ** 2).sum(2)), strict=True):
            near = [k for k in np.lexsort((ids, d)) if d[k] >= 1e-6][:4]
            want += [(pid, ids[k], n) for n, k in enumerate(near, 1)]
    assert rows(spark, sf_dir, "nearest_views", "pid", "other", "n") == sorted(want)


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """By image all boxes and those left by suppression over all classes, by hand."""
    images = defaultdict(list)
    for b in boxes(spark, sf_dir).collect():
        images[b["image"]].append(b)
    out = {}
    for image, own in images.items():
        left = []
        for b in sorted(own, key=lambda b: (-b["conf"], b["box_id"])):
            if not any(over(b, k) for k in left):
                left.append(b)
        assert 20 < len(left) <= 300
        out[image] = own, left
    return out


def over(a, b):
    i = max(min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), 0) * max(min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]), 0)
    return i > 0.45 * ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - i)


def test_nms_agnostic_keeps_all_left(spark, sf_dir, kept):
    got = rows(spark, sf_dir, "nms_agnostic", "image", "box_id")
    assert got == sorted((image, b["box_id"]) for image, (_, left) in kept.items() for b in left)


def test_merge_nms_merges_all_left(spark, sf_dir, kept):
    want = {}
    for image, (own, left) in kept.items():
        for k in left:
            near = [b for b in own if over(k, b)]
            want[image, k["box_id"]] = [sum(b[c] * b["conf"] for b in near) / sum(b["conf"] for b in near) for c in ("x1", "y1", "x2", "y2")] + [len(near)]
    got = rows(spark, sf_dir, "merge_nms", "image", "box_id", "x1", "y1", "x2", "y2", "n_merged")
    assert [x[:2] for x in got] == sorted(want)
    assert all(list(x[2:]) == pytest.approx(want[x[:2]], abs=1e-6) for x in got)


TEN = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    """By hand: the matches (image, threshold, det, lab), and by class and threshold the rows (tps, precision, recall)."""
    images, labels = defaultdict(list), defaultdict(list)
    for b in boxes(spark, sf_dir).collect():
        images[b["image"]].append(b)
    for t in truth(spark, sf_dir).collect():
        labels[t["image"], t["cls"]].append(t)
    found, hits = [], defaultdict(list)
    for image, own in images.items():
        own.sort(key=lambda b: (-b["conf"], b["box_id"]))
        best = []  # of each detection (iou, label); it is the same at each threshold that it reaches
        for b in own:
            pairs = []
            for t in labels[image, b["cls"]]:
                i = max(min(t["x2"], b["x2"]) - max(t["x1"], b["x1"]), 0) * max(min(t["y2"], b["y2"]) - max(t["y1"], b["y1"]), 0)
                u = (t["x2"] - t["x1"]) * (t["y2"] - t["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - i + 1e-7
                pairs.append((-round(i / u, 9), t["gt_id"]))
            best.append(min(pairs, default=(0, None)))
        for th in TEN:
            taken = set()
            for det, (b, (iou, lab)) in enumerate(zip(own, best, strict=True), 1):
                hit = -iou >= th and lab not in taken
                if hit:
                    taken.add(lab)
                    found.append((image, th, det, lab))
                hits[b["cls"], th].append((-b["conf"], image * 100000 + det, hit))
    curves = {}
    for (cls, th), own in hits.items():
        tps = np.cumsum([hit for *_, hit in sorted(own)])
        n = sum(len(v) for (_, c), v in labels.items() if c == cls)
        curves[cls, th] = list(zip(tps.tolist(), (tps / np.arange(1, len(tps) + 1)).tolist(), (tps / n).tolist(), strict=True))
    return sorted(found), curves


def area(curve):
    """The reference's average precision of 101 points."""
    _, precision, recall = map(np.array, zip(*curve, strict=True))
    x, y = np.concatenate(([0.0], recall, [1.0])), np.concatenate(([1.0], precision, [0.0]))
    y, grid = np.flip(np.maximum.accumulate(np.flip(y))), np.linspace(0, 1, 101)
    return np.trapezoid(np.interp(grid, x, y), grid)


def test_matches_at_ten_thresholds(spark, sf_dir, scored):
    assert rows(spark, sf_dir, "match_greedy", "image", "threshold", "det", "lab") == scored[0]


def test_curves_at_ten_thresholds(spark, sf_dir, scored):
    got = rows(spark, sf_dir, "pr_curve", "cls", "threshold", "rank", "tps", "precision", "recall", "envelope")
    want = [(*k, n, *x, max(y[1] for y in c[n - 1 :])) for k, c in sorted(scored[1].items()) for n, x in enumerate(c, 1)]
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], atol=1e-6)


def test_best_f1_at_ten_thresholds(spark, sf_dir, scored):
    want = {k: max(2 * p * r / (p + r + 1e-16) for _, p, r in c) for k, c in scored[1].items()}
    got = rows(spark, sf_dir, "best_f1", "cls", "threshold", "f1")
    assert [x[:2] for x in got] == sorted(want) and all(f == pytest.approx(want[c, t], abs=1e-6) for c, t, f in got)


def test_map_over_ten_thresholds(spark, sf_dir, scored):
    ap = {k: area(c) for k, c in scored[1].items()}
    got = rows(spark, sf_dir, "average_precision", "cls", "threshold", "ap")
    assert [x[:2] for x in got] == sorted(ap) and len(ap) == 30
    assert [x[2] for x in got] == pytest.approx([ap[x[:2]] for x in got], abs=2e-5)  # where a recall is a place of the grid, the operator takes its first point, interp its last
    summary = {x["cls"]: x for x in catalogue.QUERIES["map_summary"](spark, sf_dir).collect()}
    assert len(summary) == 4
    for cls, x in summary.items():
        whole = np.mean([v for (c, _), v in ap.items() if cls in (c, None)])
        at50 = np.mean([v for (c, t), v in ap.items() if cls in (c, None) and t == 0.5])
        assert [x["map"], x["map50"], x["fitness"]] == pytest.approx([whole, at50, 0.1 * at50 + 0.9 * whole], abs=2e-6)


def test_view_interpolation_of_all_views(spark, sf_dir):
    want, near = {}, 0
    for p in points(spark, sf_dir).collect():
        q = np.array([p["e3"] + 0.5, p["e4"], p["e5"], p["e6"]])
        q /= np.linalg.norm(q)
        near += abs(q[0]) > 0.99
        q *= -1 if q[0] < 0 else 1
        axis, angle = np.linalg.norm(q[1:]), np.arctan2(np.linalg.norm(q[1:]), q[0])
        want[p["pid"]] = (np.cos(0.3 * angle), np.sin(0.3 * angle) * (q[1] / axis if axis else 0))
    assert near
    got = rows(spark, sf_dir, "view_interpolation", "pid", "w", "x")
    assert [x[0] for x in got] == sorted(want)
    assert all(x[1:] == pytest.approx(want[x[0]], abs=2e-6) for x in got)


def test_slerp_without_rotation(spark):
    one, zero = F.lit(1.0), F.lit(0.0)
    for w, x in ((1.0, 0.0), (-1.0, 0.0), (1.0, 1e-9)):
        got = spark.range(1).select(*G.slerp([one, zero, zero, zero], [F.lit(w), F.lit(x), zero, zero], F.lit(0.3))).first()
        assert tuple(got) == pytest.approx((1, 0.3 * x, 0, 0), abs=1e-12)
