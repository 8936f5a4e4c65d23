"""Suppression by rounds against the greedy walk."""

from __future__ import annotations

import numpy as np
import pytest

from furrow.operators import overlap as O
from furrow.plans import catalogue, fixtures

NAMES = "image long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls long"


def greedy(rows, by, threshold, most, max_nms):
    kept = set()
    for key in {tuple(r[i] for i in by) for r in rows}:
        own = sorted((r for r in rows if tuple(r[i] for i in by) == key), key=lambda r: (-r[6], r[1]))[:max_nms]
        box = np.array([r[2:6] for r in own])
        size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        left, n = np.arange(len(own)), 0
        while len(left) and (most is None or n < most):
            i, left, n = left[0], left[1:], n + 1
            kept.add((own[i][0], own[i][1]))
            both = np.maximum(np.minimum(box[i, 2], box[left, 2]) - np.maximum(box[i, 0], box[left, 0]), 0) * np.maximum(np.minimum(box[i, 3], box[left, 3]) - np.maximum(box[i, 1], box[left, 1]), 0)
            left = left[both <= threshold * (size[i] + size[left] - both)]
    return kept


def crowd(n, images, seed=1, step=0.0):
    draws = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, w, h = draws.uniform(0, 900), draws.uniform(0, 900), draws.uniform(10, 80), draws.uniform(10, 80)
        rows.append((int(draws.integers(images)), i, float(x), float(y), float(x + w), float(y + h), float(np.round(draws.random(), 2)), int(draws.integers(3))))
    if step:  # a row of boxes of which each overlaps the next alone, by falling score: as many rounds as boxes
        rows += [(99, n + i, i * step, 0.0, i * step + 10, 10.0, 1 - i / 100, 0) for i in range(25)]
    return rows


@pytest.mark.parametrize(("most", "max_nms"), [(300, 30_000), (None, None), (40, 500)])
def test_one_crowded_image(spark, most, max_nms):
    rows = crowd(4000, 1, step=3.0)
    got = {(r["image"], r["box_id"]) for r in O.nms(spark.createDataFrame(rows, NAMES), ["image"], most=most, max_nms=max_nms).collect()}
    assert got == greedy(rows, (0,), 0.45, most, max_nms)


def test_by_class(spark):
    rows = crowd(3000, 7)
    got = {(r["image"], r["box_id"]) for r in O.nms(spark.createDataFrame(rows, NAMES), ["image", "cls"]).collect()}
    assert got == greedy(rows, (0, 7), 0.45, 300, 30_000)


def test_equal_rows_and_none(spark):
    """Of rows equal in everything one is kept; an empty table stays empty."""
    rows = [(1, 5, 0.0, 0.0, 10.0, 10.0, 0.5, 0)] * 3
    assert O.nms(spark.createDataFrame(rows, NAMES), ["image"]).count() == 1
    empty = O.nms(spark.createDataFrame([], NAMES), ["image"])
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in NAMES.split(", ")]


def reads_of(name, spark, sf_dir, monkeypatch):
    reads, table = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda *a: reads.append(a[2]) or table(*a))
    catalogue.QUERIES[name](spark, sf_dir)
    return reads


def test_two_models_are_read_once(spark, sf_dir, monkeypatch):
    assert reads_of("ensemble_nms", spark, sf_dir, monkeypatch) == ["lineitem"]


def test_pairs_of_high_iou_take_fewer_cells(spark):
    """No pair over the IoU is lost, also of boxes whose common part begins right where cells do, and fewer rows are dealt."""
    rows = crowd(3000, 2) + [(5, 9000 + i, float(x), float(y), float(x + w), float(y + 64), 0.5, 0) for i, (x, y, w) in enumerate([(0, 0, 64), (28.8, 0, 64), (63.9, 64, 64), (64, 64, 64), (35.2, 0, 64), (64, 64, 0)])]
    df = spark.createDataFrame(rows, NAMES)
    a, b = O.B.box("a_"), O.B.box("b_")
    found = [{(r[0], r[1], r[2]) for r in O.overlap_join(df, df, ["image"], **more).filter(O.B.iou_guarded(a, b) > 0.45).select("image", "a_box_id", "b_box_id").collect()} for more in ({}, {"least_iou": 0.45})]
    assert found[0] == found[1] and len(found[0]) > 3000


@pytest.mark.parametrize(("most", "max_nms"), [(300, 30_000), (None, None), (40, 500)])
def test_merged_with_pairs_of_suppression(spark, monkeypatch, most, max_nms):
    """The means of kept boxes are those over all boxes that they overlap; boxes without area are no part of any."""
    rows = [(*row[:6], row[6] + 0.01, row[7]) for row in crowd(2000, 1, step=3.0)] + [(7, 8000, 5.0, 5.0, 5.0, 9.0, 0.5, 0), (7, 8001, 0.0, 0.0, 9.0, 9.0, 0.4, 0)]
    df = spark.createDataFrame(rows, NAMES)
    want = {r["box_id"]: r for r in O.merged_boxes(O.nms(df, ["image"], most=most, max_nms=max_nms), df, ["image"]).collect()}
    joins, join = [], O.overlap_join
    monkeypatch.setattr(O, "overlap_join", lambda *a, **k: joins.append(1) or join(*a, **k))
    got = {r["box_id"]: r for r in O.merged_nms(df, ["image"], most=most, max_nms=max_nms).collect()}
    assert got.keys() == want.keys() and 8000 not in got
    for i, r in want.items():
        assert [got[i][c] for c in ("image", "n_merged", *O.CORNERS)] == [r["image"], r["n_merged"], *[pytest.approx(r[c]) for c in O.CORNERS]]
    assert len(joins) == (2 if max_nms == 500 else 1)


def test_merge_query_joins_once(spark, sf_dir, monkeypatch):
    joins, join = [], O.overlap_join
    monkeypatch.setattr(O, "overlap_join", lambda *a, **k: joins.append(1) or join(*a, **k))
    catalogue.QUERIES["merge_nms"](spark, sf_dir)
    assert joins == [1]


def test_confusion_reads_once(spark, sf_dir, monkeypatch):
    assert reads_of("confusion_matrix", spark, sf_dir, monkeypatch) == ["lineitem"]
