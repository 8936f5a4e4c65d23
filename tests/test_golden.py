"""Hand-computed cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import arrays as A
from furrow.functions import boxes as B
from furrow.functions import text as X
from furrow.operators import overlap as O
from furrow.operators import points as P
from furrow.operators import shapes as H
from furrow.operators import splines as L


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_iou_and_touching_edges(spark):
    assert value(spark, B.iou_guarded(lits(0, 0, 10, 10), lits(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert value(spark, B.overlaps(lits(0, 0, 10, 10), lits(10, 0, 20, 10))) is True
    assert value(spark, B.iou_guarded(lits(0, 0, 10, 10), lits(10, 0, 20, 10))) == 0
    assert value(spark, B.iou_guarded(lits(0, 0, 0, 0), lits(0, 0, 0, 0))) == 0
    assert value(spark, B.overlaps(lits(0, 0, 10, 10), (F.lit(None).cast("double"),) * 4)) is False


def test_conversions(spark):
    b = lits(100, 50, 200, 150)
    assert [value(spark, c) for c in B.xyxy_to_xywh(b)] == [150, 100, 100, 100]
    assert [value(spark, c) for c in B.xyxy_to_ltwh(b)] == [100, 50, 100, 100]


def test_letterbox(spark):
    got = B.letterbox(F.lit(500.0), F.lit(1000.0), 1280)
    assert [value(spark, got[k]) for k in ("ratio", "new_w", "new_h", "top", "bottom", "left", "right")] == [1.28, 1280, 640, 320, 320, 0, 0]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double")


def test_suppression_chain(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 8.0, 0.8), (1, 2, 20.0, 20.0, 30.0, 30.0, 0.7)]
    assert {r["box_id"] for r in O.nms(boxes(spark, rows), ["image"]).collect()} == {0, 2}
    chain = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 4.0, 0.0, 14.0, 10.0, 0.8), (1, 2, 8.0, 0.0, 18.0, 10.0, 0.7)]
    assert {r["box_id"] for r in O.nms(boxes(spark, chain), ["image"], 0.4).collect()} == {0, 2}


def test_overlap_join_equals_all_pairs(spark):
    draws = np.random.default_rng(3)
    rows = [(int(i % 3), i, *(p := draws.uniform(0, 300, 2)).tolist(), *(p + draws.uniform(0, 120, 2)).tolist(), 0.5) for i in range(90)]
    df = boxes(spark, rows)
    got = {(r["a_box_id"], r["b_box_id"]) for r in O.overlap_join(df, df, ["image"]).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert got == want


def test_names(spark):
    n = F.lit("FPWW036_SR0461_1_FIP2_cam_01_007")
    assert value(spark, X.image_of_mask(n)) == "FPWW036_SR0461_1_FIP2_cam_01"
    assert value(spark, X.index_of_mask(n)) == 7
    assert [value(spark, X.split_label(X.camera_id(F.lit(s)))) for s in ("a_cam_10.png", "a_cam_11.png", "foo.png")] == ["train", "test", "train"]
    assert value(spark, X.class_91(F.lit(79))) == 90


def test_moving_average(spark):
    assert value(spark, A.ema(F.array(F.lit(1.0), F.lit(2.0)))) == pytest.approx(1.04)


def test_hull():
    cube = np.array([[x, y, z] for x in (0, 2) for y in (0, 1) for z in (0, 3)], float)
    assert H.volume(cube) == pytest.approx(6)
    assert H.volume(np.concatenate((cube, cube[:3] * 0.5 + 0.2))) == pytest.approx(6)
    assert H.volume(cube[:, [0, 1, 1]] * [1, 1, 0]) == 0


def test_density_clusters(spark):
    p = [[0, 0, 0], [0.1, 0, 0], [0.2, 0, 0], [5, 5, 5], [9, 0, 0], [9.1, 0, 0], [9.2, 0, 0]]
    df = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "g long, pid long, x double, y double, z double")
    assert [r["cluster"] for r in P.clustered(df, "g", 0.15, 2).orderBy("pid").collect()] == [0, 0, 0, -1, 1, 1, 1]


def test_straight_line_has_no_curvature(spark):
    line = spark.createDataFrame([(1, i / 49, 2 * i / 49) for i in range(50)], "g long, x double, y double")
    (row,) = L.axis_lengths(line, "g").collect()
    assert row["length"] == pytest.approx(0.99 * 5**0.5, rel=1e-2)
    assert row["curvature"] == pytest.approx(1)


def test_label_maps_keep_the_nearer(spark):
    from furrow.operators import scenes

    rows = [(1, 1, p, 5.0) for p in (1, 2, 3)] + [(1, 2, p, 9.0) for p in (3, 4)] + [(1, 3, p, 1.0) for p in (1, 5)]
    got = scenes.composed_labels(spark.createDataFrame(rows, "image long, obj long, px long, depth double"))
    assert {r["px"]: r["obj"] for r in got.collect()} == {1: 3, 2: 1, 3: 1, 4: 2, 5: 3}


def test_morphology_settings():
    from furrow.operators import scenes

    with pytest.raises(ValueError):
        scenes.Morphology(distance_percentile=0)


def test_anchors_find_the_sizes(spark):
    from furrow.operators import scenes

    rows = [(10.0 + i % 2, 20.0) for i in range(50)] + [(40.0, 30.0 + i % 2) for i in range(50)]
    got = scenes.fitted_anchors(spark.createDataFrame(rows, "w double, h double"), 2).collect()
    assert [(r["w"], r["h"]) for r in got] == [(10.5, 20.0), (40.0, 30.5)]
