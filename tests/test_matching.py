"""Matches of whole images by numpy and curves in blocks, against the same as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.functions import polygons as G
from furrow.operators import evaluation as E
from furrow.operators import matching as M
from furrow.operators import overlap as O
from furrow.plans import catalogue, evaluation_queries

TEN = evaluation_queries.THRESHOLDS


@pytest.fixture
def small_batches(spark):
    """Images and blocks over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def found(spark):
    """Detections on a coarse grid, so that many are equal: small and large images, boxes without a side, two without a class."""
    draws, rows = np.random.default_rng(11), []
    for image in range(30):
        for k in range(int(draws.choice([1, 3, 25, 90]))):
            x, y, w, h = (float(v) for v in draws.integers(0, [40, 40, 30, 24]))
            rows.append((image, k, x, y, x + w, y + h, float(draws.integers(0, 9)) / 9, int(draws.integers(0, 3)), str(draws.choice(["R", "N"]))))
    rows += [(100, k, 0.0, 0.0, 20.0, 20.0, 0.5, None, "R") for k in range(2)]
    df = spark.createDataFrame(rows, "image long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls long, flag string")
    order = E.Window.partitionBy("image").orderBy(F.desc("conf"), "box_id")
    return df.withColumn("det", F.row_number().over(order).cast("long"))


def bits(matched):
    out = {}
    for x in matched.collect():
        out[x["image"] * 100000 + x["det"]] = out.get(x["image"] * 100000 + x["det"], 0) | 1 << TEN.index(x["threshold"])
    return out


def test_hits_are_those_of_the_matches(spark, sf_dir, found, small_batches, monkeypatch):
    monkeypatch.setattr(evaluation_queries, "detections", lambda *a: found)
    want = [bits(f(found)) for f in (evaluation_queries.matches, evaluation_queries.mask_matches)]
    got = evaluation_queries.scored(spark, sf_dir, 0.0, 8.0).collect()
    assert len(got) == found.count() and sum(x["truth"] for x in got) == found.filter("flag = 'R'").count()
    assert len(want[0]) > 100 and len(want[1]) > 100
    for k, matched in enumerate(want):
        assert {x["tie"]: x["hits"] >> 10 * k & 1023 for x in got if x["hits"] >> 10 * k & 1023} == matched


def test_an_image_of_many_boxes_is_matched_in_little_memory():
    draws = np.random.default_rng(2)
    n = 60_000
    x, y = draws.integers(0, 500, n).astype(float), draws.integers(0, 400, n).astype(float)
    box, true = np.stack([x, y, x + 25, y + 17]), draws.random(n) < 0.2
    key, det = np.zeros(n, np.int64), np.arange(n)
    hits = M.hit_bits(key, det, box, det, true, box, [0.5, 0.95])
    places = {}
    for i in np.flatnonzero(true):
        places.setdefault((x[i], y[i]), i)  # of equal truths all take the least
    first = {}
    for i in range(n):
        if (x[i], y[i]) in places:
            first.setdefault((x[i], y[i]), i)
    assert set(np.flatnonzero(hits & 2).tolist()) == set(first.values())


@pytest.fixture
def curves(spark, small_batches):
    """(curve, blocks with their starts) of two classes at three thresholds, with many equal confidences and a class without truth."""
    draws = np.random.default_rng(4)
    rows = [(int(c), float(p) / 20, i, int(h)) for i, (c, p, h) in enumerate(zip(draws.integers(0, 3, 700), draws.integers(0, 20, 700), draws.integers(0, 8, 700)))]
    scored = spark.createDataFrame(rows, "cls long, conf double, tie long, hits int").repartition(5)
    totals = spark.createDataFrame([(0, 200), (1, 150)], "cls long, n_true long")
    found = E.blocks(scored, ["cls"], 3)
    assert found.agg(F.max("rows")).first()[0] <= 7
    return E.curve(scored, totals, ["cls"], 3), E.started(found, totals, ["cls"], 3)


def test_an_envelope_by_blocks(curves):
    names = ["cls", "k", "rank", "tps", "n_true", "precision", "recall", "envelope"]
    want, got = (sorted(map(tuple, f(c, ["cls"], 3).select(*names).collect())) for f, c in zip((E.envelope, E.block_envelope), curves))
    assert got == want and len(got) > 1000


def test_average_precision_by_blocks(curves):
    want, got = ({(x["cls"], x["k"]): x["ap"] for x in df.collect()} for df in (E.average_precision(curves[0], ["cls"]), E.block_average_precision(curves[1], ["cls"], 3)))
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 6


def test_a_curve_is_sorted_once_and_narrow(spark, sf_dir):
    """What a task sorts after the ranges are blocks, not a wide row for each rank."""
    plan = catalogue.QUERIES["pr_curve"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInArrow" in plan
    assert "REPARTITION_BY_NUM" in plan  # not left to as many tasks as the few bytes of blocks would get


def test_pairs_of_boxes_and_masks_are_not_dealt_over_tasks(spark, sf_dir, monkeypatch):
    joins, join = [], O.overlap_join
    monkeypatch.setattr(O, "overlap_join", lambda *a, **k: joins.append(1) or join(*a, **k))
    catalogue.QUERIES["box_and_mask_ap"](spark, sf_dir).collect()
    assert not joins


@pytest.mark.parametrize("reach", [16.0, 1.0])
def test_quads_are_matched_as_in_a_join(spark, reach, monkeypatch):
    """Crowds, lone shapes far away, equal ones, groups without others or queries, rows that take no part, and pairs a few at a time."""
    draws, rows = np.random.default_rng(8), []
    for g, (queries, others, spread) in enumerate([(40, 60, 60), (30, 8, 4000), (5, 0, 50), (0, 5, 50), (25, 25, 300)]):
        for i in range(queries + others):
            x, y, w, h = (float(v) for v in draws.integers(0, [spread, spread, 30, 20]))
            rows.append((g, i, i < queries, [x, y, x + w + 1, y + h + 1], *[(1.0, 0.0), (0.8, 0.6), (0.28, 0.96)][i % 3]))
        rows += [(g, 500 + i, False, *rows[-1][3:]) for i in range(2 if others else 0)]
    key, ids, query = (np.array([r[i] for r in rows]) for i in range(3))
    shapes = G.quads(np.array([r[3] for r in rows]).T, *(np.array([r[i] for r in rows]) for i in (4, 5)))
    corners = [(int(k), int(i), bool(q), list(zip(x.tolist(), y.tolist()))) for k, i, q, x, y in zip(key, ids, query, *shapes[:2])]
    df = spark.createDataFrame(corners, "g long, id long, query boolean, shape array<struct<x:double,y:double>>")
    df = df.select("*", *[c.alias(n) for n, c in zip(O.CORNERS, G.bounds(F.col("shape")))])
    want = O.best_or_nearest(df.filter("query"), df.filter("not query"), ["g"], G.overlap, G.distance, reach)
    want = sorted((x["g"], x["a_id"], x["b_id"], x["overlap"], x["distance"]) for x in want.collect())
    shapes[0][5, 2] = np.nan  # a query
    key[6] = -1
    want = [x for x in want if x[:2] not in ((0, 5), (0, 6))]
    monkeypatch.setattr(M, "PAIRS", 50)
    monkeypatch.setattr(M, "POLYGONS", 7)
    a, b, overlap, distance = M.best_or_nearest(key, ids, query, shapes, reach)
    got = sorted(zip(key[a].tolist(), ids[a].tolist(), ids[b].tolist(), overlap.tolist(), distance.tolist()))
    assert got == want and {x[0] for x in got} == {0, 1, 4}


def test_quads_go_through_one_shuffle(spark, sf_dir):
    plan = catalogue.QUERIES["quad_best_match"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and plan.count("Sort [") == 1


def test_an_image_is_whole_in_a_table():
    batches = [pa.RecordBatch.from_pydict({"image": pa.array(v, pa.int64())}) for v in ([1, 1], [], [1, 2], [2, 2], [2], [3, 4, 4], [None], [None], [0])]
    assert [t["image"].to_pylist() for t in M.whole(iter(batches), "image")] == [[1, 1, 1], [2, 2, 2, 2, 3], [4, 4], [None, None], [0]]
