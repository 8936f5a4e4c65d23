"""Rows on the edge of a limit, and steps whose cost has to stay near the input's size."""

from __future__ import annotations

import datetime
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import boxes as B
from furrow.operators import evaluation as E
from furrow.operators import overlap as O
from furrow.operators import scenes as S
from furrow.operators import shapes as H
from furrow.operators import splines as L
from furrow.plans import catalogue, evaluation_queries
from furrow.session import cut, written

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def against_sql(spark, folder, name, lines):
    """Sorted rows of a query over a written lineitem, and those of its SQL."""
    spark.createDataFrame(lines, LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(x) for x in df.select(*columns).collect())
    return got, sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())


def line(order, price, part=1, supplier=1, number=1, quantity=10.0, flag="N"):
    return (order, part, supplier, number, quantity, price, 0.0, 0.0, flag, "O", datetime.datetime(2000, 1, 1))


def test_a_confidence_on_a_threshold_does_not_pass_it(spark, tmp_path):
    got, said = against_sql(spark, tmp_path, "array_pack", [line(i, 50100.0 + 5000 * i + d) for i in range(10) for d in (-0.01, 0.0, 0.01)])
    assert got == said


def test_a_polygon_is_worked_out_once_to_be_resampled():
    assert str(B.resampled(F.col("corners"), 7)).count("corners") <= 2


def test_a_spline_is_solved_by_its_diagonals():
    bands = np.random.default_rng(3).uniform(-1, 1, (5, 60))
    bands[0] += 10
    for k in range(1, 5):
        bands[k, 60 - k :] = 0
    full = sum(np.diag(bands[k, : 60 - k], -k) + (np.diag(bands[k, : 60 - k], k) if k else 0) for k in range(5))
    assert np.allclose(L.solved(bands, np.arange(60.0)), np.linalg.solve(full, np.arange(60.0)))
    wide = np.zeros((5, 50_000))  # 20 GB as a full matrix
    wide[0], wide[1, :-1] = 2.0, -0.9
    assert np.allclose(L.product(wide, L.solved(wide, np.ones(50_000))), 1.0, atol=1e-4)


def test_knots_halve_many_intervals():
    assert len(L.more_knots(list(range(10, 200_000, 10)), 200_000, [1.0] * 20_000, 100_000)) == 100_000


def test_what_a_loop_carries_keeps_its_size(spark):
    rows = spark.range(10).toDF("k")
    for _ in range(6):
        rows = written(rows.join(rows.withColumnRenamed("k", "other").withColumn("k", F.col("other")), "k").select("k"))
    assert rows.count() == 10
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def planned(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_masks_grow_without_a_table_of_cells(spark, sf_dir):
    assert "Aggregate" not in planned(spark, sf_dir, "mask_dilation")


def test_a_filter_reads_its_frames_once(spark, sf_dir):
    assert "Join" not in planned(spark, sf_dir, "smooth_gaussian")


def tree(df):
    """A plan's operators, from the last to the first."""
    return [line.lstrip(" :+-*()0123456789") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]


def after_windows(df, operator):
    names = [line.split(" ")[0] for line in tree(df)]
    return operator in names and max(i for i, n in enumerate(names) if n == operator) < min(i for i, n in enumerate(names) if n == "Window")


def test_a_pair_is_sorted_once_for_all_thresholds(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.97), (1, 2, 2, 0.6), (1, 3, 2, 0.4)], "image long, det long, lab long, iou double")
    got = O.match_greedy(pairs, [0.5, 0.9, 0.95])
    assert after_windows(got, "Generate")
    assert sorted((x.threshold, x.det, x.lab) for x in got.collect()) == [(0.5, 1, 1), (0.9, 1, 1), (0.95, 2, 1)]
    best = O.match_greedy(pairs, [0.5, 0.9, 0.95], by_score=True)
    assert sorted((x.threshold, x.det, x.lab) for x in best.collect()) == [(0.5, 2, 1), (0.9, 2, 1), (0.95, 2, 1)]


@pytest.fixture
def curve(spark):
    scored = spark.createDataFrame([(i % 2, i / 50, i, i % 4) for i in range(50)], "cls long, conf double, tie long, hits int")
    totals = spark.createDataFrame([(0, 20), (1, 25)], "cls long, n_true long")
    return E.curve(scored, totals, ["cls"], 2)


def test_an_envelope_is_sorted_once_for_all_thresholds(curve):
    rows = E.envelope(curve, ["cls"], 2)
    assert after_windows(rows, "Generate")
    by = {}
    for x in sorted(rows.collect(), key=lambda x: -x["rank"]):
        top = by[x.cls, x.k] = max(by.get((x.cls, x.k), 0.0), x.precision)
        assert x.envelope == top
    assert len(by) == 4


def test_places_of_a_curve_are_summed_without_a_sort(curve, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "cut", lambda df: seen.append(df) or cut(df))
    E.average_precision(curve, ["cls"]).collect()
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_the_best_f1_needs_no_sort_of_its_own(curve):
    plan = E.best_f1(curve, ["cls"], 2)._jdf.queryExecution().executedPlan().toString()
    inside = plan.partition("Generate")[2].partition("Window")[0]
    assert "Aggregate" in inside and "Sort [" not in inside and "Exchange" not in inside


def test_masks_meet_by_their_bounds_not_by_cells(spark, sf_dir):
    found = evaluation_queries.detections(spark, sf_dir)
    plan = evaluation_queries.mask_matches(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "array_intersect" in plan


def test_runs_need_one_shuffle(spark, sf_dir):
    assert planned(spark, sf_dir, "run_lengths").count("Exchange") == 1


def test_the_mask_on_top_is_found_without_a_join_or_a_sort_of_cells(spark, sf_dir):
    plan = planned(spark, sf_dir, "mask_overlap_order")
    assert "Join" not in plan and "SortAggregate" not in plan and plan.count("Window [") == 1


def test_paired_masks_are_compared_without_a_table_of_cells(spark, sf_dir):
    assert "Aggregate" not in planned(spark, sf_dir, "paired_mask_iou")


def test_labels_of_many_objects_take_a_pass(spark):
    # of 200,000 objects, each compared with all rows, the pixels would be read 8e10 times
    pixels = spark.range(400_000).select(F.lit(1).cast("long").alias("image"), F.floor(F.col("id") / 2).alias("obj"), (F.col("id") % 1000).alias("px"), F.col("id").cast("double").alias("depth"))
    began = time.monotonic()
    assert S.composed_labels(pixels).filter("obj >= 500").count() == 0
    assert time.monotonic() - began < 60


def test_a_large_cloud_is_not_sampled(spark):
    # 5,200 points, more than the 5,000 that were left of a cloud, and a few far from the origin
    draws = np.random.default_rng(5)
    clouds = {1: draws.uniform(0, 0.035, (5_200, 3)), 2: draws.uniform(0, 0.01, (100, 3)) + 20_000}
    rows = [(k, i, *map(float, p)) for k, own in clouds.items() for i, p in enumerate(own)]
    df = spark.createDataFrame(rows, "file_id long, pid long, x double, y double, z double")
    got = {r["file_id"]: r for r in S.morphology(df, S.Morphology(outlier_k=8, outlier_ratio=1e6, epsilon=0.006)).collect()}
    assert {k: r["n"] for k, r in got.items()} == {1: 5_200, 2: 100}
    for k, own in clouds.items():
        assert [got[k][c] for c in "xyz"] == pytest.approx(own.mean(0).tolist(), abs=1e-6)
        assert got[k]["volume"] == pytest.approx(H.volume(own), rel=1e-6)
