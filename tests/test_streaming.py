"""Streams against their batch twins."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from furrow.plans.fixtures import frames, table
from furrow.streaming import frames as S
from furrow.streaming import hooks as H


def run(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latest_and_stride(spark, sf_dir, tmp_path):
    own = frames(spark, sf_dir).select("source", "frame", "value")
    own.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    got = run(S.latest(stream), "update", tmp_path, "latest").groupBy("source").agg(F.max("frame").alias("frame"))
    want = own.groupBy("source").agg(F.max("frame").alias("frame"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert run(S.strided(stream, 3), "append", tmp_path, "strided").count() == own.filter("frame % 3 = 0").count()


def test_windows_behind_the_watermark(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in run(S.windowed(stream), "append", tmp_path, "windows").collect()}
    twin = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    want = {(str(r["w"]["start"]), r["event_type"]): r["count"] for r in twin.collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) <= 10  # the last day stays open


def test_second_strike_and_resume(spark, tmp_path):
    spark.createDataFrame([(1, False), (2, True), (3, False), (3, False)], "mask long, matched boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mask long, matched boolean").parquet(str(tmp_path / "in"))
    got = run(S.second_strike(stream), "update", tmp_path, "strikes")
    last = {r["mask"]: r["status"] for r in got.collect()}
    assert last == {1: "buffered", 2: "processed", 3: "processed"}
    items = spark.createDataFrame([(1,), (2,), (3,)], "mask long")
    assert {r["mask"] for r in S.not_done(items, got.filter("status = 'processed'"), "mask").collect()} == {1}


def test_strikes_over_restarts(spark, sf_dir, tmp_path):
    """Input in four parts, one of them twice and late, a restart before each: the last word on each mask is that of the batch over all of it."""
    own = table(spark, sf_dir, "events").filter("event_id < 60").select((F.col("event_id") % 37).alias("mask"), (F.col("event_type") == "purchase").alias("matched"), "event_id")
    schema, said = own.drop("event_id").schema, {}

    def go():
        def put(df, _):
            said.update({r["mask"]: r["status"] for r in df.collect()})

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        S.second_strike(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)

    whole = None
    for part in (2, 0, 1, 2):
        new = own.filter(F.col("event_id") % 3 == part).drop("event_id").coalesce(1)
        new.write.mode("append").parquet(str(tmp_path / "in"))
        go()
        whole = new if whole is None else whole.unionByName(new)
        assert said == {r["mask"]: r["status"] for r in S.strikes(whole).collect()}
    assert set(said.values()) == {"processed", "buffered"}


def test_strikes_are_forgotten(spark, tmp_path):
    schema = "mask long, matched boolean"
    said = []

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        put = lambda df, _: said.extend(tuple(r) for r in df.collect())
        q = S.second_strike(stream, 1000).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "at")).start()
        before, began = len(said), time.time()
        while len(said) == before and time.time() - began < 40:  # a query with a clock never runs out of batches
            time.sleep(0.2)
        q.stop()

    for _ in range(2):
        spark.createDataFrame([(7, False)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        go()
        time.sleep(2.5)
    assert said == [(7, "buffered"), (7, "buffered")]


def test_accumulated_state(spark, tmp_path):
    """Contributions that arrive in two runs add up, from where the first left off."""
    schema = "obj long, gid long, w double"
    rows = [(1, 1, 0.5), (1, 2, 1.0), (2, 1, 0.25)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got: list[tuple] = []

    def go():
        put = lambda df, _: got.extend(tuple(r) for r in df.collect())
        S.accumulated(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)

    go()
    assert sorted(got) == rows
    spark.createDataFrame([(1, 1, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got.clear()
    go()
    assert got == [(1, 1, 2.5)]


def test_hooks_and_resumption(spark, tmp_path):
    said, hooks = [], H.Hooks()
    hooks.on("started", lambda e: said.append("started"), "a")
    hooks.on("progress", lambda p: said.append(p.numInputRows), "b")
    hooks.on("ended", lambda e: said.append("ended"), "c")
    hooks.on("ended", lambda e: said.append("never"), "d")
    hooks.off("ended", "d")
    assert hooks.registered("ended") == ["c"]
    with pytest.raises(ValueError, match="none of"):
        hooks.on("epoch", print)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    spark.streams.addListener(hooks)
    try:
        for total in (5, 8):
            H.resumed(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
            assert spark.read.parquet(str(tmp_path / "out")).count() == total
            spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(100):
            if said.count("ended") == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hooks)
    assert said.count("started") == said.count("ended") == 2 and 5 in said and "never" not in said
