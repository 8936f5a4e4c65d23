"""The PLY data source: ranges, columns, filters, and writes that are committed as a whole."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.plans import point_queries as Q
from furrow.sources import files, ply


@pytest.fixture
def folder(spark, tmp_path):
    ply.register(spark)
    draws = np.random.default_rng(0)
    for k, n in (("a", 1000), ("b", 37), ("c", 0)):
        (tmp_path / f"{k}.ply").write_bytes(files.format_ply({"x": draws.normal(size=n).astype("f4"), "y": draws.normal(size=n), "red": np.arange(n).astype("u1"), **({"label": np.arange(n, dtype="i4")} if k == "b" else {})}))
    return str(tmp_path)


def test_read(spark, folder):
    df = spark.read.format("ply").option("rows", 100).load(folder)
    assert df.dtypes == [("file", "string"), ("pid", "bigint"), ("x", "float"), ("y", "double"), ("red", "smallint"), ("label", "int")]
    assert df.rdd.getNumPartitions() == 11
    for name, n in (("a", 1000), ("b", 37)):
        want = files.parse_ply(open(f"{folder}/{name}.ply", "rb").read())
        got = df.filter(F.col("file") == f"{folder}/{name}.ply").orderBy("pid").collect()
        assert [r["pid"] for r in got] == list(range(n))
        assert [r["x"] for r in got] == want["x"].tolist() and [r["y"] for r in got] == want["y"].tolist() and [r["red"] for r in got] == want["red"].tolist()
        assert [r["label"] for r in got] == (want["label"].tolist() if name == "b" else [None] * n)


def test_filters_and_columns(spark, folder):
    whole = spark.read.format("ply").load(folder).cache()
    some = spark.read.format("ply").schema("pid long, x float").option("rows", 50).load(f"{folder}/a.ply")
    cut = some.filter("pid >= 120 AND pid < 260 AND x > 0.5")
    assert cut.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, cut.collect())) == sorted((r["pid"], r["x"]) for r in whole.collect() if r["file"].endswith("a.ply") and 120 <= r["pid"] < 260 and r["x"] > 0.5)
    assert spark.read.format("ply").load(folder).filter(F.col("file").isin(f"{folder}/b.ply", "none")).rdd.getNumPartitions() == 1
    assert whole.filter("x > 100").count() == 0


def test_text_and_big_endian(spark, tmp_path):
    ply.register(spark)
    (tmp_path / "t.ply").write_bytes(b"ply\nformat ascii 1.0\ncomment two points\nelement vertex 2\nproperty float x\nproperty uchar red\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n1.5 7\n2.5 255\n")
    (tmp_path / "u.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nproperty uchar red\nend_header\n" + np.array([(3.5, 9)], [("x", ">f4"), ("red", "u1")]).tobytes())
    got = sorted((os.path.basename(r["file"]), r["pid"], r["x"], r["red"]) for r in spark.read.format("ply").load(str(tmp_path)).collect())
    assert got == [("t.ply", 0, 1.5, 7), ("t.ply", 1, 2.5, 255), ("u.ply", 0, 3.5, 9)]
    (tmp_path / "v.ply").write_bytes(b"no such thing")
    with pytest.raises(Exception, match="no PLY file"):
        spark.read.format("ply").load(str(tmp_path / "v.ply")).count()


def test_round_trip(spark, sf_dir, tmp_path):
    """All clouds of a table, a file each, written by executors and read again."""
    cloud = Q.cloud(spark, sf_dir)
    out = str(tmp_path / "out")
    ply.write_clouds(cloud.select("file_id", F.col("pid").cast("int").alias("number"), "x", "y", "z").drop("file_id").withColumn("at", F.lit(0)), out, F.concat(F.lit("only"), F.lit(".ply")), F.col("number"))
    assert os.listdir(out) == ["only.ply"]
    rows = cloud.select(F.col("pid").cast("int").alias("number"), "x", "y", F.col("z").cast("float").alias("z"), F.concat("file_id", F.lit(".ply")).alias("name"))
    ply.write_clouds(rows.drop("name").withColumn("k", F.lit(1)), str(tmp_path / "one"), F.lit("k.ply"), F.col("number"))
    named = rows.withColumnRenamed("name", "file")
    ply.write_clouds(named, out, F.col("file"), F.col("number"), mode="overwrite")
    assert sorted(os.listdir(out)) == [f"{k}.ply" for k in range(10)]
    again = spark.read.format("ply").load(out)
    assert again.columns == ["file", "pid", "number", "x", "y", "z"]
    base = F.element_at(F.split("file", "/"), -1)
    got = again.select(base.alias("file"), "number", "x", "y", "z")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, named.select("file", "number", "x", "y", "z").collect()))
    assert all(r["number"] == sorted(x["number"] for x in got.filter(F.col("file") == "3.ply").collect())[r["pid"]] for r in again.filter(base == "3.ply").collect())
    assert files.parse_ply(open(f"{out}/3.ply", "rb").read())["number"].tolist() == sorted(r["number"] for r in got.collect() if r["file"] == "3.ply")


def test_failed_write_leaves_nothing(spark, tmp_path):
    ply.register(spark)
    rows = spark.createDataFrame([("a.ply", 1.0), ("b.ply", 2.0), ("a.ply", 3.0)], "file string, x double")
    with pytest.raises(Exception, match="not together|several tasks"):
        rows.repartition(3).sortWithinPartitions("x").write.format("ply").mode("append").save(str(tmp_path / "bad"))
    left = [f for _, _, names in os.walk(tmp_path / "bad") for f in names]
    assert left == []


def test_gaussians_round_trip(spark, sf_dir, tmp_path):
    """Gaussians of two files with all their lists come back as they were."""
    p = Q.points(spark, sf_dir)
    lists = {"f_dc": 3, "f_rest": 9, "scale": 3, "rot": 4}
    rows = p.select(
        F.concat((F.col("file_id") % 2).cast("string"), F.lit(".ply")).alias("name"), F.col("pid").alias("gid"), *[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("e3").cast("float").alias("opacity"),
        *[F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * F.col("e4")).cast("float")).alias(c) for c, n in lists.items()], (F.col("pid") % 5).cast("int").alias("which_object"))
    ply.write_gaussians(rows, str(tmp_path), F.col("name"), degree=1)
    again = files.read_gaussians(spark, str(tmp_path))
    names = ["x", "y", "z", "opacity", *lists, "which_object"]
    for k in ("0.ply", "1.ply"):
        got = again.filter(F.col("file").endswith(k)).orderBy("gid").select(*names).collect()
        assert got == rows.filter(F.col("name") == k).orderBy("gid").select(*names).collect()
