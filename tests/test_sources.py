"""Readers and writers on small files."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import boxes as B
from furrow.functions import geometry as G
from furrow.operators import evaluation as E
from furrow.operators import results
from furrow.sources import files, ply, sinks


def test_gaussians_and_points(spark, tmp_path):
    n = 4
    cols = {c: np.arange(n, dtype="f4") + i for i, c in enumerate(["x", "y", "z", "opacity", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{k}" for k in range(9)), "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"])}
    (tmp_path / "g.ply").write_bytes(files.format_ply(cols))
    rows = files.read_gaussians(spark, str(tmp_path / "g.ply")).orderBy("gid").collect()
    assert len(rows) == n and rows[1]["f_rest"] == [1.0 + 7 + k for k in range(9)] and rows[0]["which_object"] == 0
    cloud = {"x": np.ones(2, "f4"), "y": np.ones(2, "f4"), "z": np.array([1, 2], "f4"), "red": np.array([1, 2], "u1"), "green": np.array([1, 2], "u1"), "blue": np.array([1, 2], "u1"), "intensity": np.array([2, 4], "f8")}
    (tmp_path / "p.ply").write_bytes(files.format_ply(cloud))
    points = files.read_points(spark, str(tmp_path / "p.ply"))
    got = files.normalised_scalar(points, "intensity").orderBy("pid").collect()
    assert [r["intensity"] for r in got] == [0.5, 1.0] and got[1]["r"] == 2 and got[0]["nx"] is None
    ply.write_points(points, str(tmp_path / "q.ply"), {"pid": "int", "x": "float", "z": "double"})
    assert files.parse_ply((tmp_path / "q.ply").read_bytes())["z"].tolist() == [1.0, 2.0]
    ascii_ply = b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"
    assert files.parse_ply(ascii_ply)["y"].tolist() == [2.0]


def test_camera_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 0 1 a_cam_01.png\n1 2 7 3 4 -1\n2 1 0 0 0 0 0 0 1 a_cam_12.png\n\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1 0 2 4\n")
    cameras, images, points = files.read_model(spark, str(tmp_path))
    assert cameras.first()["params"] == [500, 501, 320, 240]
    assert [len(r["obs"]) for r in images.orderBy("image_id").collect()] == [2, 0]
    assert points.first()["track"][1]["idx"] == 4
    masks = spark.createDataFrame([("a_cam_01.png", "m2"), ("a_cam_01.png", "m1")], "image string, path string")
    scene = files.assembled_scene(images, cameras, masks).orderBy("image_id").collect()
    assert scene[0]["masks"] == ["m1", "m2"] and [r["split"] for r in scene] == ["train", "test"]
    head = struct.pack("<Q", 1)
    (tmp_path / "cameras.bin").write_bytes(head + struct.pack("<iiQQ4d", 3, 1, 640, 480, 1, 2, 3, 4))
    (tmp_path / "images.bin").write_bytes(head + struct.pack("<i7di", 9, 1, 0, 0, 0, 0, 0, 0, 3) + b"b.png\0" + struct.pack("<Q", 1) + struct.pack("<ddq", 1, 2, -1))
    (tmp_path / "points3D.bin").write_bytes(head + struct.pack("<QdddBBBd", 5, 1, 2, 3, 1, 2, 3, 0.1) + struct.pack("<Q", 1) + struct.pack("<ii", 9, 0))
    cameras, images, points = files.read_model(spark, str(tmp_path))
    assert cameras.first()["model"] == "PINHOLE" and images.first()["name"] == "b.png" and points.first()["track"][0]["image_id"] == 9


def test_dense_array(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(3, 2, 1)
    (tmp_path / "d.bin").write_bytes(b"3&2&1&" + a.tobytes(order="F"))
    assert files.read_dense_array(spark, str(tmp_path / "d.bin")).first()["values"] == a[:, :, 0].T.ravel().tolist()


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.3 0.1 0.3 0.5\n2 0.5 1.5 0.1 0.1\n")
    rows = files.read_labels(spark, str(tmp_path / "a.txt"))
    assert {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()} == {"box": 1, "polygon": 1, "corrupt": 1}
    polygon = rows.filter("status = 'polygon'").first()
    assert polygon["xc"] == pytest.approx(0.2) and polygon["h"] == pytest.approx(0.4)
    path = rows.first()["file"]
    images = spark.createDataFrame([(path, 10), ("x", None), ("y", 0)], "label_path string, size long")
    assert tuple(files.label_counters(images, rows).first()) == (1, 1, 1, 1)


def test_annotations(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [10, 10, 20, 10], "iscrowd": 0}, {"image_id": 1, "category_id": 2, "bbox": [1, 1, 1, 1], "iscrowd": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    assert [tuple(r)[2:] for r in files.read_coco(spark, str(tmp_path / "c.json")).collect()] == [(0.2, 0.3, 0.2, 0.2)]
    (tmp_path / "v.xml").write_text("<annotation><size><width>100</width><height>50</height></size><object><name>cat</name><difficult>0</difficult><bndbox><xmin>11</xmin><ymin>11</ymin><xmax>31</xmax><ymax>21</ymax></bndbox></object><object><name>cat</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>2</ymax></bndbox></object></annotation>")
    voc = files.read_voc(spark, str(tmp_path / "v.xml"), ["dog", "cat"]).collect()
    assert [tuple(r)[1:] for r in voc] == [(1, 0.2, 0.3, 0.2, 0.2)]
    (tmp_path / "d.txt").write_text("10,10,20,10,1,4,0,0\n10,10,20,10,0,4,0,0\n")
    assert [tuple(r) for r in files.read_visdrone(spark, str(tmp_path / "d.txt"), 100, 50).collect()] == [(3, 0.2, 0.3, 0.2, 0.2)]
    geo = {"features": [{"properties": {"image_id": "a", "type_id": 11, "bounds_imcoords": "1,2,3,4"}}, {"properties": {"image_id": "a", "type_id": 99, "bounds_imcoords": "1,2,3,4"}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    assert [tuple(r) for r in files.read_geojson(spark, str(tmp_path / "g.json"), {11: 0, 12: -1}).collect()] == [("a", 0, 1.0, 2.0, 3.0, 4.0)]
    frames = {"frames": [{"file_path": "x_cam_12.png", "transform_matrix": [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]}]}
    (tmp_path / "t.json").write_text(json.dumps(frames))
    row = files.world_to_view(files.read_frames(spark, str(tmp_path / "t.json"))).first()
    assert row["split"] == "test" and row["translation"] == [-1.0, 2.0, 3.0]
    (tmp_path / "m.csv").write_text("  epoch,   loss\n 1,  0.5\n")
    assert files.read_metrics(spark, str(tmp_path / "m.csv")).first()["loss"] == 0.5
    (tmp_path / "p.txt").write_text("X Y Z I\n1 2 3 4\n")
    assert files.read_point_text(spark, str(tmp_path / "p.txt")).first()["z"] == 3.0


def test_config_is_not_run():
    own = files.dataset_config("path: ../x\ntrain: a  # c\nval: b\nnames:\n  0: wheat\n  1: head\ndownload: echo hi\n")
    assert own["nc"] == 2 and own["names"][1] == "head"
    with pytest.raises(ValueError):
        files.dataset_config("train: a\nnames: [x]\n")


def test_media_listing(spark, tmp_path):
    for name in ("b/x.png", "a/y.jpg", "a/v.mp4", "a/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    listed = files.list_media(spark, str(tmp_path))
    assert [r["kind"] for r in listed.collect()] == ["image", "image", "video"]
    assert {r["name"]: r["cls"] for r in files.class_folders(listed).collect()} == {"a": 0, "b": 1}
    assert len(files.content_key(listed).first()["key"]) == 64


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("12", "wheat", 0, 10.0, 10.0, 30.0, 20.0, 0.123456), ("im", "wheat", 1, 0.0, 0.0, 5.0, 5.0, 0.5)], "image string, name string, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sinks.detections_csv(d).first()["Confidence"] == "0.12"
    lines = sinks.detection_lines(d, 100, 50)
    assert lines.first()["value"].startswith("0 0.2")
    sinks.write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    coco = sinks.coco_records(d).collect()
    assert coco[0]["image_id"] == 12 and coco[1]["image_id"] is None and coco[0]["bbox"] == [10, 10, 20, 10] and coco[0]["score"] == 0.12346
    sinks.append_csv(d, str(tmp_path / "csv"))
    sinks.append_csv(d, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    metrics = spark.createDataFrame([("m", "v1", "psnr", 1.0), ("m", "v2", "psnr", 3.0)], "method string, view string, metric string, value double")
    got = sinks.metric_documents(metrics).first()
    assert got["mean"] == 2 and json.loads(got["per_view"]) == {"v1": 1.0, "v2": 3.0}
    assert sinks.best_of(metrics, "view", "value").first()["view"] == "v2"
    scored = spark.createDataFrame([(0, 0.5, 0.01), (1, None, 0.3), (2, 0.9, 0.02), (3, 0.9, 0.04)], "generation int, fitness double, lr double")
    assert sinks.best_of(scored, "generation", "fitness").first()["generation"] == 2 and sinks.best_of(scored.limit(0), "generation", "fitness").count() == 0
    assert [r["value"] for r in sinks.best_settings(scored, "generation", "fitness").collect()] == ["# generation: 2", "fitness: 0.9", "lr: 0.02"]
    assert sinks.voc_lines(d).first()["value"] == "wheat 0.123456 10 10 30 20"


def test_model_round_trip(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "images.txt").write_text("1 1 0 0 0 0.5 0 0 1 a_cam_01.png\n1 2 7 3 4 -1\n2 1 0 0 0 0 0 0 1 a_cam_12.png\n\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1 0 2 4\n8 1 2 3 10 20 30 0.5\n")
    model = files.read_model(spark, str(tmp_path))
    sinks.write_model(*model, str(tmp_path / "out"))
    again = files.read_model(spark, str(tmp_path / "out"))
    for a, b in zip(model, again, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_splits_traits_and_studies(spark, tmp_path):
    images = spark.createDataFrame([("p1", "b.png"), ("p1", "a.png"), ("p2", "c.png")], "plot string, file string")
    sinks.write_splits(sinks.split_documents(images, ["p2"]), str(tmp_path / "splits"))
    got = {r["split"]: [] for r in spark.read.text(str(tmp_path / "splits")).select("split").distinct().collect()}
    for r in spark.read.text(str(tmp_path / "splits")).collect():
        got[r["split"]].append(json.loads(r["value"]))
    assert got["train"] == [{"p1": ["a.png", "b.png"]}] and got["test"] == [{"p2": ["c.png"]}]
    assert sorted(got["splits"], key=str) == [{"test": ["p2"]}, {"train": ["p1"]}]
    sinks.trait_table(images, str(tmp_path / "traits"))
    assert spark.read.csv(str(tmp_path / "traits"), header=True).count() == 3
    assert [r["size"] for r in sinks.study_sizes(spark).orderBy("size").collect()] == list(range(256, 1537, 128))
    study = sinks.study_sizes(spark).selectExpr("size", "size / 3 AS map")
    lines = sinks.study_lines(study, ["size", "map"])
    assert lines.orderBy("value").first()["value"] == "       256      85.33"
    lines.write.text(str(tmp_path / "study"))
    assert sorted(r["map"] for r in files.read_study(spark, str(tmp_path / "study"), ["size", "map"]).collect())[:2] == [85.33, 128.0]
    some = spark.createDataFrame([("a", 1), ("b", 2)], "path string, length long")
    key = files.content_key(some).first()["key"]
    assert key == files.content_key(some.orderBy("length", ascending=False)).first()["key"] != files.content_key(some.filter("length = 1")).first()["key"]


def test_results(spark):
    d = spark.createDataFrame([("im", 0, 64.0, 48.0, 128.0, 96.0, 0.5, 1), ("im", 1, 0.0, 0.0, 64.0, 48.0, 0.25, 1), ("im", 2, 0.0, 0.0, 64.0, 48.0, 0.25, 7)], "image string, box_id int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    v = results.Results(d.filter("cls = 1"), ("none", "wheat"), 640, 480)
    assert v.xyxyn().first()["x2"] == 0.2 and v.xywh().first()["xc"] == 96 and v.xywhn().first()["h"] == pytest.approx(0.1)
    assert json.loads(v.records().first()["value"]) == {"xmin": 64.0, "ymin": 48.0, "xmax": 128.0, "ymax": 96.0, "confidence": 0.5, "class": 1, "name": "wheat"}
    assert v.counts().first()["said"] == "2 wheats"
    assert results.Results(d, ("none", "wheat"), 640, 480).xyxy().filter("name is null").count() == 1
    seen = results.restored(d.selectExpr("image", "box_id", "(640 - x2) * 0.5 AS x1", "y1 * 0.5 AS y1", "(640 - x1) * 0.5 AS x2", "y2 * 0.5 AS y2", "conf", "cls"), 0.5, 640)
    assert [tuple(r)[2:6] for r in seen.collect()] == [tuple(r)[2:6] for r in d.collect()]


def test_flat_and_equal(spark):
    one = spark.range(1)
    flat = one.select(B.size_ratio(F.lit(0.0), F.lit(10.0)).alias("a"), B.size_ratio(F.lit(5.0), F.lit(10.0)).alias("b")).first()
    assert tuple(flat) == (float("inf"), 2.0)
    q = G.unit([F.lit(0.0)] * 4)
    assert one.select(*[c.alias(f"c{i}") for i, c in enumerate(c for row in G.rotation(q) for c in row)]).first()[0] == 1.0
    assert tuple(one.select(E.psnr(F.lit(0.0)), E.psnr(F.lit(0.01)), E.psnr(F.lit(None).cast("double"))).first()) == (float("inf"), pytest.approx(20), None)


def test_media_lists_patterns_and_strides(spark, tmp_path):
    for name in ("a/1.jpg", "a/2.PNG", "a/note.md", "b/3.mp4", "b/4.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/b/4.jpg\n\n{tmp_path}/a\n{tmp_path}/b/*.jpg\n")
    names = lambda df: [r["path"].rpartition("/")[2] for r in df.collect()]
    assert names(files.list_media(spark, f"{tmp_path}/list.txt")) == ["1.jpg", "2.PNG", "4.jpg"]
    assert names(files.list_media(spark, f"{tmp_path}/*/*.jpg")) == ["1.jpg", "4.jpg"]
    media = files.list_media(spark, [f"{tmp_path}/a/1.jpg", f"{tmp_path}/b"])
    assert names(media) == ["1.jpg", "4.jpg", "3.mp4"]
    looked = files.frames_of(media, F.lit(10), 3)
    assert [(r["path"][-5:], r["frame"]) for r in looked.orderBy("path", "frame").collect()] == [("1.jpg", 0), ("3.mp4", 2), ("3.mp4", 5), ("3.mp4", 8), ("4.jpg", 0)]
    assert files.frames_of(media.filter("kind = 'video'"), F.lit(2), 3).count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.md").write_text("")
    with pytest.raises(FileNotFoundError):
        files.list_media(spark, f"{tmp_path}/c")
