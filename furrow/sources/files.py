"""Readers of point clouds, camera models, labels and annotations, and writers of the same.

Text formats are read with Spark's own readers; binary ones as whole files by Arrow tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Number types of PLY, and camera models with their number of parameters.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
CAMERA_MODELS = (("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12))


def parse_ply(raw: bytes) -> dict[str, np.ndarray]:
    """The vertex properties of a PLY file, ASCII or binary."""
    head, _, body = raw.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    kind = next(x[1] for x in lines if x[:1] == ["format"])
    count, fields, inside = 0, [], False
    for x in lines:
        if x[:1] == ["element"]:
            if fields:
                break
            inside = x[1] == "vertex"
            count = int(x[2]) if inside else count
        elif x[:1] == ["property"] and inside:
            fields.append((x[-1], PLY_TYPES[x[1]]))
    if kind == "ascii":
        table = np.array([line.split() for line in body.decode().splitlines()[:count]], dtype=object).reshape(count, -1)
        return {n: table[:, i].astype(t) for i, (n, t) in enumerate(fields)}
    order = "<" if kind == "binary_little_endian" else ">"
    data = np.frombuffer(body, np.dtype([(n, order + t) for n, t in fields]), count)
    return {n: data[n] for n, _ in fields}


def format_ply(columns: dict[str, np.ndarray]) -> bytes:
    """A little-endian PLY file of vertex properties."""
    back = {v: k for k, v in PLY_TYPES.items() if not k[-1].isdigit()}
    kinds = [(n, c.dtype.str[1:]) for n, c in columns.items()]
    n = len(next(iter(columns.values())))
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {back[t]} {c}" for c, t in kinds), "end_header", ""]
    data = np.empty(n, np.dtype([(c, "<" + t) for c, t in kinds]))
    for c, v in columns.items():
        data[c] = v
    return "\n".join(head).encode() + data.tobytes()


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _by_file(parse, names: list[str], types: list[pa.DataType]):
    """An Arrow task that makes rows of whole files; parse(path, bytes) gives one list for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = parse(path, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _suffixed(columns: dict[str, np.ndarray], prefix: str) -> list[str]:
    """Columns with a prefix, by the number at their end."""
    return sorted((c for c in columns if c.startswith(prefix)), key=lambda c: int(c.rpartition("_")[2]))


def read_gaussians(spark: SparkSession, path: str) -> DataFrame:
    """Gaussian PLY files: place, opacity, harmonics, scale, rotation, object (0 where not given)."""

    def parse(file: str, raw: bytes) -> list:
        p = parse_ply(raw)
        rest = _suffixed(p, "f_rest_")
        degree = round((len(rest) / 3 + 1) ** 0.5) - 1
        if len(rest) != 3 * (degree + 1) ** 2 - 3:
            raise ValueError(f"{file}: {len(rest)} f_rest columns are of no degree")
        n = len(p["x"])
        lists = [np.stack([p[c] for c in cs], 1).astype(np.float32).tolist() if cs else [[]] * n for cs in (_suffixed(p, "f_dc_"), rest, _suffixed(p, "scale_"), _suffixed(p, "rot_"))]
        return [[file] * n, np.arange(n), *(p[c].astype(np.float32) for c in ("x", "y", "z", "opacity")), *lists, p.get("which_object", np.zeros(n)).astype(np.int32)]

    f, l = pa.float32(), pa.list_(pa.float32())
    names = ["file", "gid", "x", "y", "z", "opacity", "f_dc", "f_rest", "scale", "rot", "which_object"]
    schema = "file string, gid long, x float, y float, z float, opacity float, f_dc array<float>, f_rest array<float>, scale array<float>, rot array<float>, which_object int"
    return _whole_files(spark, path).mapInArrow(_by_file(parse, names, [pa.string(), pa.int64(), f, f, f, f, l, l, l, l, pa.int32()]), schema)


COLOURS = (("red", "r"), ("green", "g"), ("blue", "b"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point PLY files: place, colours and normals where all three are given, all else as scalars."""

    def parse(file: str, raw: bytes) -> list:
        p = parse_ply(raw)
        n = len(p["x"])
        colours = [next((p[c] for c in pair if c in p), None) for pair in COLOURS]
        normals = [p.get(c) for c in ("nx", "ny", "nz")]
        known = {"x", "y", "z", "nx", "ny", "nz", *(c for pair in COLOURS for c in pair)}
        others = [c for c in p if c not in known]
        scalars = [list(zip(others, map(float, row), strict=True)) for row in zip(*(p[c].tolist() for c in others), strict=True)] if others else [[]] * n
        full = lambda group, t: [c.astype(t) for c in group] if all(c is not None for c in group) else [[None] * n] * 3
        return [[file] * n, np.arange(n), *(p[c].astype(float) for c in "xyz"), *full(colours, np.int16), *full(normals, float), scalars]

    d, i = pa.float64(), pa.int16()
    names = ["file", "pid", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "scalars"]
    schema = "file string, pid long, x double, y double, z double, r short, g short, b short, nx double, ny double, nz double, scalars map<string,double>"
    return _whole_files(spark, path).mapInArrow(_by_file(parse, names, [pa.string(), pa.int64(), d, d, d, i, i, i, d, d, d, pa.map_(pa.string(), d)]), schema)


def normalised_scalar(points: DataFrame, name: str) -> DataFrame:
    """points with a scalar divided by its greatest value in the file."""
    value = F.col("scalars")[name]
    return points.withColumn(name, value / F.max(value).over(Window.partitionBy("file")))


def read_point_text(spark: SparkSession, path: str) -> DataFrame:
    """Clouds as text with a header and single blanks: the first three columns."""
    df = spark.read.csv(path, sep=" ", header=True)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(df.columns[:3], "xyz", strict=True)], F.col("_metadata.file_path").alias("file"))


def _words(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera models, text or binary: camera_id, model, width, height, params."""
    if not path.endswith(".bin"):
        w = _words(spark.read.text(path))
        return w.select(F.col("w")[0].cast("long").alias("camera_id"), F.col("w")[1].alias("model"), F.col("w")[2].cast("long").alias("width"), F.col("w")[3].cast("long").alias("height"), _doubles(F.slice("w", 5, 1000)).alias("params"))

    def parse(_file: str, raw: bytes) -> list:
        (n,), at, rows = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            number, model, width, height = struct.unpack_from("<iiQQ", raw, at)
            name, count = CAMERA_MODELS[model]
            rows.append((number, name, width, height, list(struct.unpack_from(f"<{count}d", raw, at + 24))))
            at += 24 + 8 * count
        return list(zip(*rows, strict=True)) or [[]] * 5

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    return _whole_files(spark, path).mapInArrow(_by_file(parse, ["camera_id", "model", "width", "height", "params"], types), "camera_id long, model string, width long, height long, params array<double>")


OBS = "array<struct<x:double,y:double,point3d_id:long>>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Posed images, text (two lines each) or binary: image_id, qvec, tvec, camera_id, name, obs."""
    obs_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("point3d_id", pa.int64())]))

    def binary(_file: str, raw: bytes) -> list:
        (n,), at, rows = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            head = struct.unpack_from("<i7di", raw, at)
            end = raw.index(b"\0", at + 64)
            name = raw[at + 64 : end].decode()
            (m,) = struct.unpack_from("<Q", raw, end + 1)
            obs = [{"x": x, "y": y, "point3d_id": p} for x, y, p in struct.iter_unpack("<ddq", raw[end + 9 : end + 9 + 24 * m])]
            rows.append((head[0], list(head[1:5]), list(head[5:8]), head[8], name, obs))
            at = end + 9 + 24 * m
        return list(zip(*rows, strict=True)) or [[]] * 6

    def text(_file: str, raw: bytes) -> list:
        lines = [x for x in raw.decode().splitlines() if not x.startswith("#")]
        while lines and not lines[0].strip():
            lines.pop(0)
        rows = []
        for first, second in zip(lines[::2], [*lines[1::2], ""], strict=False):
            w, o = first.split(), second.split()
            if not w:
                continue
            obs = [{"x": float(o[i]), "y": float(o[i + 1]), "point3d_id": int(o[i + 2])} for i in range(0, len(o) - 2, 3)]
            rows.append((int(w[0]), list(map(float, w[1:5])), list(map(float, w[5:8])), int(w[8]), w[9], obs))
        return list(zip(*rows, strict=True)) or [[]] * 6

    names, doubles = ["image_id", "qvec", "tvec", "camera_id", "name", "obs"], pa.list_(pa.float64())
    task = _by_file(binary if path.endswith(".bin") else text, names, [pa.int64(), doubles, doubles, pa.int64(), pa.string(), obs_type])
    return _whole_files(spark, path).mapInArrow(task, f"image_id long, qvec array<double>, tvec array<double>, camera_id long, name string, obs {OBS}")


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructed points, text or binary: point_id, x, y, z, r, g, b, error, track."""
    track = "array<struct<image_id:int,idx:int>>"
    if not path.endswith(".bin"):
        w, c = _words(spark.read.text(path)), F.col("w")
        pairs = F.transform(F.sequence(F.lit(8), F.size("w") - 2, F.lit(2)), lambda i: F.struct(c[i].cast("int").alias("image_id"), c[i + 1].cast("int").alias("idx")))
        pairs = F.when(F.size("w") > 9, pairs).otherwise(F.array().cast(track))
        return w.select(c[0].cast("long").alias("point_id"), *[c[i].cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))], *[c[i].cast("short").alias(n) for i, n in ((4, "r"), (5, "g"), (6, "b"))], c[7].cast("double").alias("error"), pairs.alias("track"))

    def parse(_file: str, raw: bytes) -> list:
        (n,), at, rows = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            head = struct.unpack_from("<QdddBBBd", raw, at)
            (m,) = struct.unpack_from("<Q", raw, at + 43)
            rows.append((*head, [{"image_id": i, "idx": k} for i, k in struct.iter_unpack("<ii", raw[at + 51 : at + 51 + 8 * m])]))
            at += 51 + 8 * m
        return list(zip(*rows, strict=True)) or [[]] * 9

    d, i = pa.float64(), pa.int16()
    types = [pa.int64(), d, d, d, i, i, i, d, pa.list_(pa.struct([("image_id", pa.int32()), ("idx", pa.int32())]))]
    return _whole_files(spark, path).mapInArrow(_by_file(parse, ["point_id", "x", "y", "z", "r", "g", "b", "error", "track"], types), f"point_id long, x double, y double, z double, r short, g short, b short, error double, track {track}")


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, images, points) of a model folder, binary where that is there."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{folder}/cameras.bin")
    ext = "bin" if found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found) else "txt"
    return read_cameras(spark, f"{folder}/cameras.{ext}"), read_images(spark, f"{folder}/images.{ext}"), read_points3d(spark, f"{folder}/points3D.{ext}")


def assembled_scene(images: DataFrame, cameras: DataFrame, masks: DataFrame) -> DataFrame:
    """Views with their camera and sorted mask files, and a split by camera number; masks has image and path."""
    from ..functions.text import camera_id, split_label

    grouped = masks.groupBy(F.col("image").alias("name")).agg(F.sort_array(F.collect_list("path")).alias("masks"))
    number = camera_id(F.col("name"))
    return images.join(cameras, "camera_id").join(grouped, "name", "left").withColumn("split", split_label(number))


def read_dense_array(spark: SparkSession, path: str) -> DataFrame:
    """Dense maps with a width&height&channels& header: file, width, height, channels, values by row."""

    def parse(file: str, raw: bytes) -> list:
        w, h, c, body = raw.split(b"&", 3)
        w, h, c = int(w), int(h), int(c)
        values = np.frombuffer(body, "<f4", w * h * c).reshape((w, h, c), order="F").transpose(1, 0, 2)
        return [[file], [w], [h], [c], [values.ravel().tolist()]]

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
    return _whole_files(spark, path).mapInArrow(_by_file(parse, ["file", "width", "height", "channels", "values"], types), "file string, width int, height int, channels int, values array<float>")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files: file, cls, xc, yc, w, h, polygon, status (box, polygon or corrupt); equal rows once."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("t"))
    n, numbers = F.size("t"), F.transform(F.slice("t", 2, 1_000_000), lambda x: x.try_cast("double"))
    good = F.col("t")[0].try_cast("int").isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    status = F.when(good & (n > 6) & (n % 2 == 1), "polygon").when(good & (n == 5), "box").otherwise("corrupt")
    points = F.transform(F.sequence(F.lit(0), F.size("v") - 2, F.lit(2)), lambda i: F.struct(F.col("v")[i].alias("x"), F.col("v")[i + 1].alias("y")))
    named = rows.select("file", F.col("t")[0].try_cast("int").alias("cls"), numbers.alias("v"), status.alias("status")).withColumn("polygon", F.when(F.col("status") == "polygon", points))
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    poly = F.col("status") == "polygon"
    box = F.col("status") == "box"
    pick = lambda i, other: F.when(box, F.get("v", F.lit(i))).when(poly, other)
    return named.select("file", "cls", pick(0, (F.array_min(xs) + F.array_max(xs)) / 2).alias("xc"), pick(1, (F.array_min(ys) + F.array_max(ys)) / 2).alias("yc"), pick(2, F.array_max(xs) - F.array_min(xs)).alias("w"), pick(3, F.array_max(ys) - F.array_min(ys)).alias("h"), "polygon", "status").dropDuplicates()


def label_counters(images: DataFrame, labels: DataFrame) -> DataFrame:
    """found, missing, empty and corrupt label files; images has label_path, and size of that file or null."""
    corrupt = labels.filter("status = 'corrupt'").select(F.col("file").alias("label_path")).distinct().withColumn("bad", F.lit(True))
    own = images.join(corrupt, "label_path", "left")
    return own.agg(F.count_if(F.col("size") > 0).alias("found"), F.count_if(F.col("size").isNull()).alias("missing"), F.count_if(F.col("size") == 0).alias("empty"), F.count_if(F.coalesce("bad", F.lit(False))).alias("corrupt"))


def content_key(files: DataFrame) -> DataFrame:
    """A key of a set of files (path, length) that changes with their sizes or paths, in whatever order they come."""
    digest = F.sha2(F.concat_ws(":", F.col("path"), F.col("length").cast("string")).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    sums = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), *[F.sum(p).alias(f"p{i}") for i, p in enumerate(parts)])
    return sums.select(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in sums.columns]).cast("binary"), 256).alias("key"))


# The file types that are read.
IMAGE_TYPES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")
VIDEO_TYPES = ("asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv")


def list_media(spark: SparkSession, path: str | list[str], limit: int = 0) -> DataFrame:
    """Images, then videos, by path; metadata only.

    path is a folder, a file, a pattern with * in it, a .txt file with one of these on each line,
    or several of these. Nothing to list is an error.
    """
    given = path if isinstance(path, list) else [path]
    lines = [p for p in given if p.endswith(".txt")]
    if lines:  # a list is as long as the paths that Spark is told to read
        given = [p for p in given if p not in lines] + [r["value"].strip() for r in spark.read.text(lines).filter(F.trim("value") != "").collect()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(*IMAGE_TYPES), "image").when(ext.isin(*VIDEO_TYPES), "video")
    out = files.withColumn("kind", kind).filter("kind is not null").dropDuplicates(["path"]).orderBy("kind", "path")
    if out.isEmpty():
        raise FileNotFoundError(f"no images or videos in {path}")
    return out.limit(limit) if limit else out


def frames_of(media: DataFrame, frames: Column, stride: int = 1) -> DataFrame:
    """media with a row for each frame that is looked at: 0 of an image, every stride-th of a video of frames frames, the last of each stride."""
    last = F.when(F.col("kind") == "image", F.array(F.lit(0))).otherwise(F.when(frames >= stride, F.sequence(F.lit(stride - 1), (frames - 1).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>")))
    return media.withColumn("frame", F.explode(last))


def class_folders(files: DataFrame) -> DataFrame:
    """Files with the class of their folder, numbered by the folder's name; the window sees one row a folder."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -2))
    numbers = named.select("name").distinct().withColumn("cls", F.row_number().over(Window.orderBy("name")) - 1)
    return named.join(numbers, "name")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames of a transforms file: file_path, transform (16 numbers by row), camera, split."""
    from ..functions.text import camera_id, split_label

    f = spark.read.json(path, multiLine=True).select(F.explode("frames").alias("f"))
    flat = F.transform(F.flatten("f.transform_matrix"), lambda x: x.cast("double"))
    return f.select("f.file_path", flat.alias("transform"), camera_id(F.col("f.file_path")).alias("camera")).withColumn("split", split_label(F.col("camera")))


def world_to_view(frames: DataFrame) -> DataFrame:
    """frames with rotation (9, by row) and translation (3) of the inverse, y and z flipped first."""
    t = F.col("transform")
    m = [[t[4 * i + j] * (-1.0 if j in (1, 2) else 1.0) for j in range(3)] for i in range(3)]
    rotation = F.array(*[m[j][i] for i in range(3) for j in range(3)])
    translation = F.array(*[-(m[0][i] * t[3] + m[1][i] * t[7] + m[2][i] * t[11]) for i in range(3)])
    return frames.withColumn("rotation", rotation).withColumn("translation", translation)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of a COCO file that are no crowds: file_name, cls, and box normalised from top-left and size."""
    doc = spark.read.json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", F.col("a.category_id").alias("cls"), "a.bbox", F.coalesce(F.col("a.iscrowd").cast("int"), F.lit(0)).alias("crowd")).filter("crowd = 0")
    b, w, h = F.col("bbox"), F.col("width"), F.col("height")
    return notes.join(images, "image_id").select("file_name", "cls", ((b[0] + b[2] / 2) / w).alias("xc"), ((b[1] + b[3] / 2) / h).alias("yc"), (b[2] / w).alias("w"), (b[3] / h).alias("h"))


def read_voc(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Objects of VOC XML files of known classes and not difficult; corners start at 1."""
    schema = "size struct<width:double,height:double>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_xml("value", schema).alias("x"))
    o = rows.select("file", "x.size", F.explode("x.object").alias("o")).filter(F.col("o.name").isin(*names) & (F.coalesce("o.difficult", F.lit(0)) != 1))
    b, w, h = F.col("o.bndbox"), F.col("size.width"), F.col("size.height")
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("o.name")) - 1
    return o.select("file", number.cast("int").alias("cls"), (((b["xmin"] + b["xmax"]) / 2 - 1) / w).alias("xc"), (((b["ymin"] + b["ymax"]) / 2 - 1) / h).alias("yc"), ((b["xmax"] - b["xmin"]) / w).alias("w"), ((b["ymax"] - b["ymin"]) / h).alias("h"))


def read_visdrone(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Comma-separated rows left, top, width, height, score, class, ...; score 0 is ignored, classes start at 1."""
    rows = spark.read.csv(path).filter("_c4 != '0'")
    x, y, w, h = (F.col(f"_c{i}").cast("double") for i in range(4))
    return rows.select((F.col("_c5").cast("int") - 1).alias("cls"), F.round((x + w / 2) / width, 6).alias("xc"), F.round((y + h / 2) / height, 6).alias("yc"), F.round(w / width, 6).alias("w"), F.round(h / height, 6).alias("h"))


def read_boxes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows image, x1, y1, x2, y2, class, image width, image height."""
    return spark.read.csv(path, schema="image string, x1 double, y1 double, x2 double, y2 double, cls string, image_w double, image_h double")


def read_geojson(spark: SparkSession, path: str, classes: dict[int, int]) -> DataFrame:
    """Features with their class mapped, those of class -1 or unknown left out: image, cls, x1, y1, x2, y2."""
    f = spark.read.json(path, multiLine=True).select(F.explode("features.properties").alias("p"))
    bounds = _doubles(F.split("p.bounds_imcoords", ","))
    table = F.create_map(*[F.lit(v) for pair in classes.items() for v in pair])
    rows = f.select(F.col("p.image_id").alias("image"), F.try_element_at(table, F.col("p.type_id").cast("int")).alias("cls"), bounds.alias("b")).filter("cls between 0 and 59")
    return rows.select("image", "cls", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics as CSV, blanks around names and numbers dropped."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in df.columns])


def latest_iteration(files: DataFrame) -> DataFrame:
    """The greatest number at the end of a folder's name."""
    return files.agg(F.max(F.regexp_extract("path", r"_(\d+)/?$", 1).try_cast("int")).alias("iteration"))


def depth_scales(params: DataFrame) -> DataFrame:
    """(image, scale, offset) with the median of the positive scales, 0 where there is none."""
    return params.crossJoin(F.broadcast(params.agg(F.coalesce(F.median(F.when(F.col("scale") > 0, F.col("scale"))), F.lit(0.0)).alias("med_scale"))))


def dataset_config(text: str) -> dict:
    """A dataset description: train, val and names are needed, a list of names is numbered. Nothing is run."""
    import json

    own: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if line[0] not in " \t-":
            key, _, value = line.partition(":")
            value = value.strip()
            own[key] = json.loads(value.replace("'", '"')) if value.startswith("[") else value
        else:
            item = line.strip()
            if item.startswith("- "):
                own[key] = [*(own[key] or []), item[2:].strip()]
            else:
                k, _, value = item.partition(":")
                own[key] = {**(own[key] or {}), int(k) if k.strip().isdigit() else k.strip(): value.strip()}
    for k in ("train", "val", "names"):
        if k not in own:
            raise ValueError(f"{k} is missing")
    if isinstance(own["names"], list):
        own["names"] = dict(enumerate(own["names"]))
    own["nc"] = len(own["names"])
    return own


def read_study(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A study's text file: numbers between blanks, in the order of columns."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"))
    return rows.select(*[F.get("t", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)])
