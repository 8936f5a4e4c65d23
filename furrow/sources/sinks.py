"""Writers of detections, metrics and traits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B


def short_number(c: Column, digits: int = 6, width: int = 0) -> Column:
    """A number with so many digits at most, without zeros at its end, set right in a width."""
    text = F.format_string(f"%.{digits}g", c.cast("double"))
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.lpad(text, width, " ") if width else text


def detections_csv(detections: DataFrame) -> DataFrame:
    """Rows as the detections CSV has them: image, name, confidence with two decimals."""
    return detections.select(F.col("image").alias("Image Name"), F.col("name").alias("Prediction"), F.format_string("%.2f", "conf").alias("Confidence"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def detection_lines(detections: DataFrame, width: float, height: float, with_conf: bool = True) -> DataFrame:
    """(image, value): a line of class, normalised box and confidence for each detection."""
    n = B.pixels_to_normalised(B.box(), width, height)
    parts = [F.col("cls").cast("string"), *map(short_number, n), *([short_number(F.col("conf"))] if with_conf else [])]
    return detections.select("image", F.concat_ws(" ", *parts).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text for each image."""
    lines.repartition("image").write.partitionBy("image").text(path)


def coco_records(detections: DataFrame) -> DataFrame:
    """Detections as COCO results: image_id a number where it is one, box from top-left, rounded."""
    x, y, w, h = B.xyxy_to_ltwh(B.box())
    image = F.col("image").cast("string")
    return detections.select(F.when(image.rlike(r"^\d+$"), image.try_cast("long")).alias("image_id"), image.alias("image"), F.col("cls").alias("category_id"), F.array(*[F.bround(c, 3) for c in (x, y, w, h)]).alias("bbox"), F.bround("conf", 5).alias("score"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def box_documents(boxes: DataFrame) -> DataFrame:
    """One JSON object for each 3-D box, keyed by its name."""
    fields = [c for c in boxes.columns if c != "key"]
    return boxes.select(F.to_json(F.create_map(F.col("key"), F.struct(*fields))).alias("value"))


def metric_documents(per_view: DataFrame) -> DataFrame:
    """(method, metric, per_view JSON, mean) of per-view metrics (method, view, metric, value)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "value"))))
    return per_view.groupBy("method", "metric").agg(F.to_json(entries).alias("per_view"), F.avg("value").alias("mean"))


def camera_documents(views: DataFrame) -> DataFrame:
    """Cameras as JSON: id, name, size, position, rotation, focal lengths."""
    return views.select(F.to_json(F.struct("id", "img_name", "width", "height", "position", "rotation", "fx", "fy")).alias("value"))


def best_of(results: DataFrame, by: str, score: str) -> DataFrame:
    """The row with the best score, the earliest of equals; rows without a score do not count."""
    rows = results.filter(F.col(score).isNotNull()).select(F.struct("*").alias("row"))
    first = F.min_by("row", F.struct((-F.col(f"row.{score}")).alias("s"), F.col(f"row.{by}").alias("b")))
    return rows.agg(first.alias("row")).filter("row is not null").select("row.*")


def best_settings(results: DataFrame, by: str, score: str) -> DataFrame:
    """The best row as lines of YAML: name: value, the generation as a comment."""
    best = best_of(results, by, score)
    lines = [F.concat(F.lit("# generation: "), F.col(by).cast("string")), *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in best.columns if c != by]]
    return best.select(F.explode(F.array(*lines)).alias("value"))


def trait_table(traits: DataFrame, path: str) -> None:
    """Traits as CSV with a header, a row for each cloud."""
    traits.write.mode("overwrite").option("header", True).csv(path)


def split_documents(images: DataFrame, test: list[str]) -> DataFrame:
    """(split, value): JSON lists of the image files of train and test, and of each split's plots; images has plot and file."""
    split = F.when(F.col("plot").isin(*test), "test").otherwise("train")
    rows = images.select("plot", "file", split.alias("split"))
    plots = rows.groupBy("split").agg(F.to_json(F.array_sort(F.collect_set("plot"))).alias("plots"))
    files = rows.groupBy("split", "plot").agg(F.array_sort(F.collect_list("file")).alias("files"))
    listed = files.select("split", F.to_json(F.create_map("plot", "files")).alias("value"))
    return listed.unionByName(plots.select(F.lit("splits").alias("split"), F.concat(F.lit('{"'), F.col("split"), F.lit('":'), F.col("plots"), F.lit("}")).alias("value")))


def write_splits(documents: DataFrame, path: str) -> None:
    """A folder of JSON lines for each split, and one for the splits."""
    documents.write.mode("overwrite").partitionBy("split").text(path)


#: Image sizes of a study, both ends included, and how numbers are written in one.
STUDY_SIZES = (256, 1536, 128)


def study_sizes(spark: SparkSession) -> DataFrame:
    """(size,): the image sizes of a study."""
    first, last, step = STUDY_SIZES
    return spark.range(first, last + 1, step).select(F.col("id").alias("size"))


def study_lines(results: DataFrame, columns: list[str]) -> DataFrame:
    """(value,): a study's rows as numbers of four digits in ten places."""
    return results.select(F.concat_ws(" ", *[short_number(F.col(c), 4, 10) for c in columns]).alias("value"))


def voc_lines(detections: DataFrame) -> DataFrame:
    """(image, value): a line of class name, confidence and corners in pixels for each detection."""
    numbers = [short_number(F.col(c)) for c in ("conf", "x1", "y1", "x2", "y2")]
    return detections.select("image", F.concat_ws(" ", "name", *numbers).alias("value"))


def model_text(cameras: DataFrame) -> DataFrame:
    """Cameras as lines of a model's text file."""
    return cameras.select(F.concat_ws(" ", "camera_id", "model", "width", "height", F.array_join(F.transform("params", lambda p: p.cast("string")), " ")).alias("value"))


def image_text(images: DataFrame) -> DataFrame:
    """Views as two lines each of a model's text file: pose and camera, then observations (x, y, point)."""
    words = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), " ")
    seen = F.array_join(F.transform("obs", lambda o: F.concat_ws(" ", *[o[c].cast("string") for c in ("x", "y", "point3d_id")])), " ")
    pose = F.concat_ws(" ", "image_id", words("qvec"), words("tvec"), "camera_id", "name")
    return images.select(F.explode(F.array(pose, seen)).alias("value"))


def point_text(points: DataFrame) -> DataFrame:
    """Points as lines of a model's text file: place, colour, error and track (image and observation)."""
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["idx"].cast("string"))), " ")
    fields = [F.col(c).cast("string") for c in ("point_id", "x", "y", "z", "r", "g", "b", "error")]
    return points.select(F.concat_ws(" ", *fields, F.when(track != "", track)).alias("value"))


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """A model's three text files, each a folder of lines that the readers take."""
    for name, lines in (("cameras", model_text(cameras)), ("images", image_text(images)), ("points3D", point_text(points))):
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.txt")
