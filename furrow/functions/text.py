"""Names, paths, dates and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def camera_id(name: Column) -> Column:
    """The number after cam_, 0 where there is none."""
    return F.coalesce(F.regexp_extract(name, r"cam_(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def split_label(camera: Column) -> Column:
    return F.when(camera <= 10, F.lit("train")).otherwise(F.lit("test"))


def image_of_mask(name: Column) -> Column:
    """A mask's image: its name without the number of three digits at its end."""
    return F.substring(name, F.lit(1), F.length(name) - 4)


def index_of_mask(name: Column) -> Column:
    return F.right(name, F.lit(3)).try_cast("long")


def short_name(name: Column) -> Column:
    """Without the first two parts and those that begin with FIP."""
    return F.array_join(F.filter(F.slice(F.split(name, "_"), 3, 10_000), lambda t: ~F.startswith(t, F.lit("FIP"))), "_")


def padded(number: Column, digits: int) -> Column:
    return F.format_string(f"%0{digits}d", number)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(png|jpg)", "")


# Fixed value below: the characters that file names must not hold.
def clean(s: Column) -> Column:
    """Characters that names should not have, each an underscore."""
    return F.regexp_replace(s, r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def is_ascii(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]*$")


def is_chinese(s: Column) -> Column:
    return s.rlike(r"[\u4e00-\u9fff]")


def file_of_url(url: Column) -> Column:
    """The file name of an address, without its query."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)


def label_path(path: Column) -> Column:
    """The label file of an image file: the last /images/ is /labels/, the extension txt."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def run_stamp(folder: Column) -> Column:
    """The time in a run folder's name, null for other names."""
    return F.when((F.length(folder) == 17) & (F.substring(folder, 5, 1) == "-"), F.try_to_timestamp(folder, F.lit("yyyy-MM-dd_HHmmss")))


def json_number(doc: Column, path: str) -> Column:
    """A number in a JSON document, null where it is missing or not a number."""
    return F.get_json_object(doc, path).try_cast("double")


def whole_number(stem: Column) -> Column:
    return F.when(stem.rlike(r"^\d+$"), stem.try_cast("long"))


# The 91-class numbers of the 80 classes, in order.
CLASS_91 = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21,
    22, 23, 24, 25, 27, 28, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44,
    46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65,
    67, 70, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 84, 85, 86, 87, 88, 89, 90,
)


def class_91(c: Column) -> Column:
    """The 91-class number of one of 80 classes."""
    return F.element_at(F.array(*[F.lit(i) for i in CLASS_91]), c.cast("int") + 1)


def free_name(name: Column, used: Column, sep: str = "") -> Column:
    """name if it is not among the used numbers as 1, else name with the least free number from 2."""
    numbers = F.sequence(F.lit(2), F.size(used) + 2)
    free = F.array_min(F.filter(numbers, lambda n: ~F.array_contains(used, n)))
    return F.when(~F.array_contains(used, 1), name).otherwise(F.concat(name, F.lit(sep), free.cast("string")))
