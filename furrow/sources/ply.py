"""PLY files of vertices as a Spark data source: spark.read.format("ply"), df.write.format("ply").

A file is read in ranges of rows by many tasks, with the columns of the schema asked for, and only
ranges and rows that pass the filters on file, pid and numbers. Files are written by executors, one
for each value of the column file, and appear when the whole write is committed.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from .files import PLY_TYPES

#: Rows of a range, and bytes of a header at most.
RANGE_ROWS, HEAD_BYTES = 1 << 20, 1 << 16
#: Spark's type of each number type, unsigned ones in the next larger.
KINDS: dict[str, DataType] = {"i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
WRITTEN = {"tinyint": "i1", "smallint": "i2", "int": "i4", "float": "f4", "double": "f8"}
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, as far as pyarrow knows it, and the path in it."""
    system, inner = fs.FileSystem.from_uri(path) if ":/" in path else fs.FileSystem.from_uri("file://" + posixpath.abspath(path))
    return system, inner


def clouds(path: str) -> list[str]:
    """The PLY files at a path: a file, a folder, or several, separated by commas."""
    out = []
    for one in path.split(","):
        system, inner = place(one)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        found = [inner] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".ply"))
        out += [one if f == inner else f"{one.rstrip('/')}/{posixpath.basename(f)}" for f in found]
    return out


@dataclass(frozen=True)
class Head:
    """What a header says of the vertices."""

    kind: str
    rows: int
    start: int
    columns: tuple[tuple[str, str], ...]

    @property
    def row(self) -> np.dtype:
        order = ">" if self.kind == "binary_big_endian" else "<"
        return np.dtype([(n, order + t) for n, t in self.columns])


def head(path: str) -> Head:
    system, inner = place(path)
    with system.open_input_file(inner) as f:
        raw = f.read(HEAD_BYTES)
    text, mark, _ = raw.partition(b"end_header\n")
    lines = [x.split() for x in text.decode("ascii", "replace").splitlines()]
    if not mark or lines[:1] != [["ply"]]:
        raise ValueError(f"{path} is no PLY file")
    kind, element, rows, columns = "", None, 0, []
    for x in lines:
        if x[:1] == ["format"]:
            kind = x[1]
        elif x[:1] == ["element"]:
            if element is None and x[1] != "vertex":
                raise ValueError(f"{path}: vertices must come first")
            element = x[1]
            rows = int(x[2]) if element == "vertex" else rows
        elif x[:1] == ["property"] and element == "vertex":
            columns.append((x[-1], PLY_TYPES[x[1]]))
    return Head(kind, rows, len(text) + len(mark), tuple(columns))


@dataclass
class Range(InputPartition):
    """Rows of one file."""

    path: str
    head: Head
    first: int
    rows: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int) -> None:
        self.path, self.schema, self.rows = path, schema, rows
        self.files: set[str] | None = None
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on file by equality and on pid and numbers by comparison."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "file" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            elif type(f) in TESTS and name in kinds and name != "file" and f.value == f.value:
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in clouds(self.path):
            if self.files is None or path in self.files:
                h = head(path)
                step = self.rows if h.kind != "ascii" else max(h.rows, 1)
                out += [Range(path, h, i, min(step, h.rows - i)) for i in range(0, h.rows, step) if self._may(i, min(step, h.rows - i))]
        return out

    def _may(self, first: int, rows: int) -> bool:
        """Whether a range's places can pass the filters on pid."""
        low, high = first, first + rows - 1
        return all({EqualTo: low <= v <= high, GreaterThan: high > v, GreaterThanOrEqual: high >= v, LessThan: low < v, LessThanOrEqual: low <= v}[k] for n, k, v in self.tests if n == "pid")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, inner = place(part.path)
        h, row = part.head, part.head.row
        with system.open_input_stream(inner) if h.kind == "ascii" else system.open_input_file(inner) as f:
            if h.kind == "ascii":
                lines = f.read()[h.start :].decode().splitlines()[: h.rows]
                table = np.empty(len(lines), row)
                for i, line in enumerate(lines):
                    table[i] = tuple(map(float, line.split()[: len(h.columns)]))
                yield from self._batches(part.path, 0, table)
                return
            f.seek(h.start + part.first * row.itemsize)
            for i in range(part.first, part.first + part.rows, 1 << 16):
                n = min(1 << 16, part.first + part.rows - i)
                yield from self._batches(part.path, i, np.frombuffer(f.read(n * row.itemsize), row, n))

    def _batches(self, path: str, first: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        pid = np.arange(first, first + len(table))
        keep = np.ones(len(table), bool)
        for name, kind, value in self.tests:
            keep &= TESTS[kind](pid if name == "pid" else table[name], value)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        arrays = []
        for f in self.schema.fields:
            if f.name == "file":
                arrays.append(pa.array([path] * len(at)))
            elif f.name == "pid":
                arrays.append(pa.array(pid[at]))
            elif f.name in (table.dtype.names or ()):
                own = table[f.name][at]
                arrays.append(pa.array(own.astype(own.dtype.newbyteorder("="))).cast(_arrow(f.dataType)))
            else:  # a column that another file has
                arrays.append(pa.nulls(len(at), _arrow(f.dataType)))
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema.fields])


def _arrow(kind: DataType) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind.simpleString()]


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written, by their names at the end."""

    files: dict[str, str] = field(default_factory=dict)


class PlyWriter(DataSourceArrowWriter):
    """Writes each file's rows, which a task gets one file after the other, to a folder of this write; a commit moves them to their names."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, types: dict[str, str]) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        kind = lambda f: PLY_TYPES[types[f.name]] if f.name in types else WRITTEN.get(f.dataType.simpleString())
        self.columns = [(f.name, kind(f)) for f in schema.fields if f.name != "file"]
        if unknown := [n for n, k in self.columns if k is None]:
            raise ValueError(f"give the number types of {unknown}")
        if "file" not in schema.names:
            raise ValueError("a column file must name the file of each row")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = place(f"{self.path}/_ply-{self.run}/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        row, done, now, out, rows = np.dtype([(n, "<" + t) for n, t in self.columns]), Written(), None, None, 0

        def closed() -> None:
            if out is not None:
                out.close()
                done.files[now] = self._headed(system, f"{folder}/{len(done.files)}", rows)

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("file")).to_numpy(zero_copy_only=False)
            table = np.empty(batch.num_rows, row)
            for n, _ in self.columns:
                table[n] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else []
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[a] != now:
                    closed()
                    if names[a] in done.files:
                        raise ValueError(f"rows of {names[a]} are not together")
                    now, rows = names[a], 0
                    out = system.open_output_stream(f"{folder}/{len(done.files)}.body")
                out.write(table[a:b].tobytes())
                rows += int(b - a)
        closed()
        return done

    def _headed(self, system: fs.FileSystem, path: str, rows: int) -> str:
        """The file with its header, which holds the number of rows, before its rows."""
        back = {v: k for k, v in PLY_TYPES.items() if not k[-1].isdigit()}
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {rows}", *(f"property {back[t]} {n}" for n, t in self.columns), "end_header", ""]
        with system.open_output_stream(f"{path}.ply") as out, system.open_input_stream(f"{path}.body") as body:
            out.write("\n".join(lines).encode())
            while some := body.read(1 << 20):
                out.write(some)
        system.delete_file(f"{path}.body")
        return f"{path}.ply"

    def commit(self, messages: list[Written]) -> None:
        system, folder = place(self.path)
        names = [n for m in messages if m for n in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file came to several tasks")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.path.endswith(".ply"):
                    system.delete_file(info.path)
        for m in messages:
            for name, at in m.files.items() if m else ():
                system.move(at, f"{folder}/{posixpath.basename(name)}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        system, folder = place(f"{self.path}/_ply-{self.run}")
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class Ply(DataSource):
    """Columns file, pid (the row's place in it) and the properties that the headers tell of."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        fields: dict[str, StructField] = {}
        for path in clouds(self.options["path"]):
            for n, t in head(path).columns:
                fields.setdefault(n, StructField(n, KINDS[t]))
        return StructType([StructField("file", StringType()), StructField("pid", LongType()), *fields.values()])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema, int(self.options.get("rows", RANGE_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        """Number types other than those of the columns are named in the option types, as in "red:uchar,green:uchar"."""
        types = dict(x.split(":") for x in self.options.get("types", "").split(",") if x)
        return PlyWriter(self.options["path"], schema, overwrite, types)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ply)


def write_clouds(df: DataFrame, folder: str, file: Column, *order: Column, mode: str = "append", types: dict[str, str] | None = None) -> None:
    """A PLY file in folder for each value of file, its rows in an order; a task writes a file from start to end, whatever its size."""
    register(df.sparkSession)
    rows = df.withColumn("file", file)
    dealt = rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", *order)
    dealt.write.format("ply").option("types", ",".join(f"{n}:{t}" for n, t in (types or {}).items())).mode(mode).save(folder)


def write_points(points: DataFrame, path: str, columns: dict[str, str]) -> None:
    """One PLY file of the rows in order of the first column given; columns maps names to number types."""
    folder, _, name = path.rpartition("/")
    own = points.select(*columns)
    write_clouds(own, folder or ".", F.lit(name), F.col(next(iter(columns))), types=columns)


def write_gaussians(gaussians: DataFrame, folder: str, file: Column, degree: int = 3) -> None:
    """A Gaussian PLY file for each value of file, in order of gid, with the columns that read_gaussians takes and normals of 0."""
    lists = (("f_dc", 3), ("f_rest", 3 * (degree + 1) ** 2 - 3), ("scale", 3), ("rot", 4))
    flat = [F.get(name, F.lit(i)).cast("float").alias(f"{name}_{i}") for name, n in lists for i in range(n)]
    normals = [F.lit(0.0).cast("float").alias(n) for n in ("nx", "ny", "nz")]
    harmonics, rest = flat[: 3 * (degree + 1) ** 2], flat[3 * (degree + 1) ** 2 :]
    rows = gaussians.select("gid", file.alias("file"), *[F.col(c).cast("float").alias(c) for c in "xyz"], *normals, *harmonics, F.col("opacity").cast("float").alias("opacity"), *rest, F.col("which_object").cast("float").alias("which_object"))
    register(gaussians.sparkSession)
    dealt = rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", "gid").drop("gid")
    dealt.write.format("ply").mode("append").save(folder)
