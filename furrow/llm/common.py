"""Shared helpers: tables, checkpoints and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir

__all__ = ["cut", "deleted", "first_by_hash", "narrowed", "numbered", "parted", "shared_dir", "table", "text_slices"]

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is read no more, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in an order, from 1, in a column called name.

    Partitions by range are sorted on their own and counted; only one count a partition meets
    on the driver.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("least")).orderBy("__part").collect()
    before = [0, *accumulate(c["n"] for c in counts)]
    starts = [(c["__part"], b - c["least"] + 1) for c, b in zip(counts, before, strict=False)]
    first = rows.sparkSession.createDataFrame(starts, "__part int, __first long")
    return dealt.join(F.broadcast(first), "__part").withColumn(name, F.col("__at") + F.col("__first")).drop("__part", "__at", "__first")


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into bytes) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: Slots of the table that narrowed() broadcasts, a row of eight bytes for each.
SLOTS = 1 << 20


def parted(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among those wanted, the others): the first has all that are, and a few that are not.

    Keys, which are hashes, fall into SLOTS slots and the slots in use are broadcast: at most
    SLOTS rows whatever is wanted. It spares the join after it the shuffle of other rows; the
    more is wanted of a larger table the less it spares.
    """
    slots = F.broadcast(wanted.select(F.pmod(F.col(key), F.lit(SLOTS)).alias("__slot")).distinct())
    placed = rows.withColumn("__slot", F.pmod(F.col(key), F.lit(SLOTS)))
    return placed.join(slots, "__slot", "left_semi").drop("__slot"), placed.join(slots, "__slot", "left_anti").drop("__slot")


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among those wanted, as the first of parted()."""
    return parted(rows, wanted, key)[0]


def first_by_hash(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About the first rows by hash of their keys, most at most, for fitting on a bounded sample.

    Of a larger table only so many rows pass a bound on the hash that a little over most are
    left, so that what is sorted and sent has a bound however many partitions there are.
    """
    n, slots = rows.count(), 1 << 30
    if n > 2 * most:
        share = int(slots * (1.25 * most + 50) / n)
        rows = rows.filter(F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(slots)) < share)
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(most)
