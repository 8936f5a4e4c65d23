"""Streams of frames: stride, the latest of each source, additive state, windows, resumption."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def strided(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter(F.pmod(F.col("frame"), F.lit(stride)) == 0)


def latest(frames: DataFrame) -> DataFrame:
    """The newest frame of each source so far; late ones change nothing (update mode)."""
    return frames.groupBy("source").agg(F.max(F.struct("frame", "value")).alias("last")).select("source", "last.frame", "last.value")


def accumulated(contributions: DataFrame) -> DataFrame:
    """Contributions of each object and Gaussian summed as they arrive (update mode)."""
    return contributions.groupBy("obj", "gid").agg(F.sum("w").alias("w"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window, rows later than the watermark left out; ts is cast to a timestamp."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


class TwoStrikes(StatefulProcessor):
    """Misses of each mask: done at a match or the second miss. A state that is not met again in time is forgotten."""

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.misses = handle.getValueState("misses", "n int", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        misses = self.misses.get()[0] if self.misses.exists() else 0
        for batch in rows:
            misses = 2 if batch["matched"].any() else min(2, misses + len(batch))
        self.misses.update((misses,))
        yield pd.DataFrame({"mask": [key[0]], "status": ["processed" if misses == 2 else "buffered"]})

    def close(self) -> None:
        pass


def second_strike(masks: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Of masks (mask, matched) that arrive more than once: buffered at the first miss, processed at a match or second miss.

    Neither order nor batches matter, so that late and repeated input gives what strikes() gives for
    all of it. With forget_ms, a mask that has not come again for so long starts anew.
    """
    masks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if forget_ms else "None"
    return masks.groupBy("mask").transformWithStateInPandas(TwoStrikes(forget_ms), "mask long, status string", "Update", mode)


def strikes(masks: DataFrame) -> DataFrame:
    """(mask, status) of masks (mask, matched) that have all arrived."""
    return masks.groupBy("mask").agg(F.when(F.max("matched") | (F.count(F.lit(1)) > 1), "processed").otherwise("buffered").alias("status"))


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that have no output yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")
