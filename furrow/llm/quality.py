"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

Each document becomes a vector of statistics of its whole text. Cosines of random projections
of it approximate a Gaussian kernel; the normal equations of a ridge regression on them are
summed by partition and then by Spark; a step of isotonic regression on rows that the ridge
has not seen turns raw scores into rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, text_slices

#: Random features, and partitions whose normal equations are summed.
FEATURES, PARTS = 384, 16
SEED = 11
RIDGE = 1e-3
THRESHOLD = 0.3
#: Characters counted one by one.
MARKS = "#$%&*|!?@.,:;=\"'()<>/\\_-+"
STATS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "beyond_ascii", "blank", "lines", "line_words", "different_words", "top_word", "different_lines",
    "upper_words", "marked_words", "long_words", "ends_sentence", *(f"mark_{ord(c)}" for c in MARKS),
]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the number of different hashes and the count of the most frequent."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    counts = np.diff(np.concatenate((new, [len(h)])))
    most = np.zeros(n)
    np.maximum.at(most, r[new], counts)
    return np.bincount(r[new], minlength=n).astype(float), most


UPPER, DIGIT, MARK, BEYOND = (np.zeros(256, bool) for _ in range(4))
UPPER[0x41:0x5B] = DIGIT[0x30:0x3A] = BEYOND[0x80:] = True
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
NOT_BREAK = np.ones(256, bool)
NOT_BREAK[0x0A] = False


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, at = words.split(data, offsets, words.NOT_BLANK)
    count = np.diff(at).astype(float)
    rows = np.repeat(np.arange(n), np.diff(at))
    hashes = words.word_hashes(data, starts, ends)
    different, top = _repeats(hashes, rows, n)
    line_starts, line_ends, line_at = words.split(data, offsets, NOT_BREAK)
    line_words = np.searchsorted(starts, np.stack((line_starts, line_ends)))
    line_rows = np.repeat(np.arange(n), np.diff(line_at))
    lines = np.diff(line_at).astype(float)
    different_lines, _ = _repeats(words.span_hashes(hashes, line_words[0], line_words[1]), line_rows, n)
    per_byte, per_word, per_line = (1 / np.maximum(x, 1) for x in (size, count, lines))
    upper, mark = UPPER[data], MARK[data]

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows, flags, n) * per_word

    uppers = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    marks = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
    length = ends - starts
    only_upper = uppers[ends] - uppers[starts] + marks[ends] - marks[starts] >= length
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    found = np.bincount(data, minlength=256) > 0
    out = [
        np.log1p(size), np.log1p(count), np.bincount(rows, length, n) * per_word, _per_row(upper, offsets) * per_byte, _per_row(DIGIT[data], offsets) * per_byte, _per_row(mark, offsets) * per_byte,
        _per_row(BEYOND[data], offsets) * per_byte, (size - np.bincount(rows, length, n)) * per_byte, lines * per_word, np.log1p(count * per_line), different * per_word, top * per_word, different_lines * per_line,
        by_word(only_upper), by_word(marks[ends] - marks[starts] > 1), by_word(length > 12), by_word(last == 0x2E),
    ]
    out += [np.sqrt(_per_row(data == ord(c), offsets) * per_byte) if found[ord(c)] else np.zeros(n) for c in MARKS]
    return np.stack(out, 1)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column(1))]
            flat = np.concatenate(parts).astype(np.float32).ravel() if parts else np.zeros(0, np.float32)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATS)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Model:
    """A fitted model; raw scores come from transform, rates from score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED) -> None:
        draws = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.directions = draws.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.shifts = draws.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + len(mean) + 1)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.cos(x @ self.directions + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate((cosines, x / len(self.mean), np.ones((len(x), 1))), 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of values by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """A model from (doc_id, stats) and (doc_id, y), y being 0 or 1; fold 1 of 5 only calibrates.

    Nothing that reaches the driver grows with the rows: moments, one matrix and a histogram.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    rows = cut(stats.join(labels, "doc_id").select("stats", F.col("y").cast("double").alias("y"), fold.alias("fold")).repartition(PARTS))
    moments = rows.filter("fold != 1").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), features)
    model = Model(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]), features)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate((model.expand(_matrix(batch.column(0))), batch.column(1).to_numpy()[:, None]), 1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def added(group: pa.Table) -> pa.Table:
        total = np.sort(_matrix(group["row"].combine_chunks()), 0).sum(0)
        return pa.table({"i": group["i"][:1], "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "i int, row array<double>"
    got = rows.filter("fold != 1").select("stats", "y").mapInArrow(equations, schema).groupBy("i").applyInArrow(added, schema).collect()
    z = np.array([r["row"] for r in sorted(got, key=lambda r: r["i"])])
    n = z[-2, -2]
    model.weights = np.linalg.solve(z[:-1, :-1] + ridge * max(n, 1.0) / features * np.eye(len(z) - 1), z[:-1, -1])

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint(model.raw(_matrix(batch.column(0))) * 500), -1000, 2000).astype(np.int32)), batch.column(1)], names=["bin", "y"])

    bins = rows.filter("fold = 1").select("stats", "y").mapInArrow(raws, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("y").alias("n")).orderBy("bin").collect()
    if bins:
        at, rate, weight = (np.array([float(r[c]) for r in bins]) for c in ("bin", "y", "n"))
        model.steps = at / 500, isotonic(rate, weight)
    return model


def scored(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """(doc_id, held_out, score) for each row of docs, learnt from labels outside the held-out fold.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. A null text
    is empty and scored as such. Rows without an id are held out of nothing and are scored. Null
    labels are ignored, repeated ones all count; with none at all every score is 0.5.
    """
    stats = cut(described(docs))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).filter(F.col("y").isNotNull() & (remainder != 0))
    model = fit(stats, own, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score")
