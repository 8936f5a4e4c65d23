"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all ordered thresholds. x has
1 + log(count) of chosen words and word beginnings. Features are chosen by their association
with toxic rows of a bounded, labelled sample; documents are scored over their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words
from .common import cut, first_by_hash, text_slices

#: Most labelled rows to learn from, and most features.
SAMPLE, FEATURES = 20_000, 4000
#: Bytes of a word's beginning that are a feature too.
BEGINNING = 7
GRADES = 4
#: Least squared deviation, and least documents, of a chosen feature.
LEAST_CHI2, LEAST_DOCS = 12.0, 3
REJECT = 0.5


def counted_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and each longer word's beginning."""
    starts, ends, at = words.split(data, offsets, words.ALNUM)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    long = ends - starts > BEGINNING
    begin = words.word_hashes(data, starts[long], starts[long] + BEGINNING) ^ np.uint64(0x5BD1E995)
    return np.concatenate((rows, rows[long])), np.concatenate((words.word_hashes(data, starts, ends), begin))


class Features:
    """Chosen feature hashes, found in arrays of hashes by a table over their low bits."""

    def __init__(self, hashes: list[int]) -> None:
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.hashes & np.uint64(len(self.bits) - 1)] = True

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count) of the chosen features of each text."""
        rows, hashes = counted_features(data, offsets)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[hashes & np.uint64(len(self.bits) - 1)])
        place = np.searchsorted(self.hashes, hashes[maybe]).clip(max=len(self.hashes) - 1)
        good = self.hashes[place] == hashes[maybe]
        key, count = np.unique(rows[maybe[good]] * len(self.hashes) + place[good], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), count


class Ordinal:
    """Proportional odds: shared weights, ordered thresholds."""

    def __init__(self, n_features: int, grades: int = GRADES) -> None:
        self.weights, self.thresholds = np.zeros(n_features), np.linspace(2.0, 4.0, grades - 1)

    def fit(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, ridge: float = 0.02, rounds: int = 600, rate: float = 0.05) -> Ordinal:
        """Full-batch Adam on the penalised likelihood; thresholds stay ordered as sums of exponentials."""
        n, k = len(grades), len(self.thresholds)
        at = np.concatenate((self.thresholds[:1], np.log(np.diff(self.thresholds))))
        theta = np.concatenate((self.weights, at))
        m = v = np.zeros(len(theta))
        for t in range(1, rounds + 1):
            w, at = theta[:-k], theta[-k:]
            steps = np.exp(at[1:])
            cuts = np.concatenate(([-np.inf], at[0] + np.concatenate(([0.0], np.cumsum(steps))), [np.inf]))
            z = np.bincount(rows, values * w[cols], n)
            low, high = (1 / (1 + np.exp(-np.clip(cuts[grades + i] - z, -40, 40))) for i in (0, 1))
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            dz = d_high - d_low  # of the negative log-likelihood, as cuts - z falls with z
            d_cuts = np.bincount(grades, -d_high, k + 1)[:k] + np.bincount(grades, d_low, k + 1)[1:]
            g_at = np.concatenate(([d_cuts.sum()], [d_cuts[i:].sum() * steps[i - 1] for i in range(1, k)]))
            g = np.concatenate((np.bincount(cols, values * dz[rows], len(w)) + ridge * w, g_at)) / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        self.weights, at = theta[:-k], theta[-k:]
        self.thresholds = at[0] + np.concatenate(([0.0], np.cumsum(np.exp(at[1:]))))
        return self

    def chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade) for each score z, one column a grade."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None] - z[:, None], -40, 40)))
        return np.diff(np.concatenate((np.zeros((len(z), 1)), upto, np.ones((len(z), 1))), 1), axis=1)


class Model:
    def __init__(self, features: Features, ordinal: Ordinal | None) -> None:
        self.features, self.ordinal = features, ordinal

    def grade(self, column: pa.Array) -> np.ndarray:
        """P(grade) for each text of a column of lower-cased texts."""
        if self.ordinal is None:
            return np.tile([1.0] + [0.0] * (GRADES - 1), (len(column), 1))
        parts = [np.zeros((0, GRADES))]
        for first, end, data, offsets in text_slices(column):
            rows, cols, count = self.features.of(data, offsets)
            parts.append(self.ordinal.chances(np.bincount(rows, (1 + np.log(count)) * self.ordinal.weights[cols], end - first)))
        return np.concatenate(parts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic, and grade or null).

    At most sample labels are used, about the first by hash of doc_id, and of rows equal in
    doc_id one text, so that what is broadcast and collected has a bound. Where a toxic row has no grade, its grade is 1 to 3 by how many
    toxic features it holds against the other toxic rows.
    """
    chosen = first_by_hash(labels.filter("toxic is not null and doc_id is not null"), sample, "doc_id", "toxic")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    rows = cut(own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("grade").cast("int").alias("grade")).agg(one.alias("text")).select("doc_id", "text", "toxic", "grade"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            seen = [np.zeros((0, 2), np.uint64)]
            for first, _, data, offsets in text_slices(batch.column(0)):
                r, h = counted_features(data, offsets)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))[: len(r)]
                seen.append(np.stack((h[new], toxic[first + r[new]].astype(np.uint64)), 1))
            seen = np.concatenate(seen)
            h, place = np.unique(seen[:, 0], return_inverse=True)
            n, t = np.bincount(place, minlength=len(h)), np.bincount(place, seen[:, 1].astype(float), len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(t.astype(np.int64))], names=["h", "n", "t"])

    totals = rows.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not 0 < t < n:
        return Model(Features([]), None)
    seen = rows.select("text", "toxic").mapInArrow(tally, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    mean = F.col("n") * (t / n)
    chi2 = (F.col("t") - mean) * (F.col("t") - mean) / (mean * (1 - t / n))
    best = seen.filter(f"n >= {LEAST_DOCS}").withColumn("chi2", chi2).filter(f"chi2 >= {LEAST_CHI2} and t > n * {t / n}").orderBy(F.desc("chi2"), "h").limit(FEATURES).collect()
    features = Features([r["h"] for r in best])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(batch.num_rows)]
            counts: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in text_slices(batch.column(1)):
                for r, c, k in zip(*(x.tolist() for x in features.of(data, offsets)), strict=True):
                    cols[first + r].append(c)
                    counts[first + r].append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "toxic", "grade", "cols", "counts"])

    got = rows.mapInArrow(matrix, "doc_id long, toxic int, grade int, cols array<int>, counts array<int>").orderBy("doc_id", "toxic").collect()
    lengths = [len(r["cols"]) for r in got]
    at = np.repeat(np.arange(len(got)), lengths)
    cols = np.array([c for r in got for c in r["cols"]], np.int64)
    counts = np.array([c for r in got for c in r["counts"]], float)
    toxic = np.array([r["toxic"] for r in got])
    offences = np.bincount(at, counts, len(got))
    marks = np.quantile(offences[toxic == 1], [1 / 3, 2 / 3])
    derived = np.where(toxic == 1, 1 + (offences[:, None] > marks[None]).sum(1), 0)
    grades = np.array([d if r["grade"] is None else min(max(r["grade"], 0), GRADES - 1) for r, d in zip(got, derived, strict=True)])
    return Model(features, Ordinal(len(features.hashes)).fit(at, cols, 1 + np.log(counts), grades))


def _labels(labels: DataFrame) -> DataFrame:
    grade = F.col("grade") if "grade" in labels.columns else F.lit(None)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), grade.cast("int").alias("grade"))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, rejected) for each row of docs.

    docs needs doc_id and text, labels doc_id, toxic and perhaps grade (0 to 3); other columns
    are ignored. A null or empty text has no features and the grade chances of such. With no
    toxic or no other label, everything is graded 0. Repeated rows give repeated rows; an empty
    table gives an empty result. Labels without a grade have two values only: then the upper
    grades say how many toxic features a toxic row holds, and nothing that the labels do not.
    """
    model = fit(docs, _labels(labels), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.grade(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(GRADES), pa.float64()), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] >= REJECT)], names=["doc_id", "expected_severity", "grade", "p_toxic", "rejected"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, rejected boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not rejected, all columns unchanged, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are as in report().
    """
    model = fit(docs, _labels(labels), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.grade(batch.column(1))
            yield batch.select([0]).filter(pa.array(1 - p[:, 0] < REJECT))

    rows = docs.select(F.struct("*").alias("row"), F.lower("text").alias("lower"))
    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select(*[F.col("row")[c].alias(c) for c in docs.columns])
