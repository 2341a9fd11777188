"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Every text gives a short vector of statistics. Random Fourier features, cosines of random projections,
approximate a Gaussian kernel over the standardised statistics. Each partition of the training rows sums its
part of the normal equations, a matrix whose size depends on the number of features only; the sums are added
up and solved once. The raw ridge score of rows that the fit did not see is binned by Spark, and pooling
adjacent violators over the bins makes the score a probability that never falls as the raw score grows. A
thousandth of a logistic of the raw score keeps the order of rows within a step.

Training uses a hash sample of about train_rows labels outside the held-out fold, taken by a threshold on the
hash of doc_id, so that no partition sends more than its part; one in four is for calibration. All rows are scored, over whole texts.

Defined results: a null text is the empty text, whose statistics are zeros, and is scored like any other;
repeated rows are scored alike; a document with several different labels counts once for each; without labelled rows
every score is 0.5; an empty table gives an empty result; other columns are ignored. Labels, language, source
and doc_id never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import crc_remainder, drawn_by, materialize, ship_package
from tallyspark.llm.quality_rules import STOP_WORDS

STOP = frozenset(w.encode() for ws in STOP_WORDS.values() for w in ws.split())
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>{}[]\\^~=_@"
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Bins of the raw score for calibration.
BINS = 400


def statistics(text: bytes) -> list[float]:
    """Of one text in UTF-8; ratios and logarithms, so that all are of moderate size."""
    words, size = text.split(), max(1, len(text))
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    count = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(len(words)),
        mean,
        math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean)),
        len(counts) / n,
        pairs / max(1, len(words) - 1),
        max(counts.values(), default=0) / n,
        sum(counts[w] for w in STOP if w in counts) / n,
        count(UPPER),
        count(DIGITS),
        count(SYMBOLS),
        count(b"!?"),
        count(b".,;:"),
        count(LETTERS),
        math.log1p(n_lines),
        math.log1p(len(words) / n_lines),
        len(set(lines)) / n_lines,
        text.count(b"|") / n,
    ]


N_STATISTICS = len(statistics(b""))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        waves = np.cos(z @ self.projection + self.phase) * math.sqrt(2.0 / len(self.phase))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, *self.steps) + 0.001 / (1 + np.exp(-4 * raw))


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.to_pylist()], np.float64).reshape(-1, N_STATISTICS)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to values: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def _summed(rows: DataFrame, width: int, part) -> np.ndarray:
    """The sum over partitions of part(statistics, labels), a vector of so many numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += part(np.array(b["stats"].to_pylist(), np.float64).reshape(-1, N_STATISTICS), b["label"].to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    # the sample has at most a fixed number of rows and is read in at most 16 partitions
    parts = rows.coalesce(16).mapInArrow(run, "total binary").collect()
    return np.sum([np.frombuffer(r["total"]) for r in parts], axis=0) if parts else np.zeros(width)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 16_000, waves: int = 256, gamma: float = 0.05, ridge: float = 1e-3) -> Classifier:
    """A classifier from docs (doc_id, text) and labels (doc_id, quality)."""
    ship_package(docs.sparkSession)
    labels = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    chosen = labels.filter(drawn_by(F.xxhash64(F.lit("quality"), "doc_id"), train_rows, labels.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["fold"], b["label"], pa.array(list(_statistics_of(b["text"])), pa.list_(pa.float64()))], ["fold", "label", "stats"])

    # the sample's bound makes this side small
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select((F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 4).cast("int").alias("fold"), "label", "text")
    rows = materialize(rows.mapInArrow(run, "fold int, label int, stats array<double>"), "quality-sample")
    fit, check = rows.filter("fold > 0"), rows.filter("fold = 0")
    k = N_STATISTICS
    sums = _summed(fit, 2 * k + 1, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = sums[0]
    rng = np.random.default_rng(0)
    mean = sums[1 : k + 1] / max(1, n)
    scale = np.sqrt(np.maximum(sums[k + 1 :] / max(1, n) - mean**2, 1e-9))
    model = Classifier(mean, scale, rng.normal(size=(k, waves)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, waves))
    if not n:
        return model
    width = 1 + k + waves

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = _summed(fit, width * width + width, equations)
    a, b = sums[: width * width].reshape(width, width), sums[width * width :]
    weights = np.linalg.solve(a + ridge * n * np.eye(width), b)
    model.weights = weights

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    sums = _summed(check, 2 * BINS, histogram)
    rows_in, good = sums[:BINS], sums[BINS:]
    if not rows_in.sum():
        rows_in, good = np.ones(BINS), np.clip(np.linspace(-0.5, 1.5, BINS), 0, 1)
    filled = rows_in > 0
    centres = ((np.arange(BINS) + 0.5) * 2 / BINS - 0.5)[filled]
    model.steps = (centres, np.clip(isotonic(good[filled] / rows_in[filled], rows_in[filled]), 0, 1))
    return model


def score_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(shared.value.score(_statistics_of(b["text"])))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_remainder(doc_id, 5) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; learns from labels outside the held-out fold only."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
