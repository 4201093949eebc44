"""Quality scores by Bradley-Terry pairwise ranking.

Document features (shares of character classes, word and line shape, repetition) are expanded by hinges at sample
quantiles. From labelled rows, preference pairs (a document labelled 1 over one labelled 0) are drawn and the weights
learned by logistic loss on the pairs' feature differences. The decision threshold is a quantile of the sample's
scores; the reported score is a logistic curve through it, so that the quantile lies at ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, string_buffer, word_hashes
from .session import bounded_batches

THRESHOLD = 0.3
#: Labelled rows learned from at most, those of least hash: a documented bound on the sample.
SAMPLE = 12_000
PAIRS, EPOCHS = 60_000, 4
HINGES = (0.05, 0.25, 0.5, 0.75, 0.95)
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", " \t", ".,;:", "!?", "'\"()-", "*$%#&|<>{}[]=_^~\\/@+"]
NAMES = ["upper", "lower", "digit", "newline", "blank", "stop", "mark", "quote", "symbol", "beyond", "words", "word_length", "distinct", "distinct_pairs", "line_words", "upper_of_letters", "marks_per_word", "symbols_per_word"]


def features(col: pa.Array) -> np.ndarray:
    """len(col) x len(NAMES) features of whole texts; all zero for empty or null ones."""
    data, offs = string_buffer(col)
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    kind = np.full(256, len(_CLASSES), np.uint8)
    for k, chars in enumerate(_CLASSES):
        kind[np.frombuffer(chars.encode(), np.uint8)] = k
    count = np.zeros((n, len(_CLASSES) + 1))
    for i in range(n):
        for at in range(offs[i], offs[i + 1], 1 << 22):
            count[i] += np.bincount(kind[data[at : min(at + (1 << 22), offs[i + 1])]], minlength=count.shape[1])
    h, first = word_hashes(data, offs)
    words = np.diff(first).astype(float)
    distinct, pairs = np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        two = mix64(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) if len(h) > 1 else h[:0]
    for i in range(n):
        if words[i]:
            distinct[i] = len(np.unique(h[first[i] : first[i + 1]])) / words[i]
            pairs[i] = len(np.unique(two[first[i] : first[i + 1] - 1])) / (words[i] - 1) if words[i] > 1 else 1.0
    some, w = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    more = [np.log1p(words), (size - count[:, 3] - count[:, 4]) / w, distinct, pairs, np.log1p(words / (count[:, 3] + 1)), count[:, 0] / letters, count[:, 6] / w, count[:, 8] / w]
    return np.column_stack([count / some, *more])


@dataclass
class QualityModel:
    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    middle: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        parts = [x, *[np.maximum(x - k, 0) for k in self.knots]]
        return np.clip((np.hstack(parts) - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.expand(x) @ self.weights - self.middle) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> QualityModel:
    r = np.random.default_rng(seed)
    d = x.shape[1] * (1 + len(HINGES))
    if len(y) == 0 or y.min() == y.max():  # nothing to prefer: every score says 1 (or 0, if only 0 was seen)
        flat = QualityModel(np.zeros((len(HINGES), x.shape[1])), np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
        flat.middle = 1.0 if len(y) and y.max() == 0 else 0.0
        return flat
    m = QualityModel(np.quantile(x, HINGES, axis=0), np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    raw = m.expand(x) * 0 + np.hstack([x, *[np.maximum(x - k, 0) for k in m.knots]])
    m.mean, m.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    z = m.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = r.choice(good, PAIRS), r.choice(bad, PAIRS)
    w, step = np.zeros(d), np.full(d, 1e-8)
    for _ in range(EPOCHS):
        for at in range(0, PAIRS, 256):
            diff = z[a[at : at + 256]] - z[b[at : at + 256]]
            g = -(diff / (1 + np.exp(np.clip(diff @ w, -30, 30)))[:, None]).mean(axis=0) + 1e-3 * w
            step += g * g
            w -= 0.1 * g / np.sqrt(step)
    m.weights = w
    s = z @ w
    share = len(bad) / len(y)
    # of the quantiles around the share of zeros, the one that classifies the sample best
    cuts = np.quantile(s, np.clip(share * np.linspace(0.2, 1.8, 81), 0, 1))
    right = [((s >= c) == (y == 1)).mean() for c in cuts]
    m.middle = float(np.median(cuts[np.isclose(right, max(right))]))
    spread = float(np.std(s)) or 1.0
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    loss = [np.log1p(np.exp(-np.clip(np.where(y == 1, 1, -1) * (k / spread * (s - m.middle) + base), -30, 30))).mean() for k in (0.5, 1, 2, 4, 8, 16)]
    m.slope = float((0.5, 1, 2, 4, 8, 16)[int(np.argmin(loss))] / spread)
    return m


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(2))
        cols = [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, ["pick", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from labelled rows that are not held out; about SAMPLE of them reach the driver, as features.

    Repeated labels count once, contradicting ones both; labels of null or unknown ids and other values are left out.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.where(~held_out()).where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = marks.count()
    marks = marks.distinct().withColumn("pick", F.xxhash64("doc_id"))
    # the hash as a number from 0 to 1: a share that holds SAMPLE rows on average, whatever the number of labels
    marks = marks.where(F.col("pick") / F.lit(2.0**64) + 0.5 < min(1.0, SAMPLE / max(n, 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # about SAMPLE rows
    got = rows.select("pick", "quality", "text").mapInArrow(_sample, "pick long, quality int, x array<double>").collect()
    got.sort(key=lambda r: (r["pick"], r["quality"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["quality"] for r in got], int))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts score as a text without words. Equal texts score equally; a null doc_id is passed on and isn't
    held out; further columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(1)))
            cols = [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
