"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A document's vector is the mean embedding of the hashed character n-grams of its words (orders 1 to 4, word borders
marked) and the classes are scored by a linear layer on it. As that layer is linear, the trained model is folded into
one table of class logits for each bucket, and prediction over whole texts is a gather and a sum.

Besides the languages there is one class for what is none of them, learned from training texts whose letters are
shuffled: they keep a language's letters and word lengths but no n-gram of its own, as texts in a language that wasn't
learned do. A temperature fitted on held-back rows calibrates the scores, and the rejection floor lies between the
lowest of the held-back clean rows and the scores of the held-back shuffled ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64
from .session import bounded_batches, discard, materialize

BUCKETS, DIM, ORDERS = 1 << 14, 16, (1, 2, 3, 4)
#: Training rows of each language, those of least hash: PER_LANGUAGE, or fewer (LEAST at the fewest) where there are so many
#: languages that the sample would exceed SAMPLE rows. A documented bound on the sample; every language is learned.
PER_LANGUAGE, SAMPLE, LEAST = 400, 8_000, 20
EPOCHS = 6
#: A text's mean is taken as if it had so many n-grams more that say nothing, so that a few words decide less than many.
SHRINK = 64
#: Languages up to which the table of their sizes is broadcast.
FEW_LANGUAGES = 100_000
#: Share of held-back shuffled rows that the floor has to lie above, if the held-back clean rows allow it.
REJECTED = 0.99
#: The floor lies at this score at most: what one language has more than all others together stays.
FLOOR = 0.5
#: Code points featurised at once.
SEGMENT = 1 << 17
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, in pieces that end between words."""
    letter = _letters()
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and text[end - 1].isalpha() and end - at < 4 * SEGMENT:
            end += 1
        piece = text[at:end].lower()
        at = end
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c = np.concatenate([[0], np.where(letter[c], c, 0), [0]]).astype(np.uint64)
        inside = c > 0
        h = np.zeros(len(c), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(max(ORDERS)):
                m = len(c) - k
                h = h[:m] * np.uint64(0x100000001B3) + c[k:] + np.uint64(1)
                if k + 1 not in ORDERS:
                    continue
                # borders may stand at the ends only, with a letter at least between or beside them
                ok = inside[:m] if k == 0 else inside[:m] | inside[k:]
                for j in range(1, k):
                    ok = ok & inside[j : j + m]
                yield (mix64(h[ok] + np.uint64(k << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for b in buckets(text):
        total += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def shuffled(text: str, seed: int) -> str:
    """``text`` with its letters in random order, each where a letter stood."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.flatnonzero(_letters()[codes])
    codes[at] = codes[np.random.default_rng(seed).permutation(at)]
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class LanguageModel:
    languages: list[str]
    #: BUCKETS x (languages + 1), logits of a bucket (temperature applied); the last column is none of the languages.
    table: np.ndarray
    bias: np.ndarray
    floor: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0
        z = (n @ self.table[at].astype(np.float64)) / (n.sum() + SHRINK) + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p[:-1].argmax())
        return self.languages[k], float(p[k])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, pick, text) -> (lang, pick, other, at, n): bucket counts of each text and, as ``other``, of every second one shuffled."""
    for batch in batches:
        rows = []
        for lang, pick, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((lang, pick, False, *counts(text)))
            if pick % 2:
                rows.append((lang, pick, True, *counts(shuffled(text, pick % (1 << 32)))))
        cols = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())]
        arrays += [pa.array([x.astype(t).tobytes() for x in c], pa.binary()) for c, t in zip(cols[3:], (np.uint16, np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "pick", "other", "at", "n"])


def fit(x_at: list[np.ndarray], x_n: list[np.ndarray], y: np.ndarray, languages: list[str], seed: int = 7, epochs: int = EPOCHS) -> LanguageModel:
    """SGD on mean embeddings; y is a language's number or, for none, their count.

    Every fifth row of a class is held back for the temperature and the floor.
    """
    r = np.random.default_rng(seed)
    k = len(languages)
    seen = np.zeros(k + 1, int)
    hold = np.zeros(len(y), bool)
    for i, c in enumerate(y):
        hold[i] = seen[c] % 5 == 4
        seen[c] += 1
    if not k:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 0.0)
    emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = r.normal(0, 0.1, (DIM, k + 1)).astype(np.float32), np.zeros(k + 1, np.float32)
    share = [(n / (n.sum() + SHRINK)).astype(np.float32) for n in x_n]
    train = np.flatnonzero(~hold)
    for epoch in range(epochs):
        rate = np.float32(1 - epoch / epochs)
        for i in r.permutation(train):
            e = emb[x_at[i]]
            v = share[i] @ e
            z = v @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(v, p)
            b -= np.float32(0.1) * rate * p
            # a bucket's mean share is small, so its own step is scaled up
            emb[x_at[i]] = e - np.outer(share[i] * (rate * np.float32(20.0)), back)
    table = emb @ w
    z = np.array([share[i] @ table[x_at[i]] + b for i in np.flatnonzero(hold)], float).reshape(-1, k + 1)
    t = y[hold]

    def law(s: float) -> np.ndarray:
        q = np.exp(s * z - (s * z).max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)

    def loss(s: float) -> float:
        return float(-np.log(law(s)[np.arange(len(t)), t] + 1e-12).mean())

    scale = min((0.25 * 1.25**j for j in range(14)), key=loss) if len(t) else 1.0
    top = law(scale)[:, :-1].max(axis=1)
    clean, other = top[t < k], top[t == k]
    low = float(np.quantile(other, REJECTED)) if len(other) else 0.0
    high = float(clean.min()) if len(clean) else 0.0
    odds = [np.log(max(x, 1e-9) / max(1 - x, 1e-9)) for x in (low, high)]
    floor = 1 / (1 + np.exp(-sum(odds) / 2)) if low < high else high
    return LanguageModel(languages, (table * scale).astype(np.float32), b.astype(float) * scale, min(float(floor), FLOOR))


def train(docs: DataFrame, where: Column | None = None) -> LanguageModel:
    """Learn from (text, lang) rows of ``docs``; a sample of each language reaches the driver, as bucket counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.octet_length("text")).alias("pick"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null and lang is not null")
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages", n=F.count(F.lit(1)))
    found = sizes.measured["n"]
    per = max(LEAST, min(PER_LANGUAGE, SAMPLE // max(found, 1)))
    hint = F.broadcast if found <= FEW_LANGUAGES else (lambda t: t)
    # the hash as a number from 0 to 1: a share of each language that holds ``per`` rows on average, whatever its size
    unit = F.col("pick") / F.lit(2.0**64) + 0.5
    sample = rows.join(hint(sizes), "lang").where(unit < per / F.col("size")).select("lang", "pick", "text")
    got = sample.mapInArrow(_features, "lang string, pick long, other boolean, at binary, n binary").toArrow()
    discard(sizes)
    order = sorted((p, lang, o, i) for i, (lang, p, o) in enumerate(zip(*(got.column(c).to_pylist() for c in ("lang", "pick", "other")))))
    at, n = got.column("at"), got.column("n")
    data = [(lang, o, np.frombuffer(at[i].as_py(), np.uint16), np.frombuffer(n[i].as_py(), np.int32)) for _, lang, o, i in order]
    data = [d for d in data if len(d[2])]
    languages = sorted({lang for lang, o, _, _ in data if not o})
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([len(languages) if o else number[lang] for lang, o, _, _ in data], int)
    return fit([d[2] for d in data], [d[3] for d in data], y, languages)


def _predictor(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            cols.append(pa.array([g[0] == "und" or g[1] < model.floor for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def held_out() -> Column:
    return F.expr("crc32(cast(doc_id as string)) % 3 = 1")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, from its whole text alone.

    ``und`` with score 0 for null, empty and letterless texts, which are rejected like scores below the floor. Rows of
    equal texts get equal results; a null doc_id is passed on and isn't held out; further columns are ignored; an empty
    table gives an empty result. Without training rows every text is ``und``.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is recognised; learns from the rows that are not held out."""
    model = train(docs, ~F.coalesce(held_out(), F.lit(False)))
    languages, floor = model.languages, model.floor

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([g[0] in languages and g[1] >= floor for g in got], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(accepted, docs.schema)
