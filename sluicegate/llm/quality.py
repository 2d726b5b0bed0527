"""A quality classifier from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on: this many trusted positives and this many unlabelled ones, the first by hash.
POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 80, 512, 0.01, 1e-4, 7
#: Byte classes whose shares are features.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".,", b";:?", b"!", b"|",
    b"#$%&*", b"\"'`()[]{}", b"<>/\\=+-_~^@", bytes(range(128, 256)),
)
CLASS_OF = np.full(256, len(CLASSES), dtype=np.uint8)
for _i, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _i
FEATURES = len(CLASSES) + 1 + 14


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text and nothing else; a null text is empty."""
    raw = (text or "").encode()
    shares = np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1) / max(1, len(raw))
    words = raw.split()
    n = len(words)
    if not n:
        return np.concatenate([shares, np.zeros(14)])
    counts = Counter(words)
    lines = raw.split(b"\n")
    # Shares of words are measured on distinct ones with their counts: words repeat.
    upper = bare = marked = 0
    for word, k in counts.items():
        bare += k * (not word.isalnum() and not any(c >= 128 or chr(c).isalnum() for c in word))
        upper += k * (word.isupper() and len(word) > 1)
        marked += k * (word[-1] < 48 and word[-1] not in b".,'\")")
    top = counts.most_common(1)[0][1]
    return np.concatenate(
        [
            shares,
            [
                np.log1p(n) / 10,
                np.log1p(len(raw)) / 10,
                (len(raw) - n) / n / 10,
                len(counts) / n,
                np.log1p(len(counts)) / np.log1p(n),
                top / n,
                upper / n,
                bare / n,
                marked / n,
                sum(map(eq, words, words[1:])) / n,
                sum(map(eq, words, words[2:])) / n,
                len(set(lines)) / len(lines),
                np.log1p(n / len(lines)) / 5,
                max(map(len, words)) ** 0.5 / 10,
            ],
        ]
    )


@dataclass
class Model:
    """A network with one hidden layer over standardised features. Without parameters every score is 0.5."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()
    prior: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        return _sigmoid(_forward(self.weights, (x - self.mean) / self.scale)[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(weights: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = weights
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, ...]:
    """Adam on minibatches. With a prior: the non-negative PU risk; without: positives against unlabelled."""
    rng = np.random.default_rng(SEED)
    d = positive.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    steps = max(1, len(unlabelled) // BATCH)
    t = 0
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_rows, u_rows in zip(np.array_split(p_order, steps), np.array_split(u_order, steps), strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            x = np.concatenate([positive[p_rows], unlabelled[u_rows]])
            hidden, z = _forward(weights, x)
            s, p = _sigmoid(z), len(p_rows)
            # d/dz of the logistic losses of calling a row positive (s - 1) and negative (s), averaged per sample.
            as_positive, as_negative = (s - 1)[:p] / p, s / np.where(np.arange(len(x)) < p, p, len(u_rows))
            slope = np.zeros(len(x))
            if prior is None:
                slope[:p], slope[p:] = as_positive, as_negative[p:]
            else:
                loss = np.logaddexp(0, z)
                negative_risk = loss[p:].mean() - prior * loss[:p].mean()
                if negative_risk >= 0:
                    slope[:p], slope[p:] = prior * (as_positive - as_negative[:p]), as_negative[p:]
                else:  # the estimate went below zero: undo what overfits it
                    slope[:p], slope[p:] = prior * as_negative[:p], -as_negative[p:]
            back = np.outer(slope, weights[2]) * (1 - hidden**2)
            grads = [x.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ slope + DECAY * weights[2], slope.sum(keepdims=True)]
            t += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return tuple(weights)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """The share of positives among unlabelled rows, from scores of a model of positives against unlabelled.

    Unlabelled rows are a mixture, so for every set of rows their share in it is at least prior times the
    positives' share. The bound is tightest where negatives are absent: the least ratio over score
    thresholds above which ``least`` of the positives or more lie.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 1 - least, 50))
    ratios = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model from feature rows of trusted positives and of unlabelled documents."""
    if not len(positive) or not len(unlabelled):
        return Model()
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    # Each half is scored by a model of the other half: rows that a model has seen score too well.
    halves = [(p[i::2], u[i::2]) for i in (0, 1)]
    judged = []
    for (p0, u0), (p1, u1) in (halves, halves[::-1]):
        if len(p0) and len(u0):
            first = _fit(p0, u0, None)
            judged.append((_forward(first, p1)[1], _forward(first, u1)[1]))
    prior = float(np.mean([estimate_prior(*j) for j in judged if len(j[0]) and len(j[1])] or [0.5]))
    return Model(mean, scale, _fit(p, u, prior), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on ``positives`` rows labelled quality 1 and ``unlabelled`` rows of any kind, none of them held out.

    The first rows by hash of their doc_id are taken, so the sample is bounded and stable. Labels of 0, null
    and rows without a doc_id are not learnt from. Without a positive or without documents the model is
    undecided.
    """

    def first(ids: DataFrame, n: int, side: str) -> DataFrame:
        known = ids.where(F.col("key").isNotNull() & ~held_out(F.col("key"))).distinct()
        return known.orderBy(F.xxhash64("key"), "key").limit(n).withColumn("side", F.lit(side))

    body = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("key"))
    # At most positives + unlabelled ids: a bounded broadcast.
    wanted = first(good, positives, "p").union(first(body.select("key"), unlabelled, "u"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).astype("<f8").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("side"), pa.array(found, pa.binary())], ["side", "x"])

    # One row of each sampled doc_id, the first by hash of its text, however many repeat it.
    first_text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    sampled = body.join(F.broadcast(wanted), "key").groupBy("side", "key").agg(first_text)
    rows = sampled.select("side", "one.text").mapInArrow(measure, "side string, x binary").collect()
    sides = {s: [np.frombuffer(r["x"], "<f8") for r in rows if r["side"] == s] for s in "pu"}
    arrays = {s: np.array(x).reshape(-1, FEATURES) for s, x in sides.items()}
    # Rows arrive in any order; the fit must not depend on it.
    p, u = (a[np.lexsort(a.T)] for a in (arrays["p"], arrays["u"]))
    return fit(p, u)


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the probability of good quality by the whole text."""

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array([features(t) for t in part]).reshape(-1, FEATURES)
            yield pd.Series(model.score(x))

    scored = F.pandas_udf(judge, "double")
    return docs.withColumn(name, scored(F.col(text).cast("string")))


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts are empty, repeated rows score alike."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    judged = with_scores(slim, train(docs, labels, doc_id, text))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, all columns kept."""
    judged = with_scores(docs, train(docs, labels, doc_id, text), text, "llm_quality_score")
    return judged.where(F.col("llm_quality_score") >= 0.5).select(*[docs[c] for c in docs.columns])
