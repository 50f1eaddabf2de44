"""Quality rules: counts of a text, and a calibrated logistic regression over hashed word and character n-grams.

The counts are exact (``base``). The regression sees four families of hashed features - words, word pairs, and byte
windows of 3 and 5 - each as shares of its family, so the logit is a sum of mean weights. It is fitted by AdaGrad on a
bounded labelled sample (``SAMPLE_ROWS``), its probability calibrated by Platt scaling on a fold it was not fitted
on, and whole texts are scored in Arrow batches against fixed thresholds.

Null and empty texts have zero counts and fail the base rules (fewer than MIN_WORDS words). Without labelled rows of both
classes the regression is flat at probability 1 and only the base rules reject. Repeated rows are judged equally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T

BITS = 18
WINDOW = 8            # words of a window that counts as repeated
MIN_WORDS = 20
MAX_REPEATED = 30     # percent of words in repeated windows
SAMPLE_ROWS = 2048    # labelled rows that the fit sees at most
THRESHOLD = 0.5       # calibrated probability of good quality below which the method rejects
BYTE_WINDOWS = (3, 5)
SCALE = 8.0
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def base(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(offsets) - 1
    start, end, h, first = T.words(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(first))
    points = T.code_points(data)
    out = {"n_words": np.diff(first), "word_chars": T.text_sums(points[end] - points[start], owner, n).astype(np.int64)}
    marks = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]
    # lines with a word, equal to an earlier one of their text: all but the first of equal (text, line) pairs
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, newline, newline + 1]))
    lo, hi = cuts[:-1], cuts[1:]
    has = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[has], hi[has]
    text_of = np.searchsorted(offsets, lo, "right") - 1
    key = T.span_hash(data, lo, hi) ^ T.mix(text_of.astype(np.uint64))
    _, kept = np.unique(key, return_index=True)
    repeated = np.ones(len(key), bool)
    repeated[kept] = False
    out["n_dup_lines"] = np.bincount(text_of[repeated], minlength=n)[:n]
    # words under windows that their text holds twice or more
    w, at = T.runs(h, first, WINDOW)
    key = w ^ T.mix(owner[at].astype(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    out["n_repeat_words"] = T.text_sums(np.cumsum(edge)[:-1] > 0, owner, n).astype(np.int64)
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """Families of (text, feature) occurrences, as arrays."""
    n = len(offsets) - 1
    shift = np.uint64(64 - BITS)
    start, end, h, first = T.words(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(first))
    yield owner, (h >> shift).astype(np.int64)
    pair, at = T.runs(h, first, 2)
    yield owner[at], (pair >> shift).astype(np.int64)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    for k in BYTE_WINDOWS:
        m = max(0, len(data) - k + 1)
        code = np.zeros(m, np.uint64)
        for j in range(k):
            code = (code << np.uint64(8)) | data[j : j + m]
        inside = text_of[:m] == text_of[k - 1 :] if m else np.zeros(0, bool)
        code = (code[inside] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        yield text_of[:m][inside], (code >> shift).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, a: float = 1.0, b: float = 0.0):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        z = np.full(n, self.bias)
        for k, (owner, feature) in enumerate(features(data, offsets)):
            z += SCALE * T.text_sums(self.weights[k][feature], owner, n) / np.maximum(np.bincount(owner, minlength=n)[:n], 1)
        return z

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.a * self.logits(data, offsets) + self.b)


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, fold: np.ndarray, epochs: int = 6, batch: int = 64,
        rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> Model:
    families = 2 + len(BYTE_WINDOWS)
    weights = np.zeros((families, 1 << BITS), np.float32)
    if not len(y) or y.min() == y.max():
        return Model(weights, 30.0)
    n = len(y)
    rows = []  # per family: distinct (text, feature) with their share
    parts: list[list] = [[] for _ in range(families)]
    for a, b, d, o in L.chunks(data, offsets):
        for part, (owner, feature) in zip(parts, features(d, o)):
            key, count = np.unique((owner << BITS) | feature, return_counts=True)
            text_of = key >> BITS
            share = SCALE * count / np.maximum(np.bincount(owner, minlength=b - a), 1)[text_of]
            part.append((np.bincount(text_of, minlength=b - a), (key & ((1 << BITS) - 1)).astype(np.int32), share.astype(np.float32)))
    for part in parts:
        size, feature, share = (np.concatenate(x) for x in zip(*part))
        rows.append((np.concatenate([[0], np.cumsum(size)]), feature, share))
    rng, squares = np.random.RandomState(seed), np.full(weights.shape, 1e-3, np.float32)
    bias, bias2, use = 1.0, 1e-2, np.flatnonzero(fold > 1)
    for _ in range(epochs):
        order = rng.permutation(use)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            z, parts = np.full(len(pick), bias), []
            for k, (first, feature, share) in enumerate(rows):
                size = first[pick + 1] - first[pick]
                own = np.repeat(np.arange(len(pick)), size)
                at = np.repeat(first[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                z += T.text_sums(weights[k][feature[at]] * share[at], own, len(pick))
                parts.append((own, feature[at], share[at]))
            d = (L.sigmoid(z) - y[pick]) / len(pick)
            for k, (own, feature, share) in enumerate(parts):
                uniq, inverse = np.unique(feature, return_inverse=True)
                g = np.bincount(inverse, weights=d[own] * share, minlength=len(uniq)) + decay * weights[k][uniq]
                squares[k][uniq] += g * g
                weights[k][uniq] -= (rate * g / np.sqrt(squares[k][uniq])).astype(np.float32)
            bias2 += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(bias2)
    model = Model(weights, float(bias))
    held = fold <= 1
    if held.any() and y[held].min() != y[held].max():
        z = np.concatenate([model.logits(d, o) for _, _, d, o in L.chunks(data, offsets)])
        model.a, model.b = L.platt(z[held], y[held])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return L.fitted(L.labelled_sample(docs, labels, "quality", rows=SAMPLE_ROWS), fit)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, the calibrated probability and kept for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return base(data, offsets) | {"probability": shared.value.probability(data, offsets)}

    out = L.map_text(docs, [F.col("doc_id")], "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                     "n_repeat_words bigint, probability double", run)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "probability")
