"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x marks the distinct terms of a text: every
lower-cased word, and the beginnings of words (inflected forms share them). The pairwise factors learn interactions
that additive weights miss, such as an insult together with the mention of a group. Fitted by AdaGrad on a bounded
labelled sample (``SAMPLE_ROWS``), scored over all of every text in Arrow batches.

Empty and null texts have no terms and get sigmoid(w0). Without labelled rows all weights
are 0 and w0 is the prior log-odds -2. Repeated rows get equal scores; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T

BITS = 18
FACTORS = 4
PREFIXES = (5,)       # bytes; words with longer beginnings in common share a term
MODULUS, HELD = 5, 0
THRESHOLD = 0.5
SAMPLE_ROWS = 8192    # labelled rows that the fit sees at most


def terms(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all distinct hashed terms, ordered by text and term."""
    low = T.LOWER[data] if len(data) else data
    start, end, h, first = T.words(low, offsets, T.NON_ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(first))
    shift = np.uint64(64 - bits)
    keys = [(owner << bits) | (h >> shift).astype(np.int64)]
    for k, size in enumerate(PREFIXES):
        long = end - start > size
        ph = T.mix(T.span_hash(low, start[long], start[long] + size) + np.uint64(k + 1))
        keys.append((owner[long] << bits) | (ph >> shift).astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return found >> bits, found & ((1 << bits) - 1)


class Model:
    """w0, linear weights and factors of the machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logits(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        z = self.w0 + T.text_sums(self.w[term], owner, n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            z += 0.5 * (T.text_sums(x, owner, n) ** 2 - T.text_sums(x * x, owner, n))
        return z

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        owner, term = terms(data, offsets)
        return {"score": L.sigmoid(self.logits(owner, term, len(offsets) - 1))}


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 16,
        batch: int = 64, rate: float = 0.3, sparse: float = 2e-3, decay: float = 1e-3, seed: int = 7) -> Model:
    rng = np.random.RandomState(seed)
    w0, w = -2.0, np.zeros(1 << bits, np.float32)
    v = (rng.randn(1 << bits, factors) * 0.01).astype(np.float32)
    n = len(offsets) - 1
    if not n or y.min() == y.max():
        return Model(w0, w, np.zeros_like(v))
    parts = [(a + owner, term.astype(np.int32)) for a, _, d, o in L.chunks(data, offsets) for owner, term in [terms(d, o, bits)]]
    owner, term = (np.concatenate(x) for x in zip(*parts))
    # a term seen in one sampled text says nothing about others
    seen = np.bincount(term, minlength=1 << bits)
    owner, term = owner[seen[term] > 1], term[seen[term] > 1]
    v[seen <= 1] = 0
    first = np.searchsorted(owner, np.arange(n + 1))
    gw, gv, g0 = np.full(len(w), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            size = first[rows + 1] - first[rows]
            own = np.repeat(np.arange(len(rows)), size)
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            idx = term[at]
            model = Model(w0, w, v)
            d = (L.sigmoid(model.logits(own, idx, len(rows))) - y[rows]).astype(np.float32)
            uniq, inverse = np.unique(idx, return_inverse=True)
            lin = np.bincount(inverse, weights=d[own], minlength=len(uniq)) / len(rows)
            gw[uniq] += lin * lin
            step = rate / np.sqrt(gw[uniq])
            moved = w[uniq] - step * lin
            w[uniq] = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0)  # proximal step: noise stays at 0
            for f in range(factors):
                x = v[idx, f]
                s = T.text_sums(x, own, len(rows))
                part = np.bincount(inverse, weights=d[own] * (s[own] - x), minlength=len(uniq)) / len(rows) + decay * v[uniq, f]
                gv[uniq, f] += part * part
                v[uniq, f] -= (0.2 * rate * part / np.sqrt(gv[uniq, f])).astype(np.float32)
            b = float(d.mean())
            g0 += b * b
            w0 -= rate * b / np.sqrt(g0)
    return Model(w0, w, v)


def train(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held: int = HELD) -> Model:
    sample = L.labelled_sample(docs, labels, "toxic", modulus, held, rows=SAMPLE_ROWS)
    return L.fitted(sample, lambda data, offsets, y, fold: fit(data, offsets, y))


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = L.map_text(docs, [F.col("doc_id")], "score double", lambda d, o: shared.value.score(d, o))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(L.remainder(F.col("doc_id"), MODULUS) == HELD, F.lit(False)).alias("held_out"),
                      "score", "predicted")
