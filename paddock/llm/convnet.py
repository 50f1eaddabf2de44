"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters over WIDTH neighbouring bytes
(one-hot bytes, so a filter is a table of byte values by place) run at every position; each filter is max-pooled over
its chunk; a hidden layer turns the pooled values into a chunk logit, and the mean and the least chunk logit of a text
are combined into one calibrated probability. Fitted by Adam on a bounded labelled sample, scored over whole texts.

Empty and null texts are one chunk of padding, so they get a score as well. Without labelled rows of both classes the
network is untrained and every text scores the prior 0.5. Repeated rows score equally; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T
from paddock.llm.store import free_name

WIDTH = 8             # bytes under a filter; even
FILTERS = 16
HIDDEN = 16
CHUNK = 512           # bytes of a chunk
STEP = 448            # from one chunk's begin to the next one's
BLOCK = 1 << 17       # positions convolved at a time
MODULUS, HELD = 4, 2
THRESHOLD = 0.7
SAMPLE_ROWS = 3072    # labelled rows that the fit sees at most


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of all chunks. The last chunk of a text ends with it; an empty text has one empty chunk."""
    size = np.diff(offsets)
    count = 1 + np.maximum(0, -(-(size - CHUNK) // STEP))
    owner = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][owner] + k * STEP
    return owner, begin, np.minimum(begin + CHUNK, offsets[1:][owner])


def spaced(data: np.ndarray, offsets: np.ndarray):
    """(bytes, text, begin, end): the texts with WIDTH zero bytes behind each, so no filter sees two, and their chunks."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(data) + WIDTH * (len(offsets) - 1), np.uint8)
    out[np.arange(len(data)) + WIDTH * text] = data
    owner, begin, end = cut(offsets)
    return out, owner, begin + WIDTH * owner, end + WIDTH * owner


class Net:
    """tables[WIDTH, 256, FILTERS], bias; hidden layer; output; combination (mean, least, constant)."""

    def __init__(self, seed: int = 3):
        rng = np.random.RandomState(seed)
        self.p = {"t": (rng.randn(WIDTH, 256, FILTERS) * 0.3).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
                  "h": (rng.randn(FILTERS + 1, HIDDEN) * 0.3).astype(np.float32), "c": np.zeros(HIDDEN, np.float32),
                  "o": (rng.randn(HIDDEN) * 0.3).astype(np.float32), "d": np.zeros(1, np.float32)}
        self.mix = np.zeros(3)

    def pair_tables(self) -> np.ndarray:
        """The filters by pairs of bytes: half the look-ups when scoring."""
        t = self.p["t"]
        return (t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)

    def pooled(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, pairs: np.ndarray, where: bool = False):
        """Max of each filter over each chunk (and the first position that reaches it). Positions past the end see 0."""
        n = len(data)
        padded = np.zeros(n + WIDTH + 1, np.uint16)
        padded[:n] = data
        pair = (padded[:-1] << 8) | padded[1:]
        top = np.full((len(begin), FILTERS), -np.inf, np.float32)
        place = np.zeros((len(begin), FILTERS), np.int64)
        a = 0
        while a < len(begin):
            b = min(len(begin), max(a + 1, int(np.searchsorted(end, begin[a] + BLOCK, "right"))))
            lo, hi = int(begin[a]), max(int(end[b - 1]), int(begin[b - 1]) + 1)
            out = pairs[0][pair[lo:hi]]
            for k in range(1, WIDTH // 2):
                out += pairs[k][pair[lo + 2 * k : hi + 2 * k]]
            for i in range(a, b):  # overlapping chunks: one reduction each
                seg = out[begin[i] - lo : max(end[i], begin[i] + 1) - lo]
                if where:
                    place[i] = seg.argmax(0)
                    top[i] = seg[place[i], np.arange(FILTERS)]
                else:
                    top[i] = seg.max(0)
            a = b
        top += self.p["b"]
        return (top, place + begin[:, None]) if where else top

    def logits(self, top: np.ndarray, size: np.ndarray):
        """Hidden inputs (pooled filters and the log size of a chunk: short ones reach lower maxima), hidden, logits."""
        x = np.concatenate([np.maximum(top, 0), np.log1p(size)[:, None].astype(np.float32) / 3], 1)
        hid = x @ self.p["h"] + self.p["c"]
        return x, hid, np.maximum(hid, 0) @ self.p["o"] + self.p["d"][0]

    def texts(self, data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and least chunk logit of every text."""
        data, owner, begin, end = spaced(data, offsets)
        z = self.logits(self.pooled(data, begin, end, pairs), end - begin)[2].astype(float)
        n = len(offsets) - 1
        first = np.searchsorted(owner, np.arange(n))
        return T.text_sums(z, owner, n) / np.maximum(np.bincount(owner, minlength=n), 1), np.minimum.reduceat(z, first)

    def score(self, data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        mean, least = self.texts(data, offsets, pairs)
        return L.sigmoid(self.mix[0] * mean + self.mix[1] * least + self.mix[2])


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, fold: np.ndarray, steps: int = 300, batch: int = 128,
        rate: float = 6e-3, seed: int = 3) -> Net:
    """Adam on the logistic loss of the mean chunk logit; classes weigh equally. Fold 0 calibrates the combination."""
    net, rng = Net(seed), np.random.RandomState(seed)
    if not len(y) or y.min() == y.max():
        return net
    grads = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    use = np.flatnonzero(fold != 0)
    batch = int(np.clip(len(use) // 12, 16, batch))
    epochs = max(4, -(-steps * batch // len(use))) if len(use) else 0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    weight = np.sqrt(weight)
    padded, owner, begin, end = spaced(data, offsets)
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(use)
        lr = rate * (1 - epoch / epochs) + 2e-4
        for a in range(0, len(order), batch):
            rows = np.sort(order[a : a + batch])
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            own = np.searchsorted(rows, owner[at])
            # texts of one batch lie apart: convolve each chunk range on its own bytes
            size = np.maximum(end[at] - begin[at], 1)
            place0 = np.concatenate([[0], np.cumsum(size)])
            src = np.repeat(begin[at] - place0[:-1], size) + np.arange(place0[-1])
            out = net.p["t"][0][padded[src]]
            for k in range(1, WIDTH):
                out += net.p["t"][k][padded[src + k]]
            place = np.stack([place0[i] + out[place0[i] : place0[i + 1]].argmax(0) for i in range(len(at))])
            top = np.take_along_axis(out, place, 0) + net.p["b"]
            x, hid, z = net.logits(top, end[at] - begin[at])
            count = np.bincount(own, minlength=len(rows))
            zm = T.text_sums(z, own, len(rows)) / count
            g = ((L.sigmoid(zm) - y[rows]) * weight[rows] / len(rows))[own] / count[own]
            g = g.astype(np.float32)
            act = np.maximum(hid, 0)
            grad = {"o": act.T @ g, "d": np.array([g.sum()], np.float32)}
            gh = g[:, None] * net.p["o"] * (hid > 0)
            grad["h"], grad["c"] = x.T @ gh, gh.sum(0)
            gx = (gh @ net.p["h"].T)[:, :FILTERS] * (top > 0)
            grad["b"] = gx.sum(0)
            gt = np.zeros_like(net.p["t"])
            where = src[place]
            cols = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(gt[k], (padded[where + k], cols), gx)
            grad["t"] = gt
            t += 1
            for k, v in net.p.items():
                m, s = grads[k]
                m += 0.1 * (grad[k] - m)
                s += 0.01 * (grad[k] ** 2 - s)
                v -= lr * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    pairs = net.pair_tables()
    mean, least = (np.concatenate(x) for x in zip(*(net.texts(d, o, pairs) for _, _, d, o in L.chunks(data, offsets))))
    held = fold == 0 if (fold == 0).any() and y[fold == 0].min() != y[fold == 0].max() else np.ones(len(y), bool)
    net.mix = combine(mean[held], least[held], y[held])
    return net


def combine(mean: np.ndarray, least: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps of a ridge logistic regression of y on (mean, least, 1)."""
    x = np.stack([mean, least, np.ones(len(y))], 1)
    w = np.array([0.5, 0.5, 0.0])
    ridge = np.diag([0.5, 0.5, 1e-6])
    for _ in range(steps):
        p = L.sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (w - [0.5, 0.5, 0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, modulus: int | None = MODULUS, held: int = HELD) -> Net:
    return L.fitted(L.labelled_sample(docs, labels, "quality", modulus, held, rows=SAMPLE_ROWS), fit)


def scored(docs: DataFrame, net: Net, keep: list[str], name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row of docs, and its score under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.pair_tables()))

    def score(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return {name: shared.value[0].score(data, offsets, shared.value[1])}

    return L.map_text(docs, [F.col(c) for c in keep], f"{name} double", score)


def quality(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row of docs."""
    out = scored(docs, net, ["doc_id"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with their own columns."""
    score = free_name(docs.columns, "__quality")
    return scored(docs, net, docs.columns, score).where(F.col(score) >= threshold).drop(score)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(L.remainder(F.col("doc_id"), MODULUS) == HELD, F.lit(False)).alias("held_out"),
                      "score", "predicted")
