"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns (``base``) give exact spans of three kinds. The field tags each word (run of non-space) as secret begin, inside
or outside (B, I, O) from its shape, itself, its neighbours and features of the whole text, with learned transitions; the
best tagging is found by Viterbi over the whole text. It is trained on the patterns' own spans in a bounded sample of texts
(``SAMPLE_ROWS``): a tagging learned from surroundings and shapes goes on where a pattern is too narrow. Its spans, or the parts of them
outside the patterns' spans, are added with kind ``crf``.

Viterbi is exact though it visits few words: where O beats B and I by more than twice the range of the transitions, the best
tagging has O there whatever its neighbours are, so such words cut a text into independent stretches.

Null and empty texts have no spans. Without any pattern span in the sample the field adds nothing. Repeated rows get equal
spans; columns other than doc_id and text are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T
from paddock.llm.store import free_name

# The patterns of the contract, in the order in which kinds sort. {n} forms drop what is too short, where that
# can't change which matches follow; the first pattern's second group is measured after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN = 6
SPACES = " \t\n\v\f\r"
DELIMITERS = SPACES + "\"'`,;:.=()[]{}<>"

SAMPLE_ROWS = 4096    # texts that the fit sees at most
SAMPLE_BYTES = 1 << 15
CONTEXT = 10          # words on either side of a span that the fit sees
BITS = 14
FAMILIES = 9


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def beyond(text: str, found: list[tuple[int, int, int]], a: int, b: int) -> list[tuple[int, int, int]]:
    """The parts of a tagged span that no pattern's span covers, as added spans; parts of delimiters alone stay."""
    out, at = [], a
    for s, _, e in [*found, (b, 0, b)]:
        part = text[at : min(s, b)]
        inner = part.strip(SPACES)
        if inner and (len(part) == b - a or inner.strip(DELIMITERS)):
            start = at + len(part) - len(part.lstrip(SPACES))
            out.append((start, 3, start + len(inner)))
        at = max(at, e)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _counted(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=c[1:])
    return c[end] - c[start]


_CODE = np.arange(256)
DIGIT, UPPER, LOWER = ((_CODE >= 48) & (_CODE <= 57), (_CODE >= 65) & (_CODE <= 90), (_CODE >= 97) & (_CODE <= 122))
HEXES = DIGIT | ((_CODE >= 97) & (_CODE <= 102))
QUOTE, ASSIGNS = np.isin(_CODE, [34, 39]), np.isin(_CODE, [58, 61])


def emissions_input(data: np.ndarray, offsets: np.ndarray):
    """(start, end, first, features): feature numbers of every word in each family, of shape (FAMILIES, words).

    Families: the word's shape, the word, the previous and the next word, the previous and the next shape, the pair of
    the own and the previous shape, the density of digits in the text, the density of assignment signs and its length.
    """
    start, end, h, first = T.words(data, offsets)
    n = len(start)
    size = end - start
    count = [_counted(m[data], start, end) for m in (DIGIT, UPPER, LOWER, HEXES, QUOTE, ASSIGNS)]
    digit, upper, lower, hexes, quote, assigns = count
    length = np.digitize(size, [2, 4, 8, 16, 24, 32, 64])
    share = np.where(digit == 0, 0, np.where(digit * 4 < size, 1, np.where(digit < size, 2, 3)))
    shape = ((((length * 4 + share) * 2 + (upper > 0)) * 2 + (lower > 0)) * 2 + (hexes * 8 >= size * 7)) * 8
    shape += (quote > 0) * 4 + (assigns > 0) * 2 + (digit + upper + lower + quote + assigns < size)
    word = (h >> np.uint64(64 - BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    mask = (1 << BITS) - 1

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)  # 0: beyond the text
        if by < 0:
            out[1:] = np.where(owner[1:] == owner[:-1], x[:-1] + 1, 0)
        else:
            out[:-1] = np.where(owner[1:] == owner[:-1], x[1:] + 1, 0)
        return out & mask

    words = np.maximum(np.diff(first), 1)
    density = np.digitize(T.text_sums(digit, owner, len(words)) / words, [0.01, 0.05, 0.2, 1, 4])
    signs = np.digitize(T.text_sums(assigns, owner, len(words)) / words, [0.001, 0.01, 0.05, 0.2])
    whole = (density * 8 + signs) * 16 + np.minimum(np.log2(words).astype(np.int64), 15)
    if not n:
        return start, end, first, np.zeros((FAMILIES, 0), np.int64)
    before = moved(shape, -1)
    pair = (T.mix((before * 4099 + shape).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
    features = np.stack([shape & mask, word, moved(word, -1), moved(word, 1), before, moved(shape, 1), pair,
                         whole[owner] & mask, np.zeros(n, np.int64)])
    return start, end, first, features


class Field:
    """Emission tables (FAMILIES, 2**BITS, 3), transitions (3, 3), begin and end scores (3). Tags: 0 O, 1 B, 2 I."""

    def __init__(self):
        self.e = np.zeros((FAMILIES, 1 << BITS, 3), np.float32)
        self.t, self.s, self.f = np.zeros((3, 3)), np.zeros(3), np.zeros(3)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for k in range(FAMILIES):
            out += self.e[k][features[k]]
        return out

    def tags(self, em: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tagging of every text. first: the first word of each text, and the number of words."""
        best = np.zeros(len(em), np.int8)
        bound = 2 * (max(self.t.max(), self.s.max(), self.f.max(), 0) - min(self.t.min(), self.s.min(), self.f.min(), 0)) + 1e-3
        open_ = np.flatnonzero(em[:, 0] - np.maximum(em[:, 1], em[:, 2]) <= bound)
        if not len(open_):
            return best
        head = np.zeros(len(em) + 1, bool)
        head[first] = True
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | head[open_[1:]]
        begin = open_[new]
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        rows = len(begin)
        steps = int(size[0])
        score = em[begin] + np.where(head[begin][:, None], self.s, self.t[0])
        back = []
        for k in range(1, steps):
            live = int(np.searchsorted(-size, -k, "left"))  # stretches longer than k
            both = score[:live, :, None] + self.t
            back.append(both.argmax(1).astype(np.int8))
            score[:live] = both.max(1) + em[begin[:live] + k]
        last = begin + size
        tag = (score + np.where(head[last][:, None], self.f, self.t[:, 0])).argmax(1)
        at = np.arange(rows)
        best[begin + size - 1] = tag
        for k in range(steps - 1, 0, -1):
            live = int(np.searchsorted(-size, -k, "left"))
            tag[:live] = back[k - 1][at[:live], tag[:live]]
            best[begin[:live] + k - 1] = tag[:live]
        return best

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
        """Byte spans of the tagged secrets of every text, counted from its begin."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        start, end, first, features = emissions_input(data, offsets)
        if not len(start) or not self.e.any():
            return out
        tag = self.tags(self.emissions(features), first)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        previous = (-1, -1)
        for w in np.flatnonzero(tag):
            o = int(owner[w])
            a, b = int(start[w] - offsets[o]), int(end[w] - offsets[o])
            if tag[w] == 2 and previous == (o, w - 1):
                out[o][-1] = (out[o][-1][0], b)
            else:
                out[o].append((a, b))
            previous = (o, w)
        return out


def windows(texts: list[str], rng: np.random.RandomState):
    """Training windows (features (FAMILIES, n, length), tags, lengths): around pattern spans, and as many others."""
    picked, labels = [], []
    for text in texts:
        data, offsets = T.of_strings([text])
        start, end, first, features = emissions_input(data, offsets)
        if not len(start):
            continue
        points = T.code_points(data)
        tag = np.zeros(len(start), np.int64)
        for a, _, b in base(text):
            at = np.flatnonzero((points[end] > a) & (points[start] < b))
            at = at[tag[at] == 0]
            tag[at], tag[at[:1]] = 2, 1
        hits = np.flatnonzero(tag == 1)
        for c in (*hits, *rng.randint(0, len(start), 1 + len(hits))):
            a, b = max(0, c - CONTEXT), min(len(start), c + CONTEXT + 1)
            picked.append(features[:, a:b])
            labels.append(tag[a:b])
    return picked, labels


def fit(texts: list[str], epochs: int = 40, rate: float = 0.3, decay: float = 1e-4, others: int = 4000, seed: int = 11) -> Field:
    """Adagrad on the log-likelihood of the windows' tags, by forward and backward sums over all windows at once."""
    field, rng = Field(), np.random.RandomState(seed)
    picked, labels = windows(texts, rng)
    with_span = [i for i, x in enumerate(labels) if x.any()]
    if not with_span:
        return field
    without = [i for i, x in enumerate(labels) if not x.any()][:others]
    use = with_span + without
    size = np.array([len(labels[i]) for i in use])
    n, longest = len(use), int(size.max())
    x = np.zeros((FAMILIES, n, longest), np.int64)
    y = np.zeros((n, longest), np.int64)
    for r, i in enumerate(use):
        x[:, r, : size[r]], y[r, : size[r]] = picked[i], labels[i]
    inside = np.arange(longest) < size[:, None]
    y1 = np.eye(3)[y] * inside[:, :, None]
    square_e, square_t = np.full(field.e.shape, 1e-4, np.float32), np.full((3, 3), 1e-2)
    for _ in range(epochs):
        em = np.zeros((n, longest, 3))
        for k in range(FAMILIES):
            em += field.e[k][x[k]]
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = em[:, 0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + field.t, axis=1) + em[:, k]
            alpha[:, k] = np.where(inside[:, k, None], step, alpha[:, k - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        expected_t = np.zeros((3, 3))
        for k in range(longest - 1, 0, -1):
            own = inside[:, k]
            ahead = em[:, k] + beta[:, k]
            joint = np.exp(alpha[:, k - 1, :, None] + field.t + ahead[:, None, :] - total[:, None, None]) * own[:, None, None]
            expected_t += joint.sum(0)
            beta[:, k - 1] = np.where(own[:, None], np.logaddexp.reduce(field.t + ahead[:, None, :], axis=2), 0)
        gap = (np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None] - y1) / n
        seen_t = np.einsum("nka,nkb->ab", y1[:, :-1], y1[:, 1:])
        g = (expected_t - seen_t) / n + decay * field.t
        square_t += g * g
        field.t -= rate * g / np.sqrt(square_t)
        flat = gap.reshape(-1, 3)
        for k in range(FAMILIES):
            uniq, inverse = np.unique(x[k].ravel(), return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=flat[:, c], minlength=len(uniq)) for c in range(3)], 1) + decay * field.e[k][uniq]
            square_e[k][uniq] += (g * g).astype(np.float32)
            field.e[k][uniq] -= (rate * g / np.sqrt(square_e[k][uniq])).astype(np.float32)
    # words never seen in training are O: a constant keeps the field from firing on unknown shapes
    field.e[FAMILIES - 1, 0, 0] += 0.5
    return field


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> Field:
    """Fitted on a bounded sample of docs: ids by hash, at most ``rows`` texts of at most ``text_bytes`` bytes."""
    n = docs.count()
    share = min(1_000_000, -(-rows * 1_100_000 // max(n, 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).where(F.octet_length("text").between(1, text_bytes))
    sample = sample.select("doc_id", "text").limit(2 * rows)

    def run(table: pa.Table) -> Field:
        got = zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())
        return fit([t for _, _, t in sorted({(i is None, i or 0, t) for i, t in got})[:rows]])

    return L.in_one_task(sample, run)


def scan(docs: DataFrame, field: Field, out_name: str = "spans") -> DataFrame:
    """Every row of docs with ``out_name array<struct<kind, start, end>>``, base and added spans, ordered."""
    spark = docs.sparkSession
    L.small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    inner = docs.select("*", F.col("text").alias(free_name([*docs.columns, out_name], "__text")))
    schema = docs.select("*", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>").alias(out_name)).schema
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [*docs.columns, out_name]
    width = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(width)
            data, offsets = T.raw(column)
            out = []
            for a, b, d, o in L.chunks(data, offsets):
                for k, extra in enumerate(shared.value.spans(d, o)):
                    text = column[a + k].as_py() or ""
                    found = base(text)
                    if extra:
                        points = T.code_points(d[o[k] : o[k + 1]])
                        found += [part for x, y in extra for part in beyond(text, found, int(points[x]), int(points[y]))]
                    out.append([{"kind": KINDS[k_], "start": s, "end": e} for s, k_, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, span)], names=names)

    return inner.mapInArrow(L.released(run), schema)


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scanned rows (doc_id, spans)."""
    shown = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(F.expr(shown.format("filter(spans, s -> s.kind != 'crf')")), 256).alias("base_sha256"),
                          F.expr(shown.format("spans")).alias("spans"))


def redacted(docs: DataFrame, field: Field, mask: str = "[secret]") -> DataFrame:
    """docs with every span of ``text`` replaced by the mask (overlapping spans by one), and n_chars of the new text."""
    name = free_name(docs.columns, "__spans")
    pieces = """aggregate(`{spans}`, named_struct('at', 0, 'out', ''), (s, x) -> if(x.end <= s.at, s, named_struct('at', x.end, 'out',
        concat(s.out, if(x.start >= s.at, concat(substring(text, s.at + 1, x.start - s.at), '{m}'), '')))),
        s -> concat(s.out, substring(text, s.at + 1, 2147483647)))""".format(m=mask.replace("'", "\\'"), spans=name)
    found = F.size(name) > 0
    out = scan(docs, field, name).withColumn("text", F.when(found, F.expr(pieces)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(name)


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(scan(docs.select("doc_id", "text"), train(docs)).select("doc_id", "spans"))
