"""Near-duplicate vectors by cosine: product quantisation over coarse inverted lists, then an exact rerank.

1. Equal vectors become one entry with a count of copies; all further work is on entries.
2. From a bounded sample: coarse unit centroids (about the square root of the entries, LISTS at most) and, for residuals to
   them, SUBSPACES codebooks of CODES words. The number of probes is the least with which TARGET of the pairs at exactly the
   threshold, built around sample vectors in random directions and in directions of other vectors, meet in a list from one
   side or the other.
3. Every entry is coded: its list, the code of its residual, and the distance ``err`` between it and what the code stands for.
4. An entry is a query in each list that it probes. The squared distances of the query's residual to all code words are
   tabled, and an entry's distance is the sum of SUBSPACES looked-up numbers. As |d(x, y) - d(x, coded y)| <= err(y), pairs
   beyond the threshold by more than err are dropped: the codes never lose a pair. What is left is compared by the cosine in
   double precision.
5. A pair that both sides would find counts where the smaller list looks for the larger one. A task returns for each entry the
   links it found and the least entry it reached, never the pairs; counts are summed and components contracted in rounds.

A list of any size is cut into blocks of BLOCK entries by PART queries, so that a task is bounded however many vectors crowd
in one list. Only the fit sees a sample: every vector is coded and searched.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing and are rows of their own; vectors
of different lengths never link. Repeated rows are copies: each links to the others. A null vec_id counts as a link but is no
component id while its component holds another id; it is never kept. An empty table gives no rows. Columns other than vec_id
and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.components import components
from paddock.llm.learn import in_one_task
from paddock.llm.store import stored
from paddock.packaging import ship_package

THRESHOLD = 0.9
LISTS = 4096          # inverted lists at most
SAMPLE_ROWS = 16_384  # entries that the fit sees at most
SUBSPACES, CODES = 8, 256
TARGET = 0.999        # share of the pairs at the threshold that the probes have to meet on the sample
BLOCK, PART = 4096, 4096
CHUNK = 256           # queries whose distances to a block are held at once


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (no row is zero)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors stored as bytes of doubles, padded with zeros to the longest; cosines of equally long ones stay the same."""
    raw = column.to_pylist()
    width = max((len(b) for b in raw), default=0)
    return np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), np.float64).reshape(len(raw), width // 8)


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vector) of every row: the vector's doubles as bytes and their digest, null where it can't link."""
    ship_package(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("key", T.BinaryType()), T.StructField("vector", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, lengths = pc.list_flatten(column), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
            ends = np.cumsum(lengths)
            bad = np.cumsum(np.concatenate([[0], ~np.isfinite(values)]))
            some = np.cumsum(np.concatenate([[0], values != 0]))
            good = (bad[ends] == bad[ends - lengths]) & (some[ends] > some[ends - lengths])
            vector = [values[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, lengths, good)]
            key = [None if v is None else hashlib.sha256(v).digest()[:16] for v in vector]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(vector, pa.binary())],
                                             names=["vec_id", "key", "vector"])

    return rows.mapInArrow(run, schema)


@dataclass
class Index:
    """Coarse centroids (lists x width), codebooks (one array of words a subspace), and probes a query makes."""
    centroids: np.ndarray
    cuts: np.ndarray
    books: list
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut or padded to the index's width (its sample may lack the longest); lists stay a matter of speed."""
        w = min(self.width, x.shape[1])
        out = np.zeros((len(x), self.width))
        out[:, :w] = x[:, :w]
        return out

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances (subspaces x rows x words) of residuals to the words."""
        out = np.full((len(self.books), len(residual), max(len(b) for b in self.books)), np.inf, np.float32)
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            out[m, :, : len(book)] = np.maximum(0.0, (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1))
        return out

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, err) of residuals: the nearest word of each subspace, and the distance to what the code stands for."""
        code = self.tables(residual).argmin(2).T.astype(np.uint8)
        back = np.concatenate([book[code[:, m]] for m, book in enumerate(self.books)], 1)
        return code, np.sqrt(((residual - back) ** 2).sum(1))

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The lists that each vector probes, its own first."""
        score = x @ self.centroids.T
        own = score.argmax(1)
        score[np.arange(len(x)), own] = np.inf
        p = min(self.probes, score.shape[1])
        near = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < score.shape[1] else np.argsort(-score, axis=1)
        rest = near[near != own[:, None]].reshape(len(x), p - 1)
        return np.concatenate([own[:, None], rest], 1).astype(np.int32)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.RandomState, spherical: bool = False) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        score = x @ centres.T - (0 if spherical else 0.5 * (centres * centres).sum(1))
        own = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1)) if spherical else np.bincount(own, minlength=len(centres))
        full = size > 1e-12
        centres[full] = sums[full] / size[full, None]
    return centres


def fit(x: np.ndarray, lists: int, threshold: float, subspaces: int = SUBSPACES, codes: int = CODES, target: float = TARGET) -> Index:
    """The index of a sample of unit vectors."""
    rng = np.random.RandomState(13)
    centroids = kmeans(x, min(lists, len(x)), 8, rng, spherical=True)
    cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
    residual = x - centroids[(x @ centroids.T).argmax(1)]
    books = [kmeans(np.ascontiguousarray(residual[:, a:b]), min(codes, len(x)), 6, rng) for a, b in zip(cuts, cuts[1:])]
    index = Index(centroids, cuts, books, len(centroids))
    # pairs at exactly the threshold around sample vectors, in random directions and towards other vectors
    q = x[rng.permutation(len(x))[:2000]]
    worst = 1
    for toward in (rng.standard_normal(q.shape), x[rng.randint(0, len(x), len(q))]):
        away = toward - (toward * q).sum(1, keepdims=True) * q
        size = np.sqrt((away * away).sum(1, keepdims=True))
        use = size[:, 0] > 1e-9
        y = threshold * q[use] + np.sqrt(1 - threshold ** 2) * away[use] / size[use]
        a, b = q[use] @ centroids.T, y @ centroids.T
        i = np.arange(len(a))
        ranks = np.minimum((a > a[i, b.argmax(1)][:, None]).sum(1), (b > b[i, a.argmax(1)][:, None]).sum(1)) + 1
        if len(ranks):
            worst = max(worst, int(np.ceil(np.quantile(ranks, target))))
    index.probes = worst
    return index


CODED = "entry long, copies long, vector binary, code binary, err double, probes array<int>"


def coded(distinct: DataFrame, index: Index) -> DataFrame:
    """entry, copies, vector, code, err and probes (own list first) of every entry."""
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a in range(0, len(batch), 4096):
                rows = batch.slice(a, 4096)
                x = ix.fitted(unit(matrix(rows.column(2))))
                probes = ix.ranked(x)
                code, err = ix.codes(x - ix.centroids[probes[:, 0]])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, probes.size + 1, probes.shape[1], np.int32)), pa.array(probes.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), lists],
                                                 names=["entry", "copies", "vector", "code", "err", "probes"])

    return distinct.select("entry", "copies", "vector").mapInArrow(run, CODED)


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (a forest of least members) with the links a-b joined."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def found(index: Index, lists: int, own: dict, asked: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, links, least entry reached, pairs reranked) of the entries that links of one block by one part touch."""
    delta = np.sqrt(2 - 2 * threshold)
    ids, place = np.unique(np.concatenate([own["entry"], asked["entry"]]), return_inverse=True)
    mine, theirs = place[: len(own["entry"])], place[len(own["entry"]):]
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    q = index.fitted(asked["x"]) - index.centroids[lists]
    limit = ((delta + own["err"] + 1e-5) ** 2).astype(np.float32)
    reranked = 0
    for a in range(0, len(q), CHUNK):
        rows = slice(a, a + CHUNK)
        table = index.tables(q[rows])
        d = np.zeros((table.shape[1], len(own["entry"])), np.float32)
        for m in range(len(table)):
            d += table[m][:, own["code"][:, m]]
        near = d <= limit
        some_q, some_e = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(some_q):
            continue
        reranked += int(near.sum())
        cosine = asked["x"][rows][some_q] @ own["x"][some_e].T
        i, j = np.nonzero((cosine >= threshold) & near[np.ix_(some_q, some_e)])
        i, j = some_q[i] + a, some_e[j]
        same, there = asked["list"][i] == lists, asked["list"][i]
        both = (own["probes"][j] == there[:, None]).any(1)
        # in one's own list the smaller entry asks; a pair that both sides find counts in the task of the larger list
        keep = np.where(same, asked["entry"][i] < own["entry"][j], ~both | (there < lists)) & (asked["length"][i] == own["length"][j])
        i, j = i[keep], j[keep]
        np.add.at(links, theirs[i], own["copies"][j])
        np.add.at(links, mine[j], asked["copies"][i])
        parent = _roots(parent, theirs[i], mine[j])
    touched = np.flatnonzero(links)
    return ids[touched], links[touched], ids[parent[touched]], reranked


def linked(rows: DataFrame, index: Index, threshold: float = THRESHOLD, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(entry, links, root) that the tasks find among coded rows; an entry may come from several tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    own = rows.select(F.col("probes")[0].alias("list"), "entry", "copies", "vector", "code", "err", "probes")
    asked = rows.select(F.explode("probes").alias("list"), "entry", "copies", "vector", F.col("probes")[0].alias("home"))
    sizes = own.groupBy("list").agg(F.count("*").alias("n")).join(rows.select(F.explode("probes").alias("list")).groupBy("list").agg(
        F.count("*").alias("q")), "list").select("list", F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("q") / part).alias("parts"))
    sizes = F.broadcast(sizes)  # at most LISTS rows

    def dealt(df: DataFrame, by: str, to: str, salt: str) -> DataFrame:
        at = F.pmod(F.xxhash64("entry", F.lit(salt)), F.col(by)).cast("int").alias(by[:-1])
        every = F.explode(F.sequence(F.lit(0), (F.col(to) - 1).cast("int"))).alias(to[:-1])
        placed = df.join(sizes, "list").select(*df.columns, at, to)
        return placed.select(*df.columns, by[:-1], every)

    both = dealt(own, "blocks", "parts", "own").withColumn("home", F.lit(None).cast("int")).unionByName(
        dealt(asked, "parts", "blocks", "asked"), allowMissingColumns=True)
    schema = pa.schema([("entry", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def side(t: pa.Table) -> dict:
        vectors = t.column("vector").combine_chunks()
        return {"entry": t.column("entry").to_numpy(), "copies": t.column("copies").to_numpy(), "x": unit(matrix(vectors)),
                "length": pc.binary_length(vectors).to_numpy(zero_copy_only=False)}

    def one(t: pa.Table) -> pa.Table:
        is_own = pc.is_null(t.column("home"))
        mine, theirs = t.filter(is_own), t.filter(pc.invert(is_own))
        if not len(mine) or not len(theirs):
            return schema.empty_table()
        own, asked = side(mine), side(theirs)
        width = max(own["x"].shape[1], asked["x"].shape[1])
        for s in (own, asked):
            s["x"] = np.pad(s["x"], ((0, 0), (0, width - s["x"].shape[1])))
        own["code"] = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(mine), -1)
        own["err"] = mine.column("err").to_numpy()
        own["probes"] = np.array(mine.column("probes").to_pylist(), np.int32)
        asked["list"] = theirs.column("home").to_numpy()
        entry, links, root, _ = found(shared.value, t.column("list")[0].as_py(), own, asked, threshold)
        return pa.table([entry, links, root], schema=schema)

    return both.groupBy("list", "block", "part").applyInArrow(one, "entry long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    rows = stored(entries(vectors), "vectors-rows")
    distinct = rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    distinct = stored(distinct.withColumn("entry", F.monotonically_increasing_id()), "vectors-distinct")
    n = distinct.count()
    classes = distinct.select("key", "entry", "copies", "least")
    if n:
        sample = distinct.orderBy(F.xxhash64("key"), "key").select("vector").limit(SAMPLE_ROWS)
        lists = int(min(LISTS, np.ceil(np.sqrt(n))))
        index = in_one_task(sample, lambda t: fit(unit(matrix(t.column(0))), lists, threshold))
        found_rows = stored(linked(stored(coded(distinct, index), "vectors-coded"), index, threshold), "vectors-links")
        counts = found_rows.groupBy("entry").agg(F.sum("links").alias("links"))
        roots = components(found_rows.select(F.col("entry").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "entry"})
        classes = stored(classes.join(counts, "entry", "left").join(roots, "entry", "left"), "vectors-classes")
        least = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
        classes = classes.join(least, "root", "left")
    else:
        classes = classes.withColumn("links", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    classes = classes.select("key", links.alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(classes, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
