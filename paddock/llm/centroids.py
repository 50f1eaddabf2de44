"""Centroid clustering of integer vectors: Lloyd rounds whose assignment is an equal-average equal-variance search.

Every vector becomes integers, floor(SCALE * x). The centroids are sorted by their component sum. A vector starts at the
place of its own sum and scans outward, the nearer side first. With S the sum, W = sqrt(width * sum of squares - S^2) and d
the distance,

    width * d^2 >= (S_x - S_c)^2                          (equal average)
    width * d^2 >= (S_x - S_c)^2 + (W_x - W_c)^2          (equal variance)

The first inequality closes a side for good, as sums only move away there; the second one rejects a single centroid. What
is left is compared by its exact integer distance; of equal distances the smaller centroid number wins. The bounds are
floating point with slack, so that they never reject a centroid that the integers would take.

Each round is one pass of Arrow batches over the given table: a task keeps k x (width + 2) sums, the driver gets the
k x (width + 2) totals. Nothing is shuffled but those sums, and nothing is stored, so a lost executor costs its tasks only.

Rows whose vector is null, has another length or holds a null or non-finite component are left out. Repeated rows count as
often as they come, each with a row of its own; a null vec_id takes part, but starts a centroid only after all others. Fewer
kept vectors than centroids give as many centroids as there are vectors; an empty table gives no rows. Columns other than
vec_id and embedding are ignored. Integers beyond 2^26 are compared as Python's; a distance or inertia that does not fit in a
long becomes the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.vectors import dense
from paddock.packaging import ship_package

WIDTH, SCALE = 64, 1024
CENTROIDS, ROUNDS, SALT = 8, 10, "3"
LIMB = 100            # bits of a limb: the limbs of 2^26 tasks have a sum of 38 decimal digits
FITS = 1 << 26        # components up to here have exact sums and squares in 64-bit integers
MOST = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers, or Python's where one is beyond FITS."""
    if not x.size or np.abs(x).max() < FITS / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) > 2.0 ** 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


class Ordered:
    """Centroids in the order of their sums."""

    def __init__(self, centroids: list[list[int]]):
        self.numbers = sorted(range(len(centroids)), key=lambda j: (sum(centroids[j]), j))
        self.rows = [centroids[j] for j in self.numbers]
        self.small = all(abs(v) <= FITS for row in self.rows for v in row)
        if self.small:
            self.at = np.array(self.rows, np.int64)
            self.sums, self.spread = moments(self.at)
            self.number = np.array(self.numbers, np.int64)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, deviation norm scaled by sqrt(width)) of each row of 64-bit integers."""
    sums = x.sum(1)
    f = x.astype(np.float64)
    return sums, np.sqrt(np.maximum(0.0, x.shape[1] * (f * f).sum(1) - sums.astype(np.float64) ** 2))


def nearest(x: np.ndarray, centroids: Ordered) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, squared distance, distances computed) of every row of integers x."""
    n, width = x.shape
    if x.dtype == object or not centroids.small:
        pairs = [min((sum((int(a) - b) ** 2 for a, b in zip(row, c)), j) for c, j in zip(centroids.rows, centroids.numbers)) for row in x]
        out = np.empty(n, object)
        out[:] = [p[0] for p in pairs]
        return np.array([p[1] for p in pairs], np.int64), out, n * len(centroids.rows)
    k = len(centroids.rows)
    sums, spread = moments(x)
    slack = 1e-6 * (spread + 1.0)
    best, cluster = np.full(n, 1 << 62, np.int64), np.full(n, k, np.int64)
    right = np.searchsorted(centroids.sums, sums)
    left = right - 1
    rows, done = np.arange(n), 0
    while len(rows):
        lo, hi = left[rows], right[rows]
        down = np.where(lo >= 0, sums[rows] - centroids.sums[np.maximum(lo, 0)], 1 << 62)
        up = np.where(hi < k, centroids.sums[np.minimum(hi, k - 1)] - sums[rows], 1 << 62)
        gap = np.minimum(down, up)
        far = gap.astype(np.float64) ** 2
        limit = best[rows].astype(np.float64) * width * (1 + 1e-9)
        alive = (gap < 1 << 62) & (far <= limit)
        rows, far, limit = rows[alive], far[alive], limit[alive]
        down_first = (down <= up)[alive]
        pick = np.where(down_first, lo[alive], hi[alive])
        left[rows[down_first]] -= 1
        right[rows[~down_first]] += 1
        apart = np.maximum(0.0, np.abs(spread[rows] - centroids.spread[pick]) - slack[rows] - 1e-6 * centroids.spread[pick])
        try_it = far + apart * apart <= limit
        r, c = rows[try_it], pick[try_it]
        if len(r):
            delta = x[r] - centroids.at[c]
            d = (delta * delta).sum(1)
            done += len(r)
            name = centroids.number[c]
            won = (d < best[r]) | ((d == best[r]) & (name < cluster[r]))
            best[r[won]], cluster[r[won]] = d[won], name[won]
    return cluster, best, done


def starts(embeddings: DataFrame, k: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """The k kept vectors with the least sha256 of ``salt:vec_id``, in that order; equal ids by their components."""
    kept = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))))
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(rank.asc_nulls_last(), "x").limit(k).collect()  # k rows
    return [[int(v) for v in integers(np.array([r["x"]]), scale)[0]] for r in first]


def limbs(v: int) -> list[tuple[int, int]]:
    """(place, limb) of an integer in base 2^LIMB, without zeros; limbs carry its sign."""
    sign, v, out, place = (-1 if v < 0 else 1), abs(v), [], 0
    while v:
        v, limb = v >> LIMB, v & ((1 << LIMB) - 1)
        if limb:
            out.append((place, sign * limb))
        place += 1
    return out


def totals(embeddings: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """For each centroid: the sum of each component of its vectors, their count, and the sum of their distances."""
    ship_package(embeddings.sparkSession)
    k, width = len(centroids), len(centroids[0])
    schema = pa.schema([("c", pa.int32()), ("part", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Ordered(centroids)
        own = [[0] * (width + 2) for _ in range(k)]
        for batch in batches:
            x = integers(dense(batch.column(0), width)[1], scale)
            if not len(x):
                continue
            cluster, d, _ = nearest(x, order)
            for j in np.unique(cluster):
                of = cluster == j
                sums = [*x[of].sum(0).tolist(), int(of.sum()), int(d[of].astype(object).sum())]
                own[j] = [a + int(b) for a, b in zip(own[j], sums)]
        rows = [(j, p, place, Decimal(limb)) for j in range(k) for p, v in enumerate(own[j]) for place, limb in limbs(v)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), schema.types)], schema=schema)

    parts = embeddings.select("embedding").mapInArrow(run, "c int, part int, place int, total decimal(38,0)")
    out = [[0] * (width + 2) for _ in range(k)]
    for r in parts.groupBy("c", "part", "place").agg(F.sum("total").alias("total")).collect():  # k x (width + 2), times the limbs
        out[r["c"]][r["part"]] += int(r["total"]) << (LIMB * r["place"])
    return out


def lloyd(embeddings: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, scale: int = SCALE) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; rounds that would change nothing any more are not run."""
    for _ in range(rounds if centroids else 0):
        made = totals(embeddings, centroids, scale)
        moved = [[s // t[-2] for s in t[:-2]] if t[-2] else c for t, c in zip(made, centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assigned(embeddings: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared) of every kept vector."""
    ship_package(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding")
    schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], schema)
    width = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Ordered(centroids)
        for batch in batches:
            at, x = dense(batch.column(1), width)
            cluster, d, _ = nearest(integers(x, scale), order)
            if d.dtype == object:
                d = np.array([min(v, MOST) for v in d], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
              salt: str = SALT) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster and distance of every kept vector; the final centroids; the inertia of each)."""
    centroids = lloyd(embeddings, starts(embeddings, k, width, scale, salt), rounds, scale)
    inertia = [t[-1] for t in totals(embeddings, centroids, scale)] if centroids else []
    return assigned(embeddings, centroids, scale), centroids, inertia


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    out, centroids, inertia = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def by_cluster(values: list, kind: str):
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)

    return out.select("vec_id", "cluster", "distance", by_cluster([min(v, MOST) for v in inertia], "bigint").alias("cluster_inertia"),
                      F.lit(min(sum(inertia), MOST)).cast("bigint").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
