"""Labelled samples for the trained operators, and Arrow-batch scoring with a broadcast model."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import memory
from paddock.llm import text as T
from paddock.llm.store import free_name
from paddock.packaging import ship_package

# Training bounds. Models are fitted on at most SAMPLE_ROWS labelled rows, chosen by a hash of the id, each of at
# most SAMPLE_BYTES bytes; scoring always covers every row and every byte.
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 1 << 16
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 21


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int | None = None, held: int = 0,
                    rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label, fold) of a bounded set of labelled documents.

    Rows whose id falls on the held-out remainder never enter. Of several labels of an id the largest counts; of
    several documents of an id, the least text. Null labels, ids and texts are left out. ``fold`` is 0..9 by hash.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if modulus:
        marks = marks.where(remainder(F.col("doc_id"), modulus) != held)
    fits = docs.where(F.octet_length("text") <= text_bytes).select("doc_id", "text")
    chosen = (marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return (fits.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(10))))


def in_one_task(rows: DataFrame, f: Callable[[pa.Table], object]) -> object:
    """What f makes of a bounded table, computed in one task: the driver gets the result only, and a lost executor costs a
    retry. rows must be bounded by a parameter, whatever the input."""
    small_batches(rows.sparkSession)
    schema = pa.schema([("__model", pa.binary())])
    columns, empty = rows.columns, rows.limit(0).toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).rename_columns(columns) if held else empty
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(table))], pa.binary())], schema=schema)

    made = rows.repartition(1).mapInArrow(released(run), "__model binary").collect()
    return pickle.loads(made[0][0]) if made else f(empty)


def fitted(sample: DataFrame, fit: Callable[..., object]) -> object:
    """fit(bytes, offsets, label, fold) of a bounded labelled sample, its rows in the order of a hash of the id."""

    def run(table: pa.Table) -> object:
        table = table.sort_by([("at", "ascending"), ("doc_id", "ascending")])
        data, offsets = T.raw(table.column("text"))
        y, fold = (table.column(c).to_numpy().astype(int) for c in ("label", "fold"))
        return fit(data, offsets, y, fold)

    return in_one_task(sample.select("text", "label", "fold", F.xxhash64("doc_id").alias("at"), "doc_id"), run)


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of whole texts of about ``limit`` bytes (one text at least): (from, to, bytes, offsets)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a batch of long rows stays small; the tasks get this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; after it a task gives back the memory of its arrays, as idle workers stay beside the busy ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        memory.released()

    return task


def map_text(docs: DataFrame, keep: list[Column], schema: str,
             f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Rows of ``keep`` with the columns of ``schema`` that ``f(bytes, offsets)`` computes from the whole texts.

    Runs in Arrow batches inside the scan's tasks; a null text is an empty one. ``keep`` comes back unchanged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = free_name(docs.select(*keep).columns, "__text")
    inner = docs.select(*keep, F.col("text").alias(body))
    kept = inner.columns[:-1]
    empty = spark.createDataFrame([], schema).schema
    out_schema = inner.drop(body).schema
    for field in empty:
        out_schema = out_schema.add(field)
    fields = [(f_.name, f_.dataType.simpleString()) for f_ in empty]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.raw(batch.column(len(kept)))
            parts: list[list] = [[] for _ in fields]
            for _, _, d, o in chunks(data, offsets):
                got = f(d, o)
                for part, (name, _) in zip(parts, fields):
                    part.append(pa.array(got[name], arrow[dict(fields)[name]]))
            made = [pa.concat_arrays(p) if p else pa.array([], arrow[kind]) for p, (_, kind) in zip(parts, fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *(n for n, _ in fields)])

    return inner.mapInArrow(released(run), out_schema)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a z + b), by Newton steps on the smoothed targets of Platt."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
