"""A fixed-size sieve for ids: keeps the rows whose id may be wanted, before a join that decides.

The sieve is a bitmap of 2**BITS bits, whatever the number of ids; with many ids it lets more through, and the join after it
stays exact. So a join that wants few rows needn't shuffle the texts of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

from paddock.llm import learn as L
from paddock.llm import text as T

BITS = 24             # 2 MB
MERGED = 32           # bitmaps that reach the driver, one after another, at most


def place_of(ids: np.ndarray) -> np.ndarray:
    return (T.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bitmap of the first column (bigint, no nulls) of ids."""
    L.small_batches(ids.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BITS, bool)
        for batch in batches:
            own[place_of(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in ids.select(ids.columns[0]).coalesce(MERGED).mapInArrow(L.released(mark), "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _kept(rows: DataFrame, shared: Broadcast, inside: bool) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[place_of(batch.column(0).to_numpy())] == inside))

    return rows.mapInArrow(L.released(keep), rows.schema)


def sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column (bigint, no nulls) may be among ids; none that is goes missing."""
    return _kept(rows, rows.sparkSession.sparkContext.broadcast(bitmap(ids)), True)


def divided(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose first column may be among ids, the others, none of which is)."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids))
    return _kept(rows, shared, True), _kept(rows, shared, False)
