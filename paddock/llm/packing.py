"""Best-fit packing by bin completion: documents' token pieces into as few sequences of CAPACITY tokens as it can.

Texts are encoded in Arrow batches and cut into pieces; pieces have at most CAPACITY different lengths, so the whole
problem is a histogram of lengths, whatever the number of documents. On it the driver runs bin completion: it takes the
longest remaining piece, enumerates by branch and bound the undominated fillings of the room beside it (longest pieces
first; a filling to which another piece could be added is dominated), begins with the best-fit filling as the incumbent,
cuts branches whose waste can't fall below the incumbent's, and repeats the filling as often as the histogram allows.
A filling uses up a length (or all but a few pieces of it), so there are a few thousand at most. The pieces are then
numbered within their length in a distributed way, and a piece's number decides its sequence and place.

A null text is an empty one: one piece of the end id alone. Repeated rows are packed once each. An empty table gives no
rows. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm import learn as L
from paddock.llm.store import stored

CAPACITY = 2048
END = 0               # id after each document
NODES = 3000          # of the search for one filling; beyond it the incumbent is taken
BUCKET = 2000         # pieces of one length that one task numbers


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE vocabulary file of the tokenizers library, whose ids follow the merges' order.

    The file writes bytes as printable characters: bytes that print stand for themselves, the others for the
    characters from 256 on, in order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in merges]
    if ids != sorted(ids):
        raise ValueError(f"{path}: ids don't follow the merges")
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)
            and not token.startswith("<|")}


def pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, capacity: int = CAPACITY, key: str = "doc_id",
           with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of all pieces of all texts."""
    spark = docs.sparkSession
    L.small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    source = docs.select(F.col(key), F.col("text"))
    schema = T.StructType([*source.select(key).schema, *T.StructType.fromDDL(
        "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            source, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode_to_numpy(text.as_py()) if text.is_valid else np.zeros(0, np.uint32)
                ids = np.append(ids, END).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    source.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64())
                       for c in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(L.released(run), schema)


class Remaining:
    """Counts of pieces by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.counts)

    def take(self, filling: dict[int, int], times: int) -> None:
        for s, k in filling.items():
            self.counts[s] -= k * times
            if not self.counts[s]:
                del self.counts[s]
                self.sizes.pop(bisect_right(self.sizes, s) - 1)

    def largest(self, limit: int) -> int:
        """Place of the largest length up to limit, or -1."""
        return bisect_right(self.sizes, limit) - 1


def best_fit(left: Remaining, room: int, used: dict[int, int]) -> tuple[int, dict[int, int]]:
    """(waste, filling) of always taking the longest piece that fits."""
    filling: dict[int, int] = {}
    i = left.largest(room)
    while i >= 0 and room:
        s = left.sizes[i]
        k = min(room // s, left.counts[s] - used.get(s, 0))
        if k > 0:
            filling[s] = k
            room -= k * s
        i = min(i - 1, left.largest(room))
    return room, filling


def completion(left: Remaining, room: int, used: dict[int, int], nodes: int = NODES) -> dict[int, int]:
    """The filling of the room with the least waste, by branch and bound from the best-fit incumbent."""
    least, incumbent = best_fit(left, room, used)
    if not least:
        return incumbent
    sizes, counts, budget = left.sizes, left.counts, [nodes]
    chosen: dict[int, int] = {}
    state = [least, incumbent]

    def free(s: int) -> int:
        return counts.get(s, 0) - used.get(s, 0) - chosen.get(s, 0)

    total = list(accumulate(s * free(s) for s in sizes))  # of all free pieces up to a length

    def search(rest: int, i: int) -> None:
        """Fills rest with lengths up to the place i: a level for a length, so the depth is bounded by the room (1 + 2 + ...)."""
        budget[0] -= 1
        i = min(i, left.largest(rest))
        if i >= 0 and sizes[i] == rest and free(rest) > 0:  # exact
            state[0], state[1] = 0, chosen | {rest: 1}
            return
        fits = False
        while i >= 0 and state[0] and budget[0] > 0:
            if rest - total[i] >= state[0]:  # all that is left wastes no less than the incumbent
                return
            s = sizes[i]
            k = min(rest // s, free(s))
            fits = fits or k > 0
            while k > 0 and state[0] and budget[0] > 0:
                chosen[s] = k
                search(rest - k * s, i - 1)
                del chosen[s]
                k -= 1
            i -= 1
        if not fits and rest < state[0]:  # nothing more fits: an undominated filling
            state[0], state[1] = rest, dict(chosen)

    search(room, len(sizes) - 1)
    return state[1]


def fillings(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[dict[int, int], int]]:
    """[(filling {length: pieces}, times)] that use up the counts."""
    left, out = Remaining(counts), []
    while left.sizes:
        longest = left.sizes[-1]
        own = {longest: 1}
        rest = capacity - longest
        filling = dict(own)
        for s, k in (completion(left, rest, own, nodes) if rest else {}).items():
            filling[s] = filling.get(s, 0) + k
        times = min(left.counts[s] // k for s, k in filling.items())
        left.take(filling, times)
        out.append((filling, times))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, pieces a sequence, first sequence, offset), ordered: the pieces of a length numbered
    from the first number on fill such a slot in consecutive sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for s, k in sorted(filling.items(), reverse=True):
            rows.append((s, used.get(s, 0), k, sequence, offset))
            used[s] = used.get(s, 0) + k * times
            offset += s * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(rows: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """rows with a gapless number from 0 within their length; long runs of one length are numbered in buckets by hash."""
    buckets = F.array(*(F.lit(max(1, -(-counts.get(s, 0) // BUCKET))) for s in range(1, capacity + 1)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int"))))
    count = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = count.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("rank"))


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    counts = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(fillings(counts, capacity))
    shared = rows.sparkSession.sparkContext.broadcast(table)
    keep = rows.columns
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("sequence_id bigint, offset bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        wide = np.int64(1) << 44
        order = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            s = t[np.searchsorted(order, length * wide + number, "right") - 1] if len(t) else np.zeros((0, 5), np.int64)
            k = number - s[:, 1]
            sequence, offset = s[:, 3] + k // s[:, 2], s[:, 4] + k % s[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return numbered(rows, counts, capacity).select(*keep, "number").mapInArrow(L.released(run), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    import public_tokenizers as P

    ranks = byte_level_ranks(path or P.path("byte_bpe_50k.json"))
    return packed(stored(pieces(docs, ranks, P.PATTERN, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
