"""Sharding by longest-processing-time scheduling: documents into shards of near equal bytes, equal texts together.

Groups of equal texts are ranked by their bytes and go, largest first, to the least-loaded shard through a heap. Groups
above 1/LARGE of all bytes (at most LARGE of them) are scheduled first, as one list. The others are dealt by hash into
parts of about PART groups; each part is scheduled by its own heap, which begins with the part's share of the load the
large groups left, so that the parts fill the shards evenly together.

A null text is an empty one of size 1. Rows with equal texts, also repeated rows, share a shard; every row has a slot of
its own. An empty table gives no rows. Columns other than doc_id and text are ignored. A group larger than a shard's
fair share stays whole and fills its shard alone.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.store import stored
from paddock.packaging import ship_package

SHARDS = 16
LARGE = 1024          # a group above this share of all bytes is scheduled on the driver
PART = 4000           # groups that one heap schedules
BUCKET = 20_000       # rows that one task numbers


def least_loaded(sizes: list[int], loads: list[float], turn: int = 0) -> list[int]:
    """Shard of each size (given largest first): always the least loaded, ties by shard number from ``turn`` on."""
    n = len(loads)
    heap = [(load, (s - turn) % n, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, tie, s = heap[0]
        out.append(s)
        heapq.heapreplace(heap, (load + size, tie, s))
    return out


def schedule(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) of all groups (key, bytes)."""
    spark = groups.sparkSession
    ship_package(spark)
    total = groups.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return groups.select("key", F.lit(0).alias("shard"))
    border = total["b"] / LARGE
    large = groups.where(F.col("bytes") > border).orderBy(F.desc("bytes"), "key").collect()  # fewer than LARGE rows
    loads = [0.0] * shards
    placed = []
    for r, s in zip(large, least_loaded([r["bytes"] for r in large], loads)):
        loads[s] += r["bytes"]
        placed.append((bytes(r["key"]), s))
    small_total = max(1, total["b"] - int(sum(loads)))
    parts = max(1, -(-total["n"] // PART))

    def one_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True])
        share = float(rows["bytes"].sum()) / small_total
        rows["shard"] = least_loaded(rows["bytes"].tolist(), [x * share for x in loads], int(key[0]) % shards)
        return rows[["key", "shard"]]

    small = groups.where(F.col("bytes") <= border).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    out = small.groupBy("part").applyInPandas(one_part, "key binary, shard int")
    return out.unionByName(spark.createDataFrame(placed, "key binary, shard int")) if placed else out


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows with a gapless slot from 0 in each shard. Rows of a shard are numbered in buckets by hash, each bucket after
    the ones before it, so that no task holds a whole shard."""
    buckets = max(1, -(-n_rows // BUCKET)) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    count = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = count.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return (ranked.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("rank")).cast("long"))
            .drop("bucket", "rank", "start"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       F.unhex(F.sha2(body, 256)).alias("key"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = stored(rows.join(schedule(groups, shards), "key").drop("key"), "shard-placed")
    return numbered(placed, rows.count())


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
