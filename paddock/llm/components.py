"""Connected components of an edge table, by alternating large and small stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.store import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the least id of its component, itself included.

    Loops, repeated and reversed edges, and nulls (left out) do no harm; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    state = _state(now)
    while state != before:
        before = state
        # large star: the larger neighbours of a node point to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and itself, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = stored(small, "stars")
        state = _state(now)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
