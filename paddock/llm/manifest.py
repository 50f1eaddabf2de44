"""Merkle manifest of a dataset with one inclusion witness a document.

Leaves are ordered by source and id, and each source is cut into aligned blocks of FAN^HEIGHT leaves: a block is a whole
subtree of the source's tree (the last one may be ragged), so that blocks are built apart from each other. Inside a block the
leaves are appended as a stream (``Stream``): every level holds one open run of at most FAN nodes with the partial witnesses
below it; a node that completes a run extends all of them by its siblings and the run's digest is appended one level up. The
roots of the blocks are a sequence again, appended in blocks of the same kind, until a source has one node, its subroot;
the subroots in the order of their sources are one more such sequence, up to the root.

Spark does the ordering (range partitions of narrow rows: id and digest), the numbering (row places inside range partitions
plus the counts before them), and the blocks (one task group of at most FAN^HEIGHT rows). Documents are read once, for their
digests; witnesses (about 1 KB a level) are made where they are used and are never shuffled or stored. The driver sees one
count a level.

A leaf is the digest of its five columns, nulls included. Rows with equal ids are ordered by their leaves; equal rows are
leaves of their own with witnesses of their own. A null id comes first and is never tampered with. A null source is a source
of its own, before all others. An empty table gives no rows. Columns other than the five are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.store import stored
from paddock.packaging import ship_package

FAN, HEIGHT = 16, 3   # children of a node; levels of a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Stream:
    """The right edge of a growing tree: aligned appends, with the witnesses of the leaves it is asked to keep.

    ``paths[i]`` is the witness of the i-th leaf: for each level up to the last closed run (text before, text after) of its
    siblings. ``witness=False`` keeps the open runs only.
    """

    def __init__(self, fan: int = FAN, witness: bool = True):
        self.fan, self.witness = fan, witness
        self.open: list[list[tuple[str, list[int]]]] = [[]]
        self.paths: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        self.paths.append([])
        self._add(0, leaf, [len(self.paths) - 1] if self.witness else [])

    def _add(self, level: int, node: str, below: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for k, (_, below) in enumerate(run):
            if below:
                step = ("".join(nodes[:k]), "".join(nodes[k + 1:]))
                for leaf in below:
                    self.paths[leaf].append(step)
        self._add(level + 1, digest("".join(nodes)), [i for _, below in run for i in below])

    def finish(self, levels: int) -> str:
        """Closes the open runs below ``levels`` and returns the node there."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._close(level)
        return self.open[levels][0][0]


def levels_of(n: int, fan: int = FAN) -> int:
    """Levels until n nodes have become one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def value(c: str) -> Column:
    """A column as an input of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    text = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*columns.values()), 256)


def leaves(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """key (of the source), doc_id, leaf, changed (leaf with the text ``tamper`` where ``tampered`` holds, else null)."""
    values = {c: value(c) for c in COLUMNS}
    touched = docs.select(*COLUMNS, F.when(tampered, tamper).alias("touched"), tampered.alias("hit"))
    other = F.coalesce(F.concat(F.octet_length("touched").cast("string"), F.lit(":"), F.col("touched")), F.lit("-"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # "n" sorts before every "s..."
    return touched.select(key.alias("key"), "doc_id", F.unhex(hashed(values)).alias("leaf"),
                          F.when(F.col("hit"), F.unhex(hashed({**values, "text": other}))).alias("changed"))


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with their place in the order of (key, *order), from 0 in each key, and the key's count n.

    Rows are dealt by ranges, so a large key lies in many partitions; each keeps its rows' places, and the counts of a
    key in the partitions before it are added.
    """
    order = [F.col("key").asc(), *(F.col(c).asc_nulls_first() for c in order)]
    rows = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = rows.groupBy("key", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    by_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("__n").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(by_key).alias("n"))
    return (rows.withColumn("__part", part).join(starts, ["key", "__part"])
            .withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift"))


def block_of(place: Column, fan: int = FAN, height: int = HEIGHT) -> Column:
    return F.floor(place / F.lit(fan ** height)).cast("long")


def _levels(n: int, fan: int, height: int) -> int:
    """Levels inside a block of a key with n nodes: all of them, or as many as lead to the only node."""
    return height if n > fan ** height else levels_of(n, fan)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("place", "ascending")])


def block_roots(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """(key, place, node) of the blocks of (key, place, n, node): the appended roots of one level of blocks."""
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("node", pa.binary())])

    def one(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        stream = Stream(fan, witness=False)
        for node in rows.column("node").to_pylist():
            stream.append(node.hex())
        root = stream.finish(_levels(rows.column("n")[0].as_py(), fan, height))
        return pa.table([[rows.column("key")[0].as_py()], [rows.column("place")[0].as_py() // fan ** height], [bytes.fromhex(root)]], schema=schema)

    small = nodes.select("key", "place", "n", "node", block_of(F.col("place"), fan, height).alias("block"))
    return small.groupBy("key", "block").applyInArrow(one, "key string, place long, node binary")


STEPS = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def with_paths(nodes: DataFrame, above: DataFrame | None, keep: list[str], fan: int, height: int) -> DataFrame:
    """key, place and ``keep`` of nodes (key, place, n, node), with their witness: first inside their block, then that
    of the block's root, ``above`` (key, place, path, and columns that every node below gets)."""
    kept = ["key", "place", *keep]
    down = [] if above is None else [c for c in above.columns if c not in ("key", "place", "path")]
    schema = nodes.select(*kept).schema.add("path", STEPS)
    for c in down:
        schema = schema.add(above.schema[c])
    rows = nodes.select(*kept, "n", *([] if "node" in keep else ["node"]), block_of(F.col("place"), fan, height).alias("block"))
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def steps(paths: list[list[tuple[str, str]]]) -> pa.Array:
        offsets = [0]
        for p in paths:
            offsets.append(offsets[-1] + len(p))
        flat = [s for p in paths for s in p]
        parts = [pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))

    def run(rows: pa.Table, after: list[tuple[str, str]]) -> pa.Table:
        rows = _sorted(rows)
        stream = Stream(fan)
        for node in rows.column("node").to_pylist():
            stream.append(node.hex())
        stream.finish(_levels(rows.column("n")[0].as_py(), fan, height))
        return rows.select(kept).append_column(pa.field("path", kind), steps([p + after for p in stream.paths]))

    if above is None:
        return rows.groupBy("key", "block").applyInArrow(lambda rows: run(rows, []), schema)

    def both(rows: pa.Table, upper: pa.Table) -> pa.Table:
        out = run(rows, [(s["before"], s["after"]) for s in upper.column("path")[0].as_py()])
        for c in down:
            out = out.append_column(c, pa.repeat(upper.column(c)[0], len(out)))
        return out

    upper = above.select("key", F.col("place").alias("block"), "path", *down)
    return rows.groupBy("key", "block").cogroup(upper.groupBy("key", "block")).applyInArrow(both, schema)


def sequence_trees(nodes: DataFrame, fan: int, height: int) -> list[DataFrame]:
    """nodes (key, place, n, node) and, level for level, the roots of their blocks, until every key has one node.

    One level for up to fan^height nodes of a key; the loop looks at one count a level.
    """
    levels = [nodes]
    while True:
        roots = block_roots(levels[-1], fan, height)
        roots = stored(roots, "manifest-roots")
        n = roots.groupBy("key").agg(F.count("*").alias("n"))
        levels.append(roots.join(n, "key"))
        if not levels[-1].where("n > 1").limit(1).count():
            return levels


def witnesses(docs: DataFrame, tampered: Column, tamper: Column, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, changed, subroot, root and path of every row of docs.

    ``path`` is the inclusion witness: for each level up to the root the hex digests of the siblings before and after.
    ``changed`` is the leaf of the tampered row, null where ``tampered`` doesn't hold.
    """
    ship_package(docs.sparkSession)
    made = stored(leaves(docs, tampered, tamper).withColumnRenamed("leaf", "node"), "manifest-leaves")
    nodes = stored(numbered(made, ["doc_id", "node"], "manifest-ordered"), "manifest-numbered")
    levels = sequence_trees(nodes, fan, height)
    # the subroots, one a source, are one more sequence
    subroots = levels[-1].select(F.lit("all").alias("key"), F.col("key").alias("source_key"), "node")
    tops = sequence_trees(stored(numbered(subroots, ["source_key"], "manifest-subroots"), "manifest-sources"), fan, height)
    top = tops[-1].first()  # one row, or none of an empty table
    root = F.lit(None if top is None else bytes(top["node"]).hex()).cast("string")
    path = None
    for level in reversed(tops[1:-1]):
        path = with_paths(level, path, [], fan, height)
    tops_path = with_paths(tops[0], path, ["source_key", "node"], fan, height)
    sources = stored(tops_path.select(F.col("source_key").alias("key"), F.lit(0).cast("long").alias("place"), "path",
                                      F.lower(F.hex("node")).alias("subroot")), "manifest-sources-done")
    path = sources
    for level in reversed(levels[1:-1]):
        path = stored(with_paths(level, path, [], fan, height), "manifest-paths")
    out = with_paths(nodes, path, ["doc_id", "node", "changed"], fan, height)
    return out.select("doc_id", F.lower(F.hex("node")).alias("leaf"), F.lower(F.hex("changed")).alias("changed"), "subroot",
                      root.alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = witnesses(spark.read.parquet(f"{sf_dir}/documents.parquet"), hit, F.translate("text", UPPER, LOWER))
    proof = F.sha2(F.concat_ws("", F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"])))), 256)
    back = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
