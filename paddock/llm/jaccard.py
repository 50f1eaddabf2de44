"""N-gram Jaccard join with set-relation skipping: every pair of texts whose shingle sets are similar enough is linked.

A set's shingles are ordered by a corpus-wide order, rare ones first, so two sets that qualify share one of their first
few (the prefix). The order is by a sketch, counters over all texts' shingles, then the hash; any common order is exact, the
counts only keep index lists short. There are 2**COUNTERS counters at every size; the more shingles share one, the less
rare ones stand out and the longer lists get. Sets are skipped by their relations at two levels:

* index lists hold (size, position) of a shingle in its sets; a pair is skipped when even full agreement after the two
  positions, or the sizes alone, can't reach the overlap that is needed;
* answers come from a highly similar set: the members of long lists (more than SHORT) are first compared with leaders, in
  rounds: sets of small classes with members of the largest ones. Members linked to a leader are of its class already, and
  two sets with known overlaps to one leader need no comparison when the bounds min(o) + min(n - o) < needed (skipped) or
  o + o' - n(leader) >= needed (linked) decide. Of all lists only sets still in different classes are paired.

So classes are whole (no link between different classes is lost) while the pairs inside a class are not enumerated.
Comparisons read both whole texts again, grouped by leader in parts of about PART members.

Null and empty texts (no words) have empty sets, linked with nothing. Equal sets are linked without comparison; repeated
rows of one id count as one. A null id keeps its row, with its class null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T
from paddock.llm.components import components
from paddock.llm.sieve import divided, sieved
from paddock.llm.store import stored

COUNTERS = 22         # bits of the sketch: 2**22 counters, 16 MB at every size
MERGED = 32           # sketches that reach the driver, one after another, at most
SHORT = 8             # members of a list that is paired without leaders, at most
LEADERS = 8           # of a list in a round
TRIES = 3             # leaders that a set is compared with in a round, and one more
ROUNDS = 3            # of leaders, at most
PAIRS = 4             # pairs still apart for each member of the long lists that need no further round
PART = 200            # members that are compared with a leader in one group


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text. Texts of fewer words are one shingle, without words none."""
    _, _, h, first = T.words(data, offsets, T.SPACE, lower=True)
    w, at = T.runs(h, first, words)
    lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
    out = []
    for a, b, x, y in zip(lo, hi, first[:-1], first[1:]):
        if b > a:
            out.append(np.unique(w[a:b]))
        elif y > x:
            whole = np.uint64(y - x)
            for v in h[x:y]:
                whole = T.mix(np.array([whole ^ v], np.uint64))[0] + np.uint64(1)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def counter(shingle: np.ndarray, bits: int) -> np.ndarray:
    return (shingle >> np.uint64(64 - bits)).astype(np.int64)


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many texts' shingles fall on each of 2**COUNTERS counters, over all texts (int32, full counters stay full)."""
    full = np.iinfo(np.int32).max

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pa.compress(total, "zstd", asbytes=True)], pa.binary())], names=["counts"])

    def unpacked(row: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(bytes(row), 4 << COUNTERS, "zstd", asbytes=True), np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int32)
        for batch in batches:
            for _, _, d, o in L.chunks(*T.raw(batch.column(0))):
                sets = shingles(d, o, words)
                if sets:
                    at, n = np.unique(counter(np.concatenate(sets), COUNTERS), return_counts=True)
                    total[at] = np.minimum(total[at] + n, full)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int32)
        for batch in batches:
            for row in batch.column(0):
                total += np.minimum(unpacked(row.as_py()), full - total)
        yield packed(total)

    wide = max(MERGED, docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.select("text").coalesce(wide)  # a task sends one sketch, so tasks are as many as the cores
    sketches = texts.mapInArrow(L.released(count), "counts binary")
    if texts.rdd.getNumPartitions() > MERGED:
        sketches = sketches.repartition(8).mapInArrow(L.released(add), "counts binary")
    total = np.zeros(1 << COUNTERS, np.int32)
    for row in sketches.toLocalIterator():
        total += np.minimum(unpacked(row["counts"]), full - total)
    return total


def needed(a: int, b: int, percent: int) -> str:
    """SQL of the least overlap of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}D - 1e-9) as bigint)"


def index(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, prefix): set size, 128-bit signature, and the first shingles in the corpus order."""
    L.small_batches(docs.sparkSession)
    counts = frequencies(docs, words)
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig, prefix = [], [], []
            for _, _, d, o in L.chunks(*T.raw(batch.column(1))):
                for s in shingles(d, o, words):
                    size.append(len(s))
                    two = np.array([T.mix(s).sum(dtype=np.uint64), T.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)])
                    sig.append(two.tobytes() if len(s) else None)
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    prefix.append(s[np.lexsort((s, order.value[counter(s, COUNTERS)]))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.binary()),
                                              pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(L.released(run), "doc_id bigint, n bigint, sig binary, prefix array<bigint>")


def compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, overlap) of pairs (a, b) of ids, from the whole texts (id, text)."""
    many = pairs.groupBy("a").agg(F.count("*").alias("members"))
    pairs = pairs.join(many, "a").withColumn("part", F.expr(f"pmod(xxhash64(b), cast(ceil(members / {PART}D) as int))"))
    members = pairs.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("member"))
    leaders = pairs.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"), F.lit(0).alias("member"))
    rows = members.unionByName(leaders).join(texts, "id").select("a", "part", "member", "id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            a, member, ids = (batch.column(c).to_numpy() for c in (0, 2, 3))
            out, k = [], 0
            for _, _, d, o in L.chunks(*T.raw(batch.column(4))):
                for s in shingles(d, o, words):
                    if not member[k]:
                        leader, own = a[k], s
                    elif leader == a[k] and len(own) and len(s):
                        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        out.append((a[k], ids[k], int((own[at] == s).sum())))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
                                             names=["a", "b", "overlap"])

    return rows.mapInArrow(L.released(run), "a bigint, b bigint, overlap bigint")


def lists_of(reps: DataFrame) -> DataFrame:
    """(token, id, n, pos, len) of the entries of every index list with several members; len is the list's."""
    entries = reps.select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("id"), "n")
    entries = entries.select("token", "id", F.expr("shiftleft(n, 32) | pos").alias("at"))  # lists are shuffled once, in small rows
    entries = entries.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("len > 1")
    return entries.select("token", "id", F.shiftright("at", 32).alias("n"), F.expr("cast(at & 4294967295 as int)").alias("pos"), "len")


def possible(x: str, y: str, percent: int) -> str:
    """SQL: neither the sizes nor the positions of a shared shingle rule out the overlap that is needed."""
    return (f"least({x}n, {y}n) * 100 >= {percent} * greatest({x}n, {y}n) and "
            f"least({x}n - {x}pos, {y}n - {y}pos) >= {needed(f'{x}n', f'{y}n', percent)}")


def classed(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """entries with root and members: the least id and the number of sets of the class that a set is in so far."""
    if found is None:
        return entries.select("*", F.col("id").alias("root"), F.lit(1).cast("bigint").alias("members"))
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    out = entries.join(found.join(size, "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return out.withColumn("members", F.coalesce("members", F.lit(1).cast("bigint")))


def led(entries: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(compared, classes): pairs (a, b, overlap, na, nb) of leaders and members of long lists, and (id, root) by their links.

    In each round every list has up to LEADERS leaders, of its largest classes so far, with few rarer shingles. A set of
    another class is compared with the TRIES it shares most shingles with, and with the first by a hash, which the sets of
    one group have in common.
    Rounds end when the pairs that are still apart in a list are as few as its members (PAIRS for each), or after ROUNDS.
    """
    rounds: list[DataFrame] = []
    links: list[DataFrame] = []
    found = None
    for r in range(ROUNDS):
        now = classed(entries, found)
        by_root = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
        left = by_root.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.expr("k * k")).alias("same")).where("same < k * k")
        left = stored(left.select("token", F.expr("(k * k - same) / 2").alias("pairs"), "k"), "jaccard-mixed")
        total = left.agg(F.sum("pairs").alias("pairs"), F.sum("k").alias("k")).first()
        if total["pairs"] is None or total["pairs"] <= PAIRS * total["k"]:
            break
        now = now.join(left.select("token"), "token").withColumn("h", F.xxhash64("root", F.lit(r)))
        chosen = now.groupBy("token", F.pmod(F.xxhash64("id", F.lit(r)), F.lit(LEADERS)).alias("bucket")).agg(
            F.min(F.struct(-F.col("members"), "pos", "h", "id", "n", "root", "members")).alias("l"))
        stars = now.join(chosen, "token").where("root != l.root and l.members >= members")
        stars = stars.where(possible("", "l.", percent)).groupBy("id", F.col("l.id").alias("a")).agg(
            F.count(F.lit(1)).alias("shared"), F.first("l.h").alias("h"), F.first("n").alias("nb"), F.first("l.n").alias("na"))
        best = stars.groupBy("id").agg(F.expr(f"slice(sort_array(collect_list(struct(shared, h, a, na, nb)), false), 1, {TRIES})").alias("most"),
                                       F.min(F.struct("h", "shared", "a", "na", "nb")).alias("first"))
        best = best.select("id", F.explode(F.expr("""array_distinct(concat(transform(most, m -> struct(m.a as a, m.na as na, m.nb as nb)),
            array(struct(first.a as a, first.na as na, first.nb as nb))))""")).alias("p"))
        best = stored(best.select("p.a", F.col("id").alias("b"), "p.na", "p.nb"), "jaccard-led")
        pairs = compared(best.select("a", "b"), texts, words).dropDuplicates(["a", "b"]).join(best, ["a", "b"])
        rounds.append(stored(pairs.select("a", "b", "overlap", "na", "nb"), "jaccard-compared"))
        new = rounds[-1].where(f"overlap >= {needed('na', 'nb', percent)}").select("a", "b")
        links.append(new if found is None else new.unionByName(found.select(F.col("root").alias("a"), F.col("id").alias("b"))))
        found = stored(components(links[-1]), "jaccard-found")
    if not rounds:
        return None, None
    return reduce(DataFrame.unionByName, rounds).dropDuplicates(["a", "b"]), found


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; component_id is the least doc_id linked with the row's."""
    table = stored(index(docs, words, percent), "jaccard-index")
    sized = table.where("doc_id is not null and n > 0")
    # equal sets are one set from here on, under their least id
    same = stored(sized.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")),
                  "jaccard-sets")
    copies = sized.select("doc_id", "sig").join(same.where("rows > 1"), "sig").where("doc_id != rep").select("doc_id")
    copies = stored(copies.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").distinct(), "jaccard-copies")
    some, rest = divided(sized.select("doc_id", "n", "prefix"), copies)  # most are no copies, and needn't be shuffled
    reps = some.join(copies, "doc_id", "left_anti").unionByName(rest)
    entries = stored(lists_of(reps), "jaccard-lists")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")

    # level one: sets of long lists with leaders
    long = entries.where(f"len > {SHORT}").drop("len")
    first, found = led(long, stored(sieved(texts, long.select("id")), "jaccard-texts"), words, percent)

    # level two: pairs of one list that are still apart, unless the overlaps with a common leader decide
    apart = classed(entries.drop("len"), found)
    if first is None:
        apart = apart.withColumn("leads", F.expr("cast(array() as array<struct<lead: bigint, o: bigint, l: bigint>>)"))
    else:
        lead = F.struct(F.col("a").alias("lead"), F.col("overlap").alias("o"), F.col("na").alias("l"))
        own = first.select(F.col("a").alias("id"), F.struct(F.col("a").alias("lead"), F.col("na").alias("o"), F.col("na").alias("l")).alias("x"))
        known = first.select(F.col("b").alias("id"), lead.alias("x")).unionByName(own).groupBy("id").agg(F.collect_set("x").alias("leads"))
        apart = apart.join(known, "id", "left").withColumn("leads", F.coalesce("leads", F.expr("cast(array() as array<struct<lead: bigint, o: bigint, l: bigint>>)")))
    mixed = apart.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token")
    apart = apart.join(mixed, "token").select("token", F.struct("id", "n", "pos", "root", "leads").alias("x"))
    # sets with a leader in common meet only if their overlaps with it leave room; a set and its leader have met
    need = needed("x.n", "y.n", percent)
    room = f"exists(x.leads, p -> exists(y.leads, q -> p.lead = q.lead and least(p.o, q.o) + least(x.n - p.o, y.n - q.o) < {need}))"
    # two sets that qualify also meet at the first shingle they share, where their places leave room for the rest
    pairs = apart.join(apart.withColumnRenamed("x", "y"), "token").where(
        f"x.id < y.id and x.root != y.root and {possible('x.', 'y.', percent)} and not {room}")
    certain = f"exists(x.leads, p -> exists(y.leads, q -> p.lead = q.lead and p.o + q.o - p.l >= {need}))"
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
                         F.expr(certain).alias("certain")).distinct()
    pairs = stored(pairs.select("a", "b", "na", "nb", "certain"), "jaccard-apart")
    open_ = pairs.where("not certain").select("a", "b")
    second = compared(open_, sieved(texts, open_.select(F.explode(F.array("a", "b")).alias("id"))), words)
    second = second.dropDuplicates(["a", "b"]).join(pairs, ["a", "b"])
    more = second.where(f"overlap >= {needed('na', 'nb', percent)}").select("a", "b").unionByName(pairs.where("certain").select("a", "b"))
    if found is not None:
        more = more.unionByName(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
    final = components(stored(more, "jaccard-more"))
    root = same.select("sig", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    root = root.select("sig", F.coalesce("root", "rep").alias("component_id"))
    out = table.select("doc_id", "n", "sig").join(root, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Rows without an id, and without words, stay."""
    found = stored(classes(docs, words, percent).select("doc_id", "component_id").where("doc_id is not null"), "jaccard-classes")
    others = found.where("component_id != doc_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rows = docs.where("doc_id is not null").select("doc_id", *[c for c in docs.columns if c != "doc_id"])
    some, rest = divided(rows, others.unionByName(again))  # most rows are neither, and needn't be shuffled
    out = some.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id"]).unionByName(rest)
    return out.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
