"""Substring dedup by collinear chaining: fuzzy passages that a text shares with an earlier one.

Seeds are k-mers of SEED lower-cased words, thinned by winnowing (the least hash of every WINNOW neighbours), so every exact
run of SEED + WINNOW - 1 words holds one. Each seed found in several texts is joined with its first occurrence (the least
doc_id), never with all others. A run of MIN_WORDS words may have its first holder elsewhere: runs whose seeds are all shared,
but don't lead to one place that holds the whole run, are joined by themselves with their first occurrence, a block of runs at a
time: blocks are cut by content, equal blocks of copies are looked up once. Pairs of texts with one seed are aligned as well, unless the
words around it show that it can't grow to a passage. The matches of two texts are ordered and chained: the best chain to a match adds its words
to the best chain among matches before it in both texts, less a cost for each word of gap, by prefix maxima in a Fenwick
tree. Chains are cut at long gaps and aligned on the whole texts: the matches extended to exact runs, the gaps by longest
common subsequence. A chain is split into its longest stretches of which at least SIMILARITY agree, and where other words
stand between two stretches that are passages by themselves; their ends are extended along the diagonal until the score
drops. A passage is an aligned stretch of MIN_WORDS words or more of which at least SIMILARITY agree.

Of the text that holds a seed first, its first place counts; of later texts all places do, so each copy of a passage is found.
Repeats inside the first text are not passages. Null and empty texts,
and texts of fewer words than a seed, have none. Repeated rows of an id are one text. Rows with a null id are passed over
(``deduplicated`` keeps them unchanged). Other columns are ignored, or kept by ``deduplicated``.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T
from paddock.llm.sieve import bitmap, place_of, sieved
from paddock.llm.store import free_name, stored

SEED = 5
WINNOW = 8
MIN_WORDS = 50
SIMILARITY = 0.8
GAP = 80              # words without a match inside a passage, at most
LEAST_RUN = (MIN_WORDS - SEED + 1) // WINNOW  # picked seeds in an exact run of MIN_WORDS words, at least
GAP_COST = 0.05       # of a word of gap, in matching words
DROP = 8              # of the extension's score (1 for a word that agrees, -2 for one that doesn't) that ends it
BLOCK = 32            # places in a block of exact runs, on average
LONGEST_BLOCK = 64
AROUND = 16           # words on each side of a pair's only seed that decide whether its texts are aligned, less than MIN_WORDS together
PART = 200            # texts that are aligned with one source in one group


def seeds(h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text the thinned seeds, their word places, and links: words to the next seed (0 at the last one), and 28 bits of
    the hash of the words between the two."""
    w, at = T.runs(h, first, SEED)
    lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
    if len(w) >= WINNOW:
        chosen = np.lib.stride_tricks.sliding_window_view(w, WINNOW).argmin(1) + np.arange(len(w) - WINNOW + 1)
    out = []
    for a, b, begin in zip(lo, hi, first[:-1]):
        if b - a >= WINNOW:
            pick = np.unique(chosen[a : b - WINNOW + 1])
        elif b > a:
            pick = np.array([a + w[a:b].argmin()])
        else:
            pick = np.zeros(0, np.int64)
        place = at[pick]
        step = np.append(np.diff(place), 0)[: len(place)]
        between = np.zeros(len(place), np.uint64)
        for k in range(SEED, WINNOW):
            between = T.mix(between + np.where(k < step, h[np.minimum(place + k, len(h) - 1)], np.uint64(0)))
        out.append((w[pick], place - begin, (step << 28) | (between >> np.uint64(36)).astype(np.int64)))
    return out


def seeded(docs: DataFrame) -> DataFrame:
    """(doc_id, seed array<bigint>, place array<bigint>) of every text with an id; a place is the word and, below, the link."""
    L.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, place = [], []
            for _, _, d, o in L.chunks(*T.raw(batch.column(1))):
                _, _, h, first = T.words(d, o, T.SPACE, lower=True)
                for v, p, link in seeds(h, first):
                    value.append(v.view(np.int64))
                    place.append((p << 32) | link)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in (value, place))],
                                             names=["doc_id", "seed", "place"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(L.released(run), "doc_id bigint, seed array<bigint>, place array<bigint>")


def unsettled(place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (first, last) of the words at which a run of MIN_WORDS words may begin that another text holds, from the seeds
    of a text that other texts hold as well. Runs inside of seeds that all lead to one place of one text are left out, as the
    words between agree too: the first text holds the whole run, and its seeds lead there."""
    order = np.argsort(place)
    place, source, source_place = place[order], source[order], source_place[order]
    at, step = place >> 32, (place >> 28) & 15
    linked = (at[1:] == at[:-1] + step[:-1]) & (step[:-1] > 0)
    low = (1 << 32) - 1
    agree = linked & (source[1:] == source[:-1]) & ((source_place[1:] >> 32) == (source_place[:-1] >> 32) + step[:-1]) \
        & ((place[:-1] & low) == (source_place[:-1] & low))

    def ranges(joined: np.ndarray, before: int, after: int) -> np.ndarray:
        begin = np.flatnonzero(np.append(True, ~joined))
        first, last = at[begin] - before, at[np.append(begin[1:] - 1, len(at) - 1)] - after
        change = np.zeros(int(at[-1]) + 3, np.int64)
        fits = (last >= first) & (last >= 0)
        np.add.at(change, np.maximum(first[fits], 0), 1)
        np.add.at(change, last[fits] + 1, -1)
        return np.cumsum(change) > 0

    # the first picked seed of a run is among its first WINNOW 5-grams, the last one among its last
    wanted = ranges(linked, WINNOW - 1, MIN_WORDS - SEED - WINNOW + 1) & ~ranges(agree, 0, MIN_WORDS - SEED)
    edge = np.flatnonzero(np.diff(wanted, prepend=False, append=False))
    return edge[0::2], edge[1::2] - 1


def exact_links(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, source_id, at, from): both ends of every run of MIN_WORDS words whose first holder its seeds may not lead to.

    held has the seeds (doc_id, place, source_id, source_place) that several texts hold. The seeds picked from inside a run
    are the same in all its holders, so a run that two texts hold has only such seeds, without others in between.
    """
    lists = held.groupBy("doc_id").agg(F.collect_set(F.struct("place", "source_id", "source_place")).alias("held"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            place, source, source_place = (flat.field(k).to_numpy() for k in range(3))
            edges = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
            got = [unsettled(place[a:b], source[a:b], source_place[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            keep = np.array([len(g[0]) > 0 for g in got], bool)
            made = [pa.array([g[k].astype(np.int32) for g in got if len(g[0])], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), *made], names=["id", "low", "high"])

    spans = lists.where(F.size("held") >= LEAST_RUN).mapInArrow(L.released(mark), "id bigint, low array<int>, high array<int>")
    spans = stored(spans, "passage-spans")
    rows = sieved(texts, spans.select("id")).join(spans, "id").select("id", "low", "high", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ([], [])
            for k0, _, d, o in L.chunks(*T.raw(batch.column(3))):
                _, _, h, first = T.words(d, o, T.SPACE, lower=True)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    low, high = (batch.column(c)[k0 + k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
                    high = np.minimum(high, b - a - MIN_WORDS)
                    at = np.concatenate([np.arange(u, v + 1) for u, v in zip(low, high)])
                    run = np.zeros(len(at), np.uint64)
                    for j in range(MIN_WORDS if len(at) else 0):
                        run = T.mix(run + h[a + at + j])
                    made[0].append(run.view(np.int64))
                    made[1].append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[0], pa.list_(pa.int64())), pa.array(made[1], pa.list_(pa.int32()))],
                                             names=["doc_id", "run", "at"])

    runs = stored(rows.mapInArrow(L.released(cut), "doc_id bigint, run array<bigint>, at array<int>"), "passage-runs")
    single = runs.select("doc_id", F.explode(F.arrays_zip("run", "at")).alias("r")).select("doc_id", "r.run", "r.at")
    first = single.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.max("doc_id").alias("last"))
    first = stored(first.where("last > head.doc_id").select("run", "head"), "passage-first")
    blocks = stored(run_blocks(runs, first), "passage-blocks")
    kinds = blocks.groupBy("block").agg(F.first("run").alias("run"))  # copies hold the same blocks
    heads = kinds.select("block", F.posexplode("run").alias("k", "run")).join(first, "run")
    heads = heads.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", F.col("head.doc_id").alias("d"), F.col("head.at").alias("a")))).alias("h"))
    follows = "h[{1}].k = h[{0}].k + 1 and h[{1}].d = h[{0}].d and h[{1}].a = h[{0}].a + 1"
    inside = f"i > 0 and i < size(h) - 1 and {follows.format('i - 1', 'i')} and {follows.format('i', 'i + 1')}"
    heads = heads.withColumn("h", F.expr(f"filter(h, (x, i) -> not ({inside}))"))
    found = blocks.select("doc_id", "at", "block").join(heads, "block").select("doc_id", "at", F.explode("h").alias("h")).where("doc_id > h.d")
    ends = F.explode(F.array(F.lit(0), F.lit(MIN_WORDS - SEED))).alias("end")
    found = found.select("doc_id", F.col("h.d").alias("source_id"), (F.col("at") + F.col("h.k")).alias("at"), F.col("h.a").alias("from"), ends)
    return found.select("doc_id", "source_id", (F.col("at") + F.col("end")).alias("at"), (F.col("from") + F.col("end")).alias("from"))


def run_blocks(runs: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, at, block, run): stretches of places where runs begin that several texts may hold (first has all of these, a
    bitmap of them decides here), cut where a run's hash says so, so that copies of a passage are cut alike. block is the
    stretch's hash, at its first place."""
    shared = runs.sparkSession.sparkContext.broadcast(bitmap(first.select("run")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            doc = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            run, at = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            keep = bits[place_of(run)]
            doc, run, at = doc[keep], run[keep], at[keep]
            begin = np.ones(len(run), bool)
            begin[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (run[1:] % BLOCK == 0)
            number = np.arange(len(run))
            begin |= (number - np.maximum.accumulate(np.where(begin, number, 0))) % LONGEST_BLOCK == 0
            start = np.flatnonzero(begin)
            size = np.diff(np.append(start, len(run)))
            block = np.zeros(len(start), np.uint64)
            if len(start):
                offset = (number - np.repeat(start, size)).astype(np.uint64)
                block = T.mix(np.add.reduceat(T.mix(run.view(np.uint64) + T.mix(offset)), start) + size.astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(run)).astype(np.int32)), pa.array(run))
            yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(at[start]), pa.array(block.view(np.int64)), lists],
                                             names=["doc_id", "at", "block", "run"])

    return runs.mapInArrow(L.released(cut), "doc_id bigint, at int, block bigint, run array<bigint>")


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches (x, y), ordered by x: lists of match numbers, cut at gaps beyond GAP."""
    n = len(x)
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree_score, tree_match = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches of one place don't follow each other
            k, best, who = int(rank[j]) - 1, -1e18, -1
            while k > 0:
                if tree_score[k] > best:
                    best, who = tree_score[k], tree_match[k]
                k -= k & -k
            here = GAP_COST * (int(x[j]) + int(y[j]))
            score[j] = float(SEED)
            if who >= 0:
                gain = min(SEED, int(x[j] - x[who]), int(y[j] - y[who]))
                gap = max(0, int(x[j] - x[who]) - SEED) + max(0, int(y[j] - y[who]) - SEED)
                if score[who] - GAP_COST * gap + gain > SEED:
                    score[j], back[j] = score[who] - GAP_COST * gap + gain, who
            j += 1
        for m in range(i, j):
            key, k = score[m] + GAP_COST * (int(x[m]) + int(y[m])), int(rank[m])
            while k <= size:
                if key > tree_score[k]:
                    tree_score[k], tree_match[k] = key, m
                k += k & -k
        i = j
    taken, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -score[m]):
        chain, m = [], end
        while m >= 0 and not taken[m]:
            taken[m] = True
            chain.append(m)
            m = back[m]
        chain.reverse()
        part = chain[:1]
        for a, b in zip(chain, chain[1:]):
            if max(x[b] - x[a], y[b] - y[a]) - SEED > GAP:
                out.append(part)
                part = []
            part.append(b)
        if part:
            out.append(part)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that agree in the best alignment of two short stretches."""
    if len(a) == len(b):
        straight = int((a == b).sum())
        if straight * 5 >= len(a) * 4 or len(a) == 1:
            return straight
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == v)))
    return int(row[-1])


def extension(a: np.ndarray, b: np.ndarray, cost: int = 2) -> tuple[int, int]:
    """(words, words that agree) by which a passage grows over a and b, word by word, until the score drops by DROP."""
    first = DROP // cost + 1
    if not (a[:first] == b[:first]).any() if len(a) >= first <= len(b) else not min(len(a), len(b)):
        return 0, 0  # most ends
    n, block, best, at, score, agree = min(len(a), len(b)), 64, 0, 0, 0, 0
    done, kept = 0, 0
    while done < n:
        same = a[done : done + block][: n - done] == b[done : done + block][: n - done]
        run = score + np.cumsum(np.where(same, 1, -cost))
        high = np.maximum(np.maximum.accumulate(run), best)
        stop = np.flatnonzero(high - run > DROP)
        end = int(stop[0]) if len(stop) else len(run)
        if end and run[:end].max() > best:
            k = int(run[:end].argmax())
            best, at, kept = int(run[k]), done + k + 1, agree + int(same[: k + 1].sum())
        if len(stop):
            break
        score, agree = int(run[-1]), agree + int(same.sum())
        done += len(same)
        block *= 4
    return at, kept


def extensions(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The extensions at both costs; what doesn't grow at the lower one doesn't at the higher one."""
    low = extension(a, b, 2)
    return [low, extension(a, b, 4)] if low[0] else [low]


def leading(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a and b begin with alike."""
    n, at, block = min(len(a), len(b)), 0, 64
    while at < n:
        k = min(block, n - at)
        differ = np.flatnonzero(a[at : at + k] != b[at : at + k])
        if len(differ):
            return at + int(differ[0])
        at += k
        block *= 4
    return n


def exact_runs(own: np.ndarray, source: np.ndarray, x: list[int], y: list[int]) -> np.ndarray:
    """Rows (begin, source begin, words) of the exact runs along a chain's matches, as long as they can be and disjoint."""
    out: list[tuple[int, int, int]] = []
    b = d = 0
    for u, v in zip(x, y):
        skip = max(0, b - u, d - v)
        if skip >= SEED:
            continue
        u, v, words = u + skip, v + skip, SEED - skip
        left = leading(own[b:u][::-1], source[d:v][::-1])
        words += left + leading(own[u + words :], source[v + words :])
        u, v = u - left, v - left
        if out and u == b and v == d:
            out[-1] = (*out[-1][:2], out[-1][2] + words)
        else:
            out.append((u, v, words))
        b, d = u + words, v + words
    return np.array(out, np.int64)


class Aligned:
    """The exact runs of a chain and the gaps between them."""

    def __init__(self, own: np.ndarray, source: np.ndarray, runs: np.ndarray):
        self.a, self.c, self.words = runs.T
        self.b, self.d = self.a + self.words, self.c + self.words
        self.size = np.maximum(self.a[1:] - self.b[:-1], self.c[1:] - self.d[:-1])
        self.same = np.array([common(own[i:j], source[k:m]) for i, j, k, m in zip(self.b, self.a[1:], self.d, self.c[1:])], np.int64)
        self.total = np.cumsum(self.words) + np.concatenate([[0], np.cumsum(self.same)])

    def measure(self, i: int, j):
        """(words, words that agree) from run i to run j, or to each of an array of runs."""
        return np.maximum(self.b[j] - self.a[i], self.d[j] - self.c[i]), self.total[j] - self.total[i] + self.words[i]

    def farthest(self, i: int, last: int) -> int:
        """The last run up to which the stretch from run i agrees enough."""
        words, agree = self.measure(i, np.arange(i, last + 1))
        return i + int(np.flatnonzero(agree >= SIMILARITY * words)[-1])

    def stretches(self) -> list[tuple[int, int]]:
        """(first run, last run) of disjoint stretches that agree enough, the longest one first; together they hold all runs."""
        n = len(self.a)
        if n == 1 or self.farthest(0, n - 1) == n - 1:
            return [(0, n - 1)]
        taken, out = np.zeros(n, bool), []
        heap = []
        for i in range(n):
            j = self.farthest(i, n - 1)
            heap.append((int(self.a[i] - self.b[j]), i, j))
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            if taken[i]:
                continue
            hit = np.flatnonzero(taken[i : j + 1])
            if len(hit):
                j = self.farthest(i, i + int(hit[0]) - 1)
                heapq.heappush(heap, (int(self.a[i] - self.b[j]), i, j))
                continue
            taken[i : j + 1] = True
            out.append((i, j))
        return out

    def parted(self, i: int, j: int) -> list[tuple[int, int]]:
        """The stretch without gaps of other words between two parts that are passages by themselves."""
        if i == j:
            return [(i, j)]
        out, todo = [], [(i, j)]
        while todo:
            i, j = todo.pop()
            for k in i + np.flatnonzero(self.same[i:j] - 2 * (self.size[i:j] - self.same[i:j]) < -DROP):
                (m, p), (n, q) = self.measure(i, k), self.measure(k + 1, j)
                if min(m, n) >= MIN_WORDS and p >= SIMILARITY * m and q >= SIMILARITY * n \
                        and 4 * self.size[k] - 5 * self.same[k] > min(5 * p - 4 * m, 5 * q - 4 * n):
                    todo += [(i, int(k)), (int(k) + 1, j)]
                    break
            else:
                out.append((i, j))
        return out


def passages(own: np.ndarray, source: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(begin, end, source begin, source end, words that agree) of the passages of a text, from its matches with a source."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    out: list[tuple[int, int, int, int, int]] = []
    until = np.zeros(len(own), np.int64)  # the farthest end of the passages that hold a word
    for chain in chains(x, y):
        if until[x[chain[0]]] >= int(x[chain[-1]]) + SEED:
            continue  # a longer passage holds it
        path = Aligned(own, source, exact_runs(own, source, x[chain].tolist(), y[chain].tolist()))
        for i, j in (part for stretch in path.stretches() for part in path.parted(*stretch)):
            a, b, c, d = (int(v) for v in (path.a[i], path.b[j], path.c[i], path.d[j]))
            if until[a] >= b:
                continue
            agree = int(path.measure(i, j)[1])
            # an end that agrees less must not spoil the whole: then only as far as it agrees as much as a passage
            left, right = (extensions(p, q) for p, q in ((own[:a][::-1], source[:c][::-1]), (own[b:], source[d:])))
            for (m, plus), (n, more) in sorted(itertools.product(left, right), key=lambda e: -e[0][0] - e[1][0]):
                words = max(b - a, d - c) + m + n
                if b - a + m + n >= MIN_WORDS and agree + plus + more >= SIMILARITY * words:
                    out.append((a - m, b + n, c - m, d + n, agree + plus + more))
                    until[a - m : b + n] = np.maximum(until[a - m : b + n], b + n)
                    break
    return out


def around(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(id, at, left, right, lefts, rights): four bits of each of the AROUND words before and after the seeds at places (id, at)
    of the texts, the nearest word lowest, and the numbers of these words."""
    lists = stored(places.groupBy("id").agg(F.collect_set("at").alias("places")), "passage-places")
    rows = sieved(texts, lists.select("id")).join(lists, "id").select("id", "places", "text")
    names = ["id", "at", "left", "right", "lefts", "rights"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64)
            size = batch.column(1).value_lengths().to_numpy()
            edge = np.append(0, np.cumsum(size))
            for k0, _, d, o in L.chunks(*T.raw(batch.column(2))):
                _, _, h, first = T.words(d, o, T.SPACE, lower=True)
                n = len(first) - 1
                row, at = np.repeat(np.arange(n), size[k0 : k0 + n]), flat[edge[k0] : edge[k0 + n]]
                fits = at + SEED <= first[row + 1] - first[row]   # another text under a repeated id
                row, at = row[fits], at[fits]
                bits = np.append(h >> np.uint64(60), np.uint64(0))
                begin, end = first[row] + at, first[row] + at + SEED
                lefts, rights = np.minimum(at, AROUND), np.minimum(first[row + 1] - end, AROUND)
                left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for k in range(AROUND):
                    left |= np.where(k < lefts, bits[np.maximum(begin - 1 - k, 0)], np.uint64(0)) << np.uint64(4 * k)
                    right |= np.where(k < rights, bits[np.minimum(end + k, len(h))], np.uint64(0)) << np.uint64(4 * k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k0 + row]), pa.array(at.astype(np.int32)),
                                                  pa.array(left.view(np.int64)), pa.array(right.view(np.int64)),
                                                  *(pa.array(v.astype(np.int8)) for v in (lefts, rights))], names=names)

    return stored(rows.mapInArrow(L.released(cut), "id bigint, at int, left bigint, right bigint, lefts tinyint, rights tinyint"), "passage-around")


def goes_on(a: np.ndarray, b: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether an extension over AROUND words (four bits of each) may go beyond them: equal bits of other words only raise its score."""
    differ = a.view(np.uint64) ^ b.view(np.uint64)
    same = np.stack([(differ >> np.uint64(4 * k)) & np.uint64(15) == 0 for k in range(AROUND)], 1)
    score = np.cumsum(np.where(same, 1, -2), 1)
    high = np.maximum(np.maximum.accumulate(score, 1), 0)
    return (words == AROUND) & ~(high - score > DROP).any(1)


def grown(single: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with one seed (doc_id, source_id, matches) whose seed may grow to a passage, so that their texts have to be aligned.

    A seed whose extensions both end within AROUND words is no passage: those need no texts. None that is one goes missing.
    """
    one = single.select("doc_id", "source_id", F.col("matches")[0]["at"].alias("at"), F.col("matches")[0]["from"].alias("from"))
    near = around(texts, one.select(F.explode(F.array(F.struct(F.col("doc_id").alias("id"), "at"), F.struct(
        F.col("source_id").alias("id"), F.col("from").alias("at")))).alias("p")).select("p.*"))
    sides = ("left", "right", "lefts", "rights")
    own = near.select(F.col("id").alias("doc_id"), "at", *[F.col(c).alias(f"own_{c}") for c in sides])
    other = near.select(F.col("id").alias("source_id"), F.col("at").alias("from"), *[F.col(c).alias(f"source_{c}") for c in sides])
    both = one.join(own, ["doc_id", "at"]).join(other, ["source_id", "from"]).select(
        "doc_id", "source_id", "at", "from", *[f"{t}_{c}" for c in sides for t in ("own", "source")])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch.column(k).to_numpy() for k in range(4, 12)]
            keep = goes_on(v[0], v[1], np.minimum(v[4], v[5])) | goes_on(v[2], v[3], np.minimum(v[6], v[7]))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["doc_id", "source_id", "at", "from"]).filter(pa.array(keep))

    kept = both.mapInArrow(L.released(decide), "doc_id bigint, source_id bigint, at int, from int").distinct()
    return kept.select("doc_id", "source_id", F.array(F.struct("at", "from")).alias("matches"))


FOUND = ("doc_id bigint, source_id bigint, start_word bigint, end_word bigint, source_start_word bigint, source_end_word bigint, "
         "agreeing bigint, start bigint, end bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """One row for each passage that a text shares with an earlier one (FOUND): words and code points, ends exclusive."""
    table = stored(seeded(docs), "passage-seeds")
    entries = table.select("doc_id", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("doc_id", "s.seed", "s.place")
    lists = entries.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("head"), F.max("doc_id").alias("last"))
    lists = lists.where("last > head.doc_id").select("seed", "head")
    held = entries.join(lists, "seed").select("doc_id", "place", F.col("head.doc_id").alias("source_id"), F.col("head.place").alias("source_place"))
    held = stored(held, "passage-held")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    matches = held.where("doc_id > source_id").select("doc_id", "source_id", F.shiftright("place", 32).cast("int").alias("at"),
                                                      F.shiftright("source_place", 32).cast("int").alias("from"))
    pairs = (matches.unionByName(exact_links(texts, held)).groupBy("doc_id", "source_id")
             .agg(F.collect_set(F.struct("at", "from")).alias("matches")))
    pairs = stored(pairs, "passage-pairs")
    pairs = pairs.where(F.size("matches") > 1).unionByName(grown(pairs.where(F.size("matches") == 1), texts))
    pairs = stored(pairs, "passage-matches")
    many = pairs.groupBy("source_id").agg(F.count("*").alias("members"))
    dealt = pairs.join(many, "source_id").withColumn("part", F.expr(f"pmod(xxhash64(doc_id), cast(ceil(members / {PART}D) as int))"))
    texts = sieved(texts, pairs.select(F.explode(F.array("doc_id", "source_id")).alias("id")))
    members = dealt.select("source_id", "part", F.col("doc_id").alias("id"), F.lit(1).alias("member"),
                           F.col("matches.at").alias("x"), F.col("matches.from").alias("y"))
    heads = dealt.select("source_id", "part").distinct().select("source_id", "part", F.col("source_id").alias("id"), F.lit(0).alias("member"),
                                                                 F.array().cast("array<int>").alias("x"), F.array().cast("array<int>").alias("y"))
    rows = members.unionByName(heads).join(texts, "id").select("source_id", "part", "member", "id", "x", "y", "text")
    rows = rows.repartition("source_id", "part").sortWithinPartitions("source_id", "part", "member")
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, words = None, None
        for batch in batches:
            source_id, member, ids = (batch.column(c).to_numpy() for c in (0, 2, 3))
            out = []
            for k0, _, d, o in L.chunks(*T.raw(batch.column(6))):
                start, end, h, first = T.words(d, o, T.SPACE, lower=True)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    r = k0 + k
                    if not member[r]:
                        source, words = source_id[r], h[a:b].copy()
                        continue
                    if source != source_id[r]:
                        continue
                    x, y = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5))
                    fits = (x + SEED <= b - a) & (y + SEED <= len(words))  # another text under a repeated id
                    if not fits.any():
                        continue
                    found = passages(h[a:b], words, x[fits], y[fits])
                    if found:
                        points = T.code_points(d[o[k] : o[k + 1]])
                        for s, e, p, q, agree in found:
                            out.append((ids[r], source, s, e, p, q, agree, points[start[a + s] - o[k]], points[end[a + e - 1] - o[k]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(len(names))], names=names)

    return rows.mapInArrow(L.released(run), FOUND).dropDuplicates(["doc_id", "source_id", "start", "end"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the passages of earlier texts: what is left of each text, joined where a passage is cut out. A text
    that nothing is left of (no word) goes."""
    name = free_name(docs.columns, "__cuts")
    cuts = repeated(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(name))
    rest = f"""aggregate(`{name}`, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out',
        if(x.start > s.at, concat(s.out, substring(text, cast(s.at as int) + 1, cast(x.start - s.at as int))), s.out)),
        s -> concat(s.out, substring(text, cast(s.at as int) + 1, 2147483647)))"""
    out = docs.join(cuts, "doc_id", "left").select(*docs.columns, name)
    cut = F.col(name).isNotNull()
    out = out.withColumn("text", F.when(cut, F.expr(rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(name)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
