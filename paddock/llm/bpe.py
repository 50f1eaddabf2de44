"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

Texts are split by the vocabulary's pattern in Arrow batches; a block of about BLOCK_BYTES of text becomes one row with its
distinct words and, for every text, the places of its words in that list. In the JVM each distinct word starts as its bytes'
ids and is folded: the adjacent pair of the lowest rank merges, the leftmost first, until no pair has a rank. The ranks are
a literal of the plan: the rows of a table (left id, right id, merged id), each displaced so that none shares a slot with
another; a pair takes one look-up, and so do the two bytes it begins with. It is bounded by the vocabulary. Decoding
concatenates the binary pieces of a word's ids. A last Arrow step puts the words' ids and bytes back in text order. Texts are
not shuffled, and memory is bounded by the block.

The words that repeat in a bounded sample of texts (``DICTIONARY_ROWS``, ``DICTIONARY_WORDS``) are folded once beforehand, in the
same way, and broadcast; blocks then fold only the words beyond them. Results don't depend on the sample.

The fold takes time that grows with the square of a word's length, so words beyond LONG bytes (unbroken runs of letters,
digits or signs) are merged by a heap with the same ranks in the Arrow step.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Repeated rows are encoded equally, an empty
table gives no rows, and columns other than those kept are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import learn as L
from paddock.llm import text as T

BLOCK_BYTES = 4 << 20
DICTIONARY_ROWS = 20_000
DICTIONARY_WORDS = 300_000
DICTIONARY_TEXT = 1 << 16  # bytes of a sampled text at most
LONG = 96
FAST = 0x24F          # the last code point of Latin Extended-B
SLOTS = 1 << 19       # of the rank table at first
NONE = 131_071
TRIES = 1 << 16       # displacements of a row before the table grows


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Places(dict):
    """The place of a word among the distinct words, in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def displaced(rows: dict[int, list[tuple[int, int]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin of every row, slots): the value v of row a at column b < width is in slot begin[a] + b, as (a + 1) << 17 | v,
    and no other row has that slot. Free slots are 0. The largest rows are placed first; the table grows if one finds no room."""
    size = SLOTS
    while True:
        rng = np.random.RandomState(size)
        begins, slots = np.zeros(width, np.int64), np.zeros(size + width, np.int64)
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            columns, tried = np.array([b for b, _ in row]), 0
            while tried < TRIES:
                offered = rng.randint(0, size, 16 if len(row) < 8 else 256)
                fits = (slots[offered[:, None] + columns] == 0).all(1)
                if fits.any():
                    break
                tried += len(offered)
            else:
                break
            begins[a] = offered[fits.argmax()]
            slots[begins[a] + columns] = (a + 1) << 17 | np.array([v for _, v in row])
        else:
            return begins, slots
        size *= 2


def literal(values: np.ndarray) -> str:
    return f"from_json('[{','.join(map(str, values.tolist()))}]', 'array<bigint>')"


class Table:
    """The rank table of a vocabulary as SQL literals: pairs of ids, first pairs of bytes, pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= (1 << 17) - 1:
            raise ValueError("ids beyond 17 bits")
        self.ranks = ranks
        rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    rows[a].append((b, rank))
        begins, slots = displaced(rows, max(ranks.values()) + 1)
        self.begins, self.slots = literal(begins), literal(slots)
        single = [ranks[bytes([b % 256])] for b in range(-128, 128)]
        ids = np.array(single)
        beside = slots[begins[ids][:, None] + ids] ^ ((ids[:, None] + 1) << 17)
        self.starts = literal(np.concatenate([(beside << 24 | ids[:, None]).ravel(), NONE << 24 | ids]))
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
        self.pieces = f"from_json('{json.dumps(pieces, separators=(',', ':'))}', 'array<binary>')"

    def pair(self, a: str, b: str) -> str:
        """SQL of the id that ids a and b (bigint) merge into, or of some number above NONE."""
        return f"(t[d[{a}] + {b}] ^ shiftleft({a} + 1, 17))"

    def fold(self, w: str) -> str:
        """SQL of the ids left when no neighbours among the bytes w merge any more.

        The state is an array of longs, one for each piece: the id it would merge into with its right neighbour, its
        first byte's place, its own id. The least long is the lowest rank, leftmost first.
        """
        at_end = f"shiftleft({NONE}L, 24)"
        before = f"shiftleft({self.pair('(s[at - 2] & 131071)', 'shiftright(lo, 24)')}, 24) | (s[at - 2] & 16777215)"
        new = f"""if(at + 1 < size(s), shiftleft({self.pair('shiftright(lo, 24)', '(s[at + 1] & 131071)')}, 24), {at_end})
            | (lo & 16646144) | shiftright(lo, 24)"""
        joined = f"""concat(slice(s, 1, greatest(at - 2, 0)), if(at > 1, array({before}, {new}), array({new})),
            slice(s, at + 2, size(s)))"""
        step = f"""transform(array(array_min(s)), lo -> if(lo >= {at_end}, s,
            transform(array(cast(array_position(s, lo) as int)), at -> {joined})[0]))[0]"""
        start = f"""transform({w}, (b, i) -> z[if(i + 1 < size({w}), 32896 + 256 * b + {w}[i + 1], 65664 + b)]
            | shiftleft(cast(i as bigint), 17))"""
        return f"aggregate(sequence(2, greatest(2, size({w}))), {start}, (s, i) -> {step}, s -> transform(s, x -> cast(x & 131071 as int)))"

    def encode(self, words: str) -> str:
        """SQL of array<array<int>>: the ids of each of an array of byte arrays. The tables are bound once, as t, d and z."""
        return (f"transform(array({self.slots}), t -> transform(array({self.begins}), d -> transform(array({self.starts}), z -> "
                f"transform({words}, w -> if(size(w) = 0, cast(array() as array<int>), {self.fold('w')})))[0])[0])[0]")

    def decode(self, ids: str) -> str:
        """SQL of array<binary>: the concatenated pieces of each of an array of id arrays."""
        return (f"transform(array({self.pieces}), q -> transform({ids}, x -> "
                f"aggregate(x, cast('' as binary), (a, i) -> concat(a, q[i]))))[0]")


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of ranked pairs over a linked list, for words too long to fold."""
    piece = [word[i : i + 1] for i in range(len(word))]
    nxt, prev = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(word) and (r := ranks.get(piece[i] + piece[j])) is not None:
            heapq.heappush(heap, (r, i, len(piece[i]), len(piece[j])))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if len(piece[i]) != a or j >= len(word) or len(piece[j]) != b or not piece[j]:
            continue
        piece[i] += piece[j]
        piece[j] = b""
        nxt[i] = nxt[j]
        if nxt[j] < len(word):
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[p] for p in piece if p]


BLOCK = pa.schema([("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()),
                   ("words", pa.list_(pa.list_(pa.int8())))])
BLOCK_SQL = "keys array<bigint>, sizes array<int>, codes binary, words array<array<tinyint>>"


class Dictionary:
    """Words with their ids and decoded bytes, as flat arrays, from Arrow lists of lists."""

    def __init__(self, words: pa.ListArray, ids: pa.ListArray, texts: pa.ListArray):
        self.words, ids, texts = (x.flatten() for x in (words, ids, texts))
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        self.id_ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        data, offsets = T.raw(texts)
        self.texts, self.text_ends = data.copy(), offsets[1:]
        self._places: Places | None = None

    def places(self) -> Places:
        if self._places is None:
            self._places = Places((w.decode(), k) for k, w in enumerate(self.words.to_pylist()))
        return Places(self._places)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}


def byte_lists(words: list[bytes]) -> pa.Array:
    """The words as lists of signed bytes."""
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.int8)))


def dictionary(docs: DataFrame, table: Table, key: str, pattern: str, rows: int = DICTIONARY_ROWS, words: int = DICTIONARY_WORDS) -> Dictionary:
    """The words found twice or more in at most ``rows`` texts (by a hash of their key), the most frequent first, folded."""
    L.small_batches(docs.sparkSession)
    share = min(1_000_000, -(-rows * 1_000_000 // max(1, docs.count())))
    sample = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < share).where(F.octet_length("text") <= DICTIONARY_TEXT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
        found = [(w.encode(), n) for w, n in seen.items()]
        found = [x for x in found if len(x[0]) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), byte_lists([w for w, _ in found]),
                                          pa.array([n for _, n in found], pa.int64())], names=["word", "bytes", "n"])

    found = sample.select("text").limit(rows).mapInArrow(L.released(count), "word binary, bytes array<tinyint>, n bigint")
    found = found.groupBy("word").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")).where("n > 1")
    found = found.orderBy(F.desc("n"), "word").limit(words).select("word", "bytes")
    found = found.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("word", "bytes")).alias("w"))
    found = found.withColumn("ids", F.expr(table.encode("w.bytes"))).withColumn("texts", F.expr(table.decode("ids")))
    got = found.select(F.col("w.word").alias("word"), "ids", "texts").toArrow()
    return Dictionary(*(got.column(c).combine_chunks() for c in range(3)))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of pattern. Texts without code points above FAST go through the standard library's quicker engine, with the
    letters, numbers and spaces as the pattern's own engine has them; classes beyond those go through that engine only."""
    slow = regex.compile(pattern).findall
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ranges[name] = "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(name + "+", "".join(map(chr, range(FAST + 1)))))
    plain = pattern.replace(r"(?!\S)", f"(?![^{ranges[r'\s']}])")
    plain = re.sub(r"\[[^\]]*\]", lambda m: reduce(lambda x, name: x.replace(name, ranges[name]), ranges, m[0]), plain)
    plain = reduce(lambda x, name: x.replace(name, f"[{ranges[name]}]"), ranges, plain)
    if re.search(r"\\[^u]|\(\?[^:!]|[*+?}][+]", plain):
        return slow
    fast, beyond = re.compile(plain).findall, re.compile(f"[^\\x00-\\u{FAST:04x}]").search
    return lambda text: slow(text) if beyond(text) else fast(text)


def blocks(docs: DataFrame, key: str, pattern: str, known: Broadcast, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of texts: their keys, their numbers of words, the words' places, the distinct words beyond the
    known ones (whose places come first)."""
    L.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first = splitter(pattern), len(known.value.words)
        keys, sizes, codes, place, seen = [], [], array("i"), known.value.places(), 0

        def row() -> pa.RecordBatch:
            listed = byte_lists([w.encode() for w in islice(place, first, None)])
            outer = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            return pa.RecordBatch.from_arrays([pa.array([keys], BLOCK.field("keys").type), pa.array([sizes], BLOCK.field("sizes").type),
                                               pa.array([codes.tobytes()], pa.binary()), outer], schema=BLOCK)

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = split(text)
                codes.extend(map(place.__getitem__, found))
                keys.append(k)
                sizes.append(len(found))
                seen += len(text)
                if seen >= block_bytes:
                    yield row()
                    keys, sizes, codes, place, seen = [], [], array("i"), known.value.places(), 0
        if keys:
            yield row()

    return docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(L.released(run), BLOCK_SQL)


def gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The value runs of the codes, one after another."""
    size = sizes[code]
    end = np.cumsum(size)
    if not len(end):
        return values[:0]
    return values[np.repeat(begins[code] - (end - size), size) + np.arange(end[-1])]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", schema: str = "",
            f: Callable[[bytes, bytes], tuple] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The key of every row with what f makes of its ids (little-endian unsigned 32-bit) and its decoded bytes; by
    default ``ids array<int>, decoded binary``. f runs in the tasks, one text at a time."""
    table = Table(ranks)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dictionary(docs, table, key, pattern))
    rows = blocks(docs, key, pattern, known, block_bytes)
    rows = rows.withColumn("ids", F.expr(table.encode(f"transform(words, w -> if(size(w) > {LONG}, slice(w, 1, 0), w))")))
    rows = rows.withColumn("texts", F.expr(table.decode("ids")))
    shared = spark.sparkContext.broadcast(ranks)
    f = f or (lambda ids, text: (np.frombuffer(ids, np.int32).tolist(), text))
    schema = f"{key} bigint, " + (schema or "ids array<int>, decoded binary")
    out = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as types
        target = types.to_arrow_schema(out)
        for batch in batches:
            for b in range(batch.num_rows):
                keys, sizes, codes, words, ids, texts = (c[b] for c in batch.columns)
                own = ids.values.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                own_ends = ids.values.offsets.to_numpy()[1:].astype(np.int64) - ids.values.offsets[0].as_py()
                text, text_offsets = T.raw(texts.values)
                text_ends = text_offsets[1:]
                length = np.diff(words.values.offsets.to_numpy())
                long = np.flatnonzero(length > LONG)
                if len(long):  # merged here, and set in their places
                    id_runs = np.split(own, own_ends[:-1])
                    text_runs = np.split(text, text_ends[:-1])
                    pieces = {v: k for k, v in shared.value.items()}
                    for w in long:
                        made = merged(words.values[int(w)].values.to_numpy().tobytes(), shared.value)
                        id_runs[w] = np.array(made, "<u4")
                        text_runs[w] = np.frombuffer(b"".join(pieces[i] for i in made), np.uint8)
                    own, text = np.concatenate(id_runs), np.concatenate(text_runs)
                    own_ends, text_ends = (np.cumsum([len(r) for r in x]) for x in (id_runs, text_runs))
                d = known.value
                all_ids = np.concatenate([d.ids, own])
                id_ends = np.concatenate([d.id_ends, own_ends + len(d.ids)])
                all_text = np.concatenate([d.texts, text])
                ends = np.concatenate([d.text_ends, text_ends + len(d.texts)])
                code = np.frombuffer(codes.as_buffer(), np.int32)
                made, at = [], 0
                id_runs, text_runs = ((x, np.concatenate([[0], e[:-1]]), np.diff(e, prepend=0)) for x, e in (
                    (all_ids, id_ends), (all_text, ends)))
                for k, n in zip(keys.as_py(), sizes.values.to_numpy()):
                    one = code[at : at + n]
                    at += n
                    made.append((k, *f(gathered(*id_runs, one).tobytes(), gathered(*text_runs, one).tobytes())))
                columns = list(zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target)], schema=target)

    return rows.mapInArrow(L.released(run), out)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    def digest(ids: bytes, text: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_ranks(P.path("byte_bpe_multi_50k.tiktoken")),
                   P.PATTERN, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string", f=digest)
