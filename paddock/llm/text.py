"""Vectorised text kernel used inside Arrow tasks: words, their byte spans and 64-bit hashes.

Everything works on the raw UTF-8 buffers of an Arrow column. Nulls count as empty texts. Memory is bounded by
the Arrow batch: hashing walks the buffer in pieces of about ``PIECE`` bytes, cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

# Separator tables: True where a byte ends a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def of_strings(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return raw(pa.array([t if t is not None else "" for t in texts], pa.string()))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; spans are non-empty, ordered and disjoint."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + PIECE, "right")))
        lo, hi = int(start[a]), int(end[b - 1])
        power, inverse = _power_tables(max(hi - lo, PIECE))
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=c[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (c[e] - c[s]) * inverse[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = False):
    """(start, end, hash, first) of all words: byte spans, hashes, and the index of each text's first word
    (``first`` has one entry more than there are texts)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= cut[:-1]
    start = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= cut[1:]
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, offsets)
    return start, end, span_hash(data, start, end), first


def runs(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside one text, and each window's first word."""
    at = np.arange(max(0, len(values) - n + 1))
    if not len(at):
        return np.zeros(0, np.uint64), at
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[text[at] == text[at + n - 1]]
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + values[at + k]
    return mix(h), at


def text_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values for each of n texts; owner is the text of a value."""
    return np.bincount(owner, weights=values, minlength=n)[:n]


def code_points(data: np.ndarray) -> np.ndarray:
    """For every byte position (and the end) the number of code points before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
