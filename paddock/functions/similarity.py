"""Ratcliff-Obershelp similarity (``difflib.SequenceMatcher.ratio``) on Spark.

Two Arrow-batched pandas UDFs, both small per-row helpers:

* ``name_ratio(a, b)``: the exact ratio, computed on lower-cased text.
* ``char_tokens(name)``: the name as a set of (char, k-th occurrence)
  tokens, for the exact prefix-filtering similarity join in ``operators.fuzzy``.

Why prefix filtering is exact here. ``ratio = 2M / (|a| + |b|)`` where M is the
total size of the matching blocks. The matched characters form a common
subsequence, so M is at most the multiset overlap of the two strings' characters.
Write each string as the *set* of tokens (char, k-th occurrence); multiset
overlap equals set overlap. ``ratio >= t`` needs ``M >= t(|a|+|b|)/2`` and,
since ``M <= min(|a|,|b|)``, a partner length of at least ``t/(2-t) * |a|``;
hence every match of ``a`` overlaps it in at least ``ceil(t/(2-t) * |a|)``
tokens. Under any fixed global token order, two sets overlapping in >= o
tokens share a token among their first ``|x| - o + 1`` tokens. So joining on
shared prefix tokens finds every pair with ratio >= t, and the exact ratio then
removes the false candidates. No pair list is ever enumerated per group.
"""

from __future__ import annotations

import difflib
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_TOKEN = "\u0000empty"


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def min_overlap(n: int, threshold: float) -> int:
    """Smallest character overlap any partner with ratio >= threshold can have."""
    p, d = overlap_fraction(threshold)
    return -(-p * n // d)


def overlap_fraction(threshold: float) -> tuple[int, int]:
    """(p, d) with min_overlap(n) = ceil(p * n / d), for exact integer arithmetic."""
    t = Fraction(math.floor(Fraction(threshold) * 10_000), 10_000)  # down: a lower bound loses no pair
    f = t / (2 - t)
    return f.numerator, f.denominator


def char_tokens(name: str) -> list[str]:
    s = name.lower()
    if not s:
        return [EMPTY_TOKEN]
    seen: dict[str, int] = {}
    toks = []
    for ch in s:
        k = seen.get(ch, 0) + 1
        seen[ch] = k
        toks.append(f"{ch}\u0001{k}")
    return toks


def prefix_of(name: str, threshold: float, rank: dict[str, int]) -> list[str]:
    """Reference (driver-free) form of the Spark prefix: rarest-first under ``rank``."""
    toks = sorted(char_tokens(name), key=lambda t: (rank.get(t, 0), t))
    n = len(name)
    return toks[:max(n - min_overlap(n, threshold) + 1, 1)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def char_tokens_udf(names: pd.Series) -> pd.Series:
    return names.map(lambda s: char_tokens(s if isinstance(s, str) else ""))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.str.lower(), b.str.lower())],
                     dtype="float64")
