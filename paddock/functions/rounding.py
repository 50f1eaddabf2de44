"""Rounding rules as Column expressions.

Three different roundings appear in the source semantics and they disagree on
ties, so each has its own name:

* ``np_round(x, d)``   numpy's ``np.round``: scale by 10**d, round half to even
  on the scaled binary value (``rint``), scale back. Used by feature code.
* ``py_round(x, d)``   Python's ``round``: half-even on the exact binary value
  (``bround`` ties on the decimal text instead: 2.675 is below the tie, 2.45 above
  it). Used by sale statistics and summaries.
* ``price_round(x)``   ``np.round(x, -2)``: nearest hundred, via ``rint``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(x: Column, digits: int) -> Column:
    if digits >= 0:
        f = float(10 ** digits)
        return F.rint(x * F.lit(f)) / F.lit(f)
    f = float(10 ** (-digits))
    return F.rint(x / F.lit(f)) * F.lit(f)


def price_round(x: Column) -> Column:
    return np_round(x, -2)


def py_round(x: Column, digits: int) -> Column:
    """The scaled value p = x * 10**d is rounded to a double, so it can fall on a tie
    k + 1/2 that x * 10**d misses. Rounding is monotonic, so only then the exact product
    matters, and its sign beside p is that of the product's error term (two-product by
    splitting both factors into halves of 26 bits)."""
    x = x.cast("double")
    f = float(10 ** digits)
    split = F.lit(134217729.0)                       # 2**27 + 1
    high = split * x - (split * x - x)
    f_high = 134217729.0 * f - (134217729.0 * f - f)
    low, f_low = x - high, f - f_high
    p = x * F.lit(f)
    error = ((high * F.lit(f_high) - p) + high * F.lit(f_low) + low * F.lit(f_high)) + low * F.lit(f_low)
    floor = F.floor(p).cast("double")
    tie = (p - floor == F.lit(0.5)) & (error != 0)
    whole = F.when(tie, F.when(error > 0, floor + 1).otherwise(floor)).otherwise(F.rint(p))
    return F.when(F.abs(p) < F.lit(2.0 ** 52), whole / F.lit(f) + F.lit(0.0)).otherwise(x)


def py_round_of(name: str, digits: int) -> Column:
    """``py_round`` of a double column by its name: the same formula as one SQL text, which is planned much faster."""
    f = float(10 ** digits)
    f_high = 134217729.0 * f - (134217729.0 * f - f)
    high = f"(134217729D * {name} - (134217729D * {name} - {name}))"
    low, p = f"({name} - {high})", f"({name} * {f!r}D)"
    error = f"((({high} * {f_high!r}D - {p}) + {high} * {f - f_high!r}D + {low} * {f_high!r}D) + {low} * {f - f_high!r}D)"
    tie = f"{p} - cast(floor({p}) as double) = 0.5D AND {error} <> 0"
    whole = f"CASE WHEN {tie} THEN cast(floor({p}) as double) + CASE WHEN {error} > 0 THEN 1D ELSE 0D END ELSE rint({p}) END"
    return F.expr(f"CASE WHEN abs({p}) < {2.0 ** 52!r}D THEN ({whole}) / {f!r}D + 0D ELSE {name} END")


def truthy_round(x: Column | str, digits: int) -> Column:
    """``round(v, d) if v else None``: zero and NULL both become NULL. A name stands for its double column."""
    column, rounded = (F.col(x), py_round_of(x, digits)) if isinstance(x, str) else (x, py_round(x, digits))
    return F.when(column.isNotNull() & (column != 0), rounded)


def pct_rate(num: Column, den: Column, digits: int = 1, *, numpy_style: bool = True) -> Column:
    """``round(100.0 * num / den, digits)`` or NULL when ``den`` is not positive."""
    raw = F.lit(100.0) * num.cast("double") / den.cast("double")
    r = np_round(raw, digits) if numpy_style else py_round(raw, digits)
    return F.when(den > 0, r)
