"""Session medians and their fallback chain.

Medians are exact (``percentile`` interpolates like PERCENTILE_CONT and pandas'
``median``) and partial-aggregating: a sale with millions of lots is reduced
map-side to a value->count map before the shuffle, so no single task ever holds
a sale's lots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.lots import yearling_history


def sold_price():
    return F.when((F.col("sold_flag") == 1) & (F.col("price") > 0), F.col("price"))


def median_by(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys..., ``_m``: the exact median of value, NULL where a group has none. Equal values of a group are counted
    map-side, so that the map of a group is filled from its distinct values."""
    counts = rows.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5), F.col("_c")).alias("_m"))


def session_median(base: DataFrame) -> DataFrame:
    """Median sold price per sale over the lots being scored; NULL if none sold."""
    return median_by(base, ["sale_id"], sold_price()).withColumnRenamed("_m", "session_median_price")


def prior_year_median(lots: DataFrame, lot_type: str = "Yearling") -> DataFrame:
    """Median of the same sale *name* one year earlier (any company, country or year range).

    Output row (sale_name, sale_year) carries the median of (sale_name, sale_year - 1);
    a zero median counts as missing.
    """
    g = median_by(yearling_history(lots, lot_type), ["sale_name", "sale_year"], sold_price()).withColumnRenamed("_m", "m")
    return g.select("sale_name", (F.col("sale_year") + 1).alias("sale_year"),
                    F.when(F.col("m") != 0, F.col("m")).alias("prior_year_median"))


def session_median_final(base: DataFrame, lots: DataFrame, overrides: DataFrame | None = None,
                         use_prior_year: bool = True, lot_type: str = "Yearling") -> DataFrame:
    """A10 + P16: override -> own median -> prior-year same-name median -> NULL.

    One row per sale in ``base``; ``overrides`` is (sale_id, session_median_override).
    """
    sales = base.select("sale_id", "sale_name", "sale_year").distinct()
    own = session_median(base).withColumnRenamed("session_median_price", "session_median_own")
    out = sales.join(own, "sale_id", "left")
    if use_prior_year:
        out = out.join(prior_year_median(lots, lot_type), ["sale_name", "sale_year"], "left")
    else:
        out = out.withColumn("prior_year_median", F.lit(None).cast("double"))
    if overrides is not None:
        out = out.join(overrides.select("sale_id", "session_median_override"), "sale_id", "left")
    else:
        out = out.withColumn("session_median_override", F.lit(None).cast("double"))
    final = F.coalesce("session_median_override", "session_median_own", "prior_year_median")
    source = (F.when(F.col("session_median_override").isNotNull(), "override")
              .when(F.col("session_median_own").isNotNull(), "sale")
              .when(F.col("prior_year_median").isNotNull(), "prior_year"))
    return out.select("sale_id", "session_median_own", "prior_year_median", "session_median_override",
                      final.alias("session_median_price"), source.alias("median_source"))
