"""Sale analytics.

Statistics are computed for *groups of sales*: a group is one sale (sale
detail), a set of fuzzy-matched prior-year sales (prior-year block) or one year
of a sale's history. A single sale's statistics are aggregates over its lots. Groups of several
sales are merged from summaries: one row a sale (counts, sums, moments, extremes, bands, its ten
highest prices) and one row a (sale, price); ``membership`` rows (group..., sale_id) say which sales a group pools, so lots
are read and reduced once however many groups a sale is in.

Scale notes: a sale can hold a third of all lots, so every statistic is
partial-aggregating (sums, min/max, ``var_pop``, ``percentile`` maps of prices) and
the top-10 uses a ``row_number() <= 10`` filter, which Spark turns into a
map-side ``WindowGroupLimit`` (each map task keeps its local top 10 per group
before the shuffle). Only the parts that the asked columns need are planned. How the membership table
(pairs of sales) is joined is left to the measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock import settings as S
from paddock.functions.rounding import py_round, py_round_of, truthy_round
from paddock.operators.lots import not_withdrawn, upcoming_label
from paddock.settings import Settings

def _sold(c_price="price", c_wd="is_withdrawn", c_pi="is_passed_in") -> Column:
    return (F.col(c_price) > 0) & not_withdrawn(F.col(c_wd)) & not_withdrawn(F.col(c_pi))


def _sold_price() -> Column:
    return F.when(_sold(), F.col("price"))


def lot_stats_aggs() -> list[Column]:
    """Total, withdrawn, passed-in (not withdrawn), sold; all lot types."""
    return [
        F.count(F.lit(1)).alias("total_lots"),
        F.sum(F.when(F.col("is_withdrawn") == 1, 1).otherwise(0)).cast("long").alias("withdrawn_count"),
        F.sum(F.when(not_withdrawn(F.col("is_withdrawn")) & (F.col("is_passed_in") == 1), 1).otherwise(0))
         .cast("long").alias("passed_in_count"),
        F.sum(F.when(_sold(), 1).otherwise(0)).cast("long").alias("sold_count"),
    ]


def _bands() -> list[tuple[str, float | None, float | None]]:
    edges = S.PRICE_BAND_EDGES
    return list(zip(BAND_COLS, [None, *edges], [*edges, None]))


def price_aggs() -> list[Column]:
    """Gross, average, extremes, bands and moments of the sold prices."""
    p = _sold_price()
    out = [
        F.sum(F.coalesce(p, F.lit(0.0))).alias("_gross"),
        F.avg(p).alias("_avg"),
        F.min(p).alias("_min"),
        F.max(p).alias("_max"),
        F.stddev_samp(p).alias("_std"),
    ]
    for name, lo, hi in _bands():
        cond = p.isNotNull()
        if lo is not None:
            cond = cond & (p >= lo)
        if hi is not None:
            cond = cond & (p < hi)
        out.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name))
    return out


BAND_COLS = ["under_50k", "band_50k_100k", "band_100k_200k", "band_200k_500k", "band_500k_1m", "over_1m"]
COUNT_COLS = ["total_lots", "sold_count", "passed_in_count", "withdrawn_count"]
QUARTILES = {"q1_price": 0, "median_price": 1, "q3_price": 2}
STAT_COLS = [*COUNT_COLS, "clearance_rate", "gross", "avg_price", *QUARTILES, "min_price", "max_price", "top10_avg", "std_dev", *BAND_COLS]
TOP = 10


def highest(rows: DataFrame, group_cols: list[str]) -> DataFrame:
    """L2: the (at most ten) highest sold prices of each group, ``_top`` in falling order."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("price").desc())
    top = rows.where(_sold()).select(*group_cols, "price").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= TOP)
    return top.groupBy(*group_cols).agg(F.sort_array(F.collect_list("price"), asc=False).alias("_top"))


def top10_avg() -> Column:
    """Mean of the highest prices."""
    return F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top")


def _aggregated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The statistics of each sale, unrounded, from its lots."""
    aggs = [*lot_stats_aggs(), *price_aggs()]
    if set(columns) & set(QUARTILES):
        aggs.append(F.percentile(_sold_price(), [0.25, 0.5, 0.75]).alias("_q"))
    g = rows.groupBy("sale_id").agg(*aggs)
    if "top10_avg" in columns:
        g = g.join(highest(rows, ["sale_id"]), "sale_id", "left").withColumn("_top10", top10_avg())
    return g


def sale_summary(lot_rows: DataFrame, columns: list[str] = tuple(STAT_COLS)) -> DataFrame:
    """One mergeable row a sale: counts, sums, extremes, bands, ``_mean`` and ``_m2`` of the sold prices, highest prices."""
    rows = lot_rows.select("sale_id", "price", "is_withdrawn", "is_passed_in")
    p = _sold_price()
    g = rows.groupBy("sale_id").agg(*lot_stats_aggs(), *price_aggs(), (F.var_pop(p) * F.count(p)).alias("_m2"))
    return g.join(highest(rows, ["sale_id"]), "sale_id", "left") if "top10_avg" in columns else g


def exact_price_stats(lot_rows: DataFrame) -> DataFrame:
    """A13 over decimal prices: gross, average (whole cents, half up), extremes of each sale's sold prices, all exact.
    Sales without a sold lot have a gross of 0 and no average or extremes."""
    p = F.when(_sold(), F.col("price").cast("decimal(12,2)"))
    g = lot_rows.groupBy("sale_id").agg(F.sum(p).alias("_sum"), F.count(p).alias("_n"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))
    cents = F.expr("(2 * cast(_sum * 100 as decimal(30,0)) + _n) div (2 * _n)")
    return g.select("sale_id", F.col("_n").alias("sold_count"), F.coalesce("_sum", F.lit(0).cast("decimal(22,2)")).alias("gross"),
                    F.when(F.col("_n") > 0, (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")).alias("avg_price"),
                    "min_price", "max_price")


def price_counts(lot_rows: DataFrame) -> DataFrame:
    """(sale_id, price, n): how often each sold price of a sale comes."""
    return lot_rows.where(_sold()).groupBy("sale_id", "price").agg(F.count("*").alias("n"))


def _merged(lot_rows: DataFrame, membership: DataFrame, group_cols: list[str], columns: list[str]) -> DataFrame:
    """The statistics of each group of sales, unrounded, from the summaries of its members; zeros where none has lots."""
    members = membership.select(*group_cols, "sale_id").distinct()
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in [*COUNT_COLS, *BAND_COLS]]
    own = members.join(sale_summary(lot_rows, columns), "sale_id", "left")
    parts = F.collect_list(F.when(F.col("sold_count") > 0, F.struct("sold_count", "_avg", "_m2")))   # one a member
    g = own.groupBy(*group_cols).agg(*sums, F.sum("_gross").alias("_gross"), F.min("_min").alias("_min"), F.max("_max").alias("_max"),
                                     *([parts.alias("_parts")] if "std_dev" in columns else []),
                                     *([F.flatten(F.collect_list("_top")).alias("_tops")] if "top10_avg" in columns else []))
    g = g.withColumn("_avg", F.col("_gross") / F.nullif(F.col("sold_count"), F.lit(0)))
    if "std_dev" in columns:
        spread = F.aggregate("_parts", F.lit(0.0), lambda a, s: a + s["_m2"] + s["sold_count"] * (s["_avg"] - F.col("_avg")) * (s["_avg"] - F.col("_avg")))
        g = g.withColumn("_std", F.when(F.col("sold_count") > 1, F.sqrt(spread / (F.col("sold_count") - 1))))
    if "top10_avg" in columns:
        g = g.withColumn("_top", F.slice(F.sort_array("_tops", asc=False), 1, TOP))
        g = g.withColumn("_top10", F.when(F.size("_top") > 0, top10_avg()))
    if set(columns) & set(QUARTILES):
        q = members.join(price_counts(lot_rows), "sale_id").groupBy(*group_cols).agg(
            F.percentile("price", [0.25, 0.5, 0.75], F.col("n")).alias("_q"))
        g = g.join(q, group_cols, "left")
    return g


def sale_stats(lot_rows: DataFrame, membership: DataFrame | None = None,
               group_cols: list[str] = ("sale_id",), every: DataFrame | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """A11-A16 for each group: lot counts, clearance, price block (NULL when nothing sold).

    Rounding follows the source: Python ``round`` (half-even on the binary
    value), and a zero gross/avg/... becomes NULL. ``every`` holds sales (one row
    each) that get a row of zeros when they have no lots; with a membership, its groups do.
    ``columns`` are the statistics wanted (all of STAT_COLS without it).
    """
    group_cols, columns = list(group_cols), list(columns or STAT_COLS)
    if membership is not None:
        g = _merged(lot_rows, membership, group_cols, columns)
    else:
        g = _aggregated(lot_rows.select("sale_id", "price", "is_withdrawn", "is_passed_in"), columns)
        if every is not None:
            g = every.select("sale_id").join(g, "sale_id", "left").fillna(0, COUNT_COLS)
    eligible = F.col("total_lots") - F.col("withdrawn_count")
    has = F.col("sold_count") > 0
    g = g.withColumn("_clearance", F.when(eligible > 0, F.lit(100.0) * F.col("sold_count") / eligible))
    if set(columns) & set(QUARTILES):
        g = g.withColumns({f"_{c}": F.col("_q")[i] for c, i in QUARTILES.items()})

    def shown(c: str) -> Column:
        if c in COUNT_COLS:
            return F.col(c)
        if c == "clearance_rate":
            return py_round_of("_clearance", 1).alias(c)
        if c in BAND_COLS:
            return F.when(has, F.col(c)).alias(c)
        if c in QUARTILES:
            return F.when(has, truthy_round(f"_{c}", 2)).alias(c)
        source = {"gross": "_gross", "avg_price": "_avg", "min_price": "_min", "max_price": "_max", "top10_avg": "_top10", "std_dev": "_std"}
        return F.when(has, truthy_round(source[c], 2)).alias(c)

    return g.select(*group_cols, *[shown(c) for c in columns])


def sale_books(lot_rows: DataFrame) -> DataFrame:
    """A20 + P8: lots per (book, day); NULL/0 book shows as 1 *after* grouping."""
    g = lot_rows.groupBy("sale_id", "book_number", "day_number").agg(F.count(F.lit(1)).alias("lot_count"))
    b = F.col("book_number")
    return g.select("sale_id", F.when(b.isNull() | (b == 0), 1).otherwise(b).alias("book_number"),
                    "day_number", "lot_count")


def lot_counts(lot_rows: DataFrame) -> DataFrame:
    """Lot count per sale, all lots."""
    return lot_rows.groupBy("sale_id").agg(F.count(F.lit(1)).alias("lot_count"))


def sale_search(q: str, sales: DataFrame, companies: DataFrame, countries: DataFrame, currencies: DataFrame,
                lot_rows: DataFrame, settings: Settings, limit: int = 20) -> DataFrame:
    """P6 + P7 + A21 + L1: name or company contains ``q`` (case-insensitive), newest first, top ``limit``.

    ``%`` and ``_`` inside ``q`` act as wildcards, as in the source's LIKE.
    """
    if len(q) < 3:
        raise ValueError("search text must have at least 3 characters")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    pat = f"%{q}%"
    s = (sales.join(countries, "country_id").join(companies, "company_id")
         .join(currencies, "currency_id", "left")
         .where(F.col("sale_name").ilike(pat) | F.col("company_name").ilike(pat)))
    top = s.orderBy(F.col("start_date").desc(), F.col("sale_id").desc()).limit(limit)
    # count lots of the chosen sales only: at most ``limit`` (<= 100) ids, a proven broadcast bound
    chosen = lot_rows.join(F.broadcast(top.select("sale_id")), "sale_id", "left_semi")
    return (top.join(lot_counts(chosen), "sale_id", "left")
            .select("sale_id", "sale_name", F.col("start_date").alias("sale_date"), "country_code",
                    "currency_code", F.col("company_name").alias("sale_company"),
                    F.coalesce(F.col("lot_count"), F.lit(0)).alias("lot_count"),
                    upcoming_label(F.col("start_date"), settings).alias("status"))
            .orderBy(F.col("sale_date").desc(), F.col("sale_id").desc()))


def queue_stats(sales: DataFrame, queue: DataFrame) -> DataFrame:
    """Report-queue counts per sale; NULL counts in a queue row -> 0, no queue row -> NULL block."""
    j = sales.select("sale_id").join(queue.withColumn("_has", F.lit(True)), "sale_id", "left")
    has = F.col("_has").isNotNull()
    return j.select(
        "sale_id",
        *[F.when(has, F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
          for c in ("completed", "in_queue", "failed", "postponed")],
        F.date_format("last_completed", "yyyy-MM-dd HH:mm:ss").alias("last_completed"))


def sale_listing(base: DataFrame) -> DataFrame:
    """Sales available in the feature rows, with their lot counts."""
    return base.groupBy("sale_id", "sale_name", "sale_year").agg(F.count(F.lit(1)).alias("lots"))


def median_history(features: DataFrame, name_pattern: str) -> DataFrame:
    """Distinct (year, name, session median) of sales whose name matches a LIKE pattern."""
    return (features.where(F.col("sale_name").like(name_pattern))
            .select("sale_year", "sale_name", "session_median_price").distinct())


# The documented book ranges (lot 1-980 -> book 1, lot >= 981 -> book 2).
BOOK_RANGES = [(1, 980, 1), (981, None, 2)]


def assign_books(lots: DataFrame, ranges: list[tuple[int, int | None, int]] = BOOK_RANGES) -> DataFrame:
    """Book number from lot-number ranges; lots outside every range keep theirs."""
    expr = None
    for lo, hi, book in ranges:
        cond = F.col("lot_number") >= lo
        if hi is not None:
            cond = cond & (F.col("lot_number") <= hi)
        expr = F.when(cond, F.lit(book)) if expr is None else expr.when(cond, F.lit(book))
    return lots.select("lot_id", "sale_id", "lot_number", F.col("book_number").alias("book_number_before"),
                       expr.otherwise(F.col("book_number")).alias("book_number"))


def lot_type_volume(lots: DataFrame, settings: Settings) -> DataFrame:
    """Volume by lot type and by lot type x country with ROLLUP subtotals."""
    since = lots.where(F.col("sale_date") >= F.make_date(F.lit(settings.year_start), F.lit(1), F.lit(1)))
    sold = F.when(_sold(), 1).otherwise(0)
    g = since.rollup("lot_type", "country_code").agg(
        F.count(F.lit(1)).alias("total_lots"), F.sum(sold).cast("long").alias("sold_lots"),
        F.grouping_id().cast("int").alias("grouping_level"))
    return g.withColumn("clearance_pct",
                        py_round(F.lit(100.0) * F.col("sold_lots") / F.col("total_lots"), 1))


YOY_STATS = ["gross", "avg_price", "median_price", "sold_count", "clearance_rate"]


def yoy_change(cur: DataFrame, prior: DataFrame, key: str = "sale_id") -> DataFrame:
    """Year-over-year block from two already-rounded stat rows joined on ``key``.

    Present only when both sides have a price block (sold > 0 on both).
    """
    c = cur.select(key, *[F.col(x).alias(f"c_{x}") for x in YOY_STATS])
    p = prior.select(key, *[F.col(x).alias(f"p_{x}") for x in YOY_STATS])
    j = c.join(p, key)

    def pct(name):
        a, b = F.col(f"c_{name}"), F.col(f"p_{name}")
        return F.when(a.isNotNull() & (a != 0) & b.isNotNull() & (b > 0),
                      py_round(F.lit(100.0) * (a - b) / b, 1))

    both = (F.col("c_sold_count") > 0) & (F.col("p_sold_count") > 0)
    cs, ps = F.col("c_sold_count"), F.col("p_sold_count")
    cc, pc = F.col("c_clearance_rate"), F.col("p_clearance_rate")
    return j.select(
        key,
        F.when(both, pct("gross")).alias("gross_pct"),
        F.when(both, pct("avg_price")).alias("avg_price_pct"),
        F.when(both, pct("median_price")).alias("median_price_pct"),
        F.when(both & (cs != 0) & (ps != 0), cs - ps).alias("sold_count_change"),
        F.when(both & cc.isNotNull() & pc.isNotNull(), py_round(cc - pc, 1)).alias("clearance_rate_change"),
        both.alias("has_yoy"),
    )
