"""Point-in-time track-record features.

For every (country, key, as-of date) the features read only history dated in
``[as_of - n months, as_of)`` (sire, vendor) or ``(-inf, as_of)`` (dam): a lot
never sees its own sale day or anything later.

No spine row is ever joined to the history of its window. History and probes of a key meet in one
date-ordered run, and a window is the difference of two running sums:

1. **Probes**: distinct (country, key, as_of) of the lots being featurised, with the first day of each window.
2. **History**: every lot with its sold / passed-in counts goes to the countries that look back at it (config-sized
   join) as it is: few lots of a key share a day and a price, so that counting them first would only deal them twice.
3. Both are dealt by (country, key), once. In each run of sorted rows (``windows``) the counts of a window are
   differences of running sums. The middle prices come from halving the sorted prices again and again: each
   half has a running sum of its rows by date, so that the sold count of a window in the lower half is again a
   difference of two sums, and each probe goes on in the half that holds its rank. That is
   (rows + probes) x log2(prices) steps, whatever the length of the windows.
4. Probes without history come out of the same pass with zero counts and NULL medians: no second spine.

**Crowded keys.** The rows of step 2 of one key are bounded by ``HOT_ROWS``. Keys with more lots (at most all
lots / HOT_ROWS of them) take two looks: the first one ranks price bins instead of prices (``BINS`` an octave,
counted map-side, so dates x a few hundred rows), which gives the counts and the bin and the place in it of each
middle price; the second one is dealt by (country, key, bin) and reads only that bin, counted by date and price.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock import settings as S
from paddock.functions.rounding import np_round
from paddock.packaging import ship_package

KEYS = ("sire_id", "dam_id", "vendor_id")
HOT_ROWS = 1_000_000  # lots of one key from which on its prices are ranked in two looks
BINS = 16             # price bins an octave of the first look
CHUNK = 1 << 18       # sorted rows that a task ranks at once (one key at least)
ALWAYS = -(1 << 23)   # first day of a window without a lower bound


def spine(lots: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys per (country, as-of date)."""
    return (lots.where(F.col(key).isNotNull())
            .select("country_code", key, F.col("sale_date").alias("as_of"))
            .distinct())


def hot_keys(history: DataFrame, keys: tuple[str, ...] = KEYS, rows: int = HOT_ROWS) -> DataFrame:
    """(kind, key) of the keys with more than ``rows`` lots of history: at most len(keys) x lots / rows rows."""
    out = None
    for k in keys:
        crowded = (history.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("long").alias("key")).agg(F.count("*").alias("n"))
                   .where(F.col("n") > rows).select(F.lit(k).alias("kind"), "key"))
        out = crowded if out is None else out.unionByName(crowded)
    return out


def recent(history: DataFrame, since_year: int | None) -> DataFrame:
    """History of the years from ``since_year`` on: prunes the partitions of a year-partitioned table."""
    return history if since_year is None or "sale_year" not in history.columns else history.where(F.col("sale_year") >= since_year)


# ---------------------------------------------------------------- windows over sorted runs

def kth(value: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, place among its equals) of the k-th smallest (from 0) of rows a..b, each row counting ``weight`` times.

    The rows are split by one bit of their value's rank after another; running sums of the lower half say in which half a
    rank lies. k must be below the weight of its range.
    """
    levels, code = np.unique(value, return_inverse=True)
    at = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(0, len(levels) - 1).bit_length())):
        low = (code >> bit) & 1 == 0
        rows = np.concatenate([[0], np.cumsum(low)])
        held = np.concatenate([[0], np.cumsum(np.where(low, weight, 0))])
        below = held[b] - held[a]
        down = k < below
        k = np.where(down, k, k - below)
        ra, rb = rows[a], rows[b]
        a, b = np.where(down, ra, rows[-1] + a - ra), np.where(down, rb, rows[-1] + b - rb)
        at = 2 * at + ~down
        order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        code, weight = code[order], weight[order]
    return levels[at], k


def _numbers(t: pa.Table, name: str, dtype, null=0) -> np.ndarray:
    column = t.column(name)
    return (column.fill_null(null) if column.null_count else column).to_numpy().astype(dtype, copy=False)


def _groups(t: pa.Table, by: list[str]) -> np.ndarray:
    """Number of the run of equal ``by`` that each row of a sorted table is in."""
    new = np.zeros(len(t), bool)
    for name in by:
        column = t.column(name).combine_chunks()
        codes = (column.dictionary_encode().indices if pa.types.is_string(column.type) else column).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of about CHUNK rows of sorted batches, cut between groups."""
    held, rows, enough = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= enough:
            t = pa.Table.from_batches(held)
            group = _groups(t, by)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield t.slice(0, cut)
                held, rows, enough = t.slice(cut).to_batches(), rows - cut, CHUNK
            else:
                enough *= 2
    if rows:
        yield pa.Table.from_batches(held)


def windows(events: DataFrame, by: list[str], n: int, ranked: bool = False) -> DataFrame:
    """The counts and middle prices of the ``n`` windows of every probe.

    ``events`` holds history rows (by, day, value, sold, passed) and probes (by, day, from0, from1, ..., probe), a
    window being the days from ``from_i`` to the day before ``day``. Adds for each window i sold_i, passed_i and, of the two
    middle prices, the values low_i, high_i and the places among equal values low_at_i, high_at_i. With ``ranked`` a
    probe has one window and its column ``rank`` is the place that is looked for (in low_0).
    """
    ship_package(events.sparkSession)
    schema = T.StructType([events.schema[c] for c in by] + [T.StructField("day", T.IntegerType()), T.StructField("slot", T.IntegerType())])
    for i in range(n):
        for name, kind in (("sold", "long"), ("passed", "long"), ("low", "double"), ("high", "double"), ("low_at", "long"), ("high_at", "long")):
            schema = schema.add(f"{name}_{i}", kind)

    def rank(t: pa.Table) -> pa.RecordBatch:
        group = _groups(t, by) << 24
        probe = _numbers(t, "probe", bool, False)
        day = _numbers(t, "day", np.int64) + group - ALWAYS
        sold, passed, value = _numbers(t, "sold", np.int64), _numbers(t, "passed", np.int64), _numbers(t, "value", np.float64, 0.0)
        h = np.flatnonzero(~probe)
        h = h[np.argsort(day[h], kind="stable")]
        hday, hsold = day[h], sold[h]
        of_sold = np.concatenate([[0], np.cumsum(hsold)])
        of_passed = np.concatenate([[0], np.cumsum(passed[h])])
        p = np.flatnonzero(probe)
        out = t.select([*by, "day", "slot"]).take(pa.array(p))
        columns = [c.combine_chunks() for c in out.columns]
        end = np.searchsorted(hday, day[p], "left")
        for i in range(n):
            start = np.searchsorted(hday, _numbers(t, f"from{i}", np.int64)[p] + group[p] - ALWAYS, "left")
            count = of_sold[end] - of_sold[start]
            some = np.flatnonzero(count > 0)
            wanted = [_numbers(t, "rank", np.int64)[p][some]] if ranked else [(count[some] - 1) // 2, count[some] // 2]
            got = kth(np.where(hsold > 0, value[h], value[h][0] if len(h) else 0.0), hsold, np.concatenate([start[some]] * len(wanted)),
                      np.concatenate([end[some]] * len(wanted)), np.concatenate(wanted)) if len(some) else (np.zeros(0), np.zeros(0, np.int64))
            columns += [pa.array(count), pa.array(of_passed[end] - of_passed[start])]
            for result, kind in zip(got, (np.float64, np.int64)):
                for half in np.split(np.asarray(result), len(wanted)) + [None] * (2 - len(wanted)):
                    full, there = np.zeros(len(p), kind), np.zeros(len(p), bool)
                    if half is not None:
                        full[some], there[some] = half, True
                    columns.append(pa.array(full, mask=~there))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, by):
            yield rank(t)

    dealt = events.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, schema)


def _meet(probes: DataFrame, history: DataFrame) -> DataFrame:
    """One table of probes and history rows, each with nulls in the columns of the other."""
    return probes.withColumn("probe", F.lit(True)).unionByName(history.withColumn("probe", F.lit(False)), allowMissingColumns=True)


def windowed(lots: DataFrame, history: DataFrame, hist_map: DataFrame, key: str, months: tuple[int | None, ...],
             hot: DataFrame | None = None) -> DataFrame:
    """country_code, key, as_of and sold_i, passed_i, median_i for each window of ``months`` (None: no lower bound).

    ``hot`` holds the crowded keys (``hot_keys``); without it they are counted here.
    """
    first_day = [F.lit(ALWAYS) if m is None else F.unix_date(F.add_months("as_of", -m)) for m in months]
    probes = spine(lots, key).select("country_code", F.col(key).cast("long").alias("key"), F.unix_date("as_of").alias("day"),
                                     F.lit(0).alias("slot"), *[d.alias(f"from{i}") for i, d in enumerate(first_day)])
    sold = history.where(F.col(key).isNotNull()).select(
        F.col("country_code").alias("hist_country"), F.col(key).cast("long").alias("key"), F.unix_date("sale_date").alias("day"),
        F.when(F.col("sold_flag") == 1, F.col("price").cast("double")).alias("value"), "sold_flag", "passed_in_flag")

    def seen(rows: DataFrame) -> DataFrame:
        """Every lot at the countries that look back at it."""
        return rows.join(F.broadcast(hist_map), "hist_country").select(
            "country_code", "key", "day", "value", F.col("sold_flag").cast("long").alias("sold"), F.col("passed_in_flag").cast("long").alias("passed"))

    def histogram(rows: DataFrame, *by: str) -> DataFrame:
        """Counts by day, price and ``by``, at the countries that look back at them."""
        h = rows.groupBy("hist_country", "key", "day", "value", *by).agg(F.sum("sold_flag").cast("long").alias("sold"),
                                                                         F.sum("passed_in_flag").cast("long").alias("passed"))
        return h.join(F.broadcast(hist_map), "hist_country").drop("hist_country")

    hot = (hot_keys(history, (key,)) if hot is None else hot).where(F.col("kind") == key).select("key")
    crowded = not hot.isEmpty()
    # at most lots / HOT_ROWS keys
    cold, warm = ((lambda df: df.join(F.broadcast(hot), "key", "left_anti")), (lambda df: df.join(F.broadcast(hot), "key", "left_semi")))
    by = ["country_code", "key"]
    out = windows(_meet(cold(probes) if crowded else probes, seen(cold(sold) if crowded else sold)), by, len(months))
    middle = lambda i: (F.lit(0.5) * F.col(f"low_{i}") + F.lit(0.5) * F.col(f"high_{i}")).alias(f"median_{i}")
    shown = [c for i in range(len(months)) for c in (f"sold_{i}", f"passed_{i}")]
    done = out.select(*by, "day", *shown, *[middle(i) for i in range(len(months))])
    if crowded:
        price_bin = F.floor(F.log2("value") * BINS)
        sold, probes = warm(sold), warm(probes)
        looked = windows(_meet(probes, histogram(sold.withColumn("value", price_bin.cast("double")))), by, len(months))
        # slot 2i looks for the lower middle price of window i, slot 2i + 1 for the upper one
        asked = [F.struct(F.lit(2 * i + j).alias("slot"), F.col(f"{side}_{i}").cast("long").alias("bin"), F.col(f"{side}_at_{i}").alias("rank"))
                 for i in range(len(months)) for j, side in enumerate(("low", "high"))]
        asks = looked.select(*by, "day", F.explode(F.array(*asked)).alias("ask")).select(*by, "day", "ask.*").where("bin is not null")
        from_day = F.element_at(F.array(*[F.col(f"from{i}") for i in range(len(months))]), F.floor(F.col("slot") / 2).cast("int") + 1)
        asks = asks.join(probes.drop("slot"), [*by, "day"]).select(*by, "bin", "day", "slot", "rank", from_day.alias("from0"))
        inside = histogram(sold.where("value is not null").withColumn("bin", price_bin), "bin")
        prices = windows(_meet(asks, inside), [*by, "bin"], 1, ranked=True)
        found = prices.groupBy(*by, "day").agg(*[F.sum(F.when(F.floor(F.col("slot") / 2) == i, F.lit(0.5) * F.col("low_0"))).alias(f"median_{i}")
                                                 for i in range(len(months))])
        done = done.unionByName(looked.select(*by, "day", *shown).join(found, [*by, "day"], "left"))
    return done.select("country_code", F.col("key").alias(key), F.date_from_unix_date("day").alias("as_of"),
                       *[c for c in done.columns if c not in (*by, "day")])


# ---------------------------------------------------------------- feature blocks

def _rate(sold: Column, offered: Column) -> Column:
    return F.when(offered > 0, np_round(F.lit(100.0) * sold.cast("double") / offered.cast("double"), 1))


def sire_metrics(lots: DataFrame, history: DataFrame, hist_map: DataFrame, regions: DataFrame,
                 months: tuple[int, ...] = (36, 12), hot: DataFrame | None = None) -> DataFrame:
    """J4 + J8 + A1-A5: sire blocks for every window in ``months`` from one pass."""
    g = windowed(lots, history, hist_map, "sire_id", months, hot)
    cols = [F.col("country_code"), F.col("sire_id"), F.col("as_of").alias("sale_date")]
    for i, m in enumerate(months):
        sold, passed = F.col(f"sold_{i}"), F.col(f"passed_{i}")
        offered = sold + passed
        cols += [sold.alias(f"sire_sold_count_{m}m"), passed.alias(f"sire_passedin_count_{m}m"), offered.alias(f"sire_total_offered_{m}m"),
                 _rate(sold, offered).alias(f"sire_clearance_rate_{m}m"), F.col(f"median_{i}").alias(f"sire_median_price_{m}m")]
    out = g.select(*cols)
    if 36 in months and 12 in months:
        mins = F.broadcast(regions.select("country_code", "sire_sample_min_count"))
        out = (out.join(mins, "country_code", "left")
               .withColumn("sire_momentum", F.col("sire_median_price_12m") - F.col("sire_median_price_36m"))
               .withColumn("sire_sample_flag_36m",
                           (F.col("sire_sold_count_36m")
                            < F.coalesce(F.col("sire_sample_min_count"), F.lit(S.DEFAULT_SIRE_SAMPLE_MIN_COUNT)))
                           .cast("int"))
               .drop("sire_sample_min_count"))
    return out


def dam_stats(lots: DataFrame, history: DataFrame, hist_map: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """J5 + A1/A3/A6: all earlier progeny of the dam (no lower bound)."""
    g = windowed(lots, history, hist_map, "dam_id", (None,), hot)
    sold, passed = F.col("sold_0"), F.col("passed_0")
    return g.select(
        "country_code", "dam_id", F.col("as_of").alias("sale_date"),
        sold.alias("dam_progeny_sold_count"), passed.alias("dam_progeny_passedin_count"),
        (sold + passed).alias("dam_progeny_total_offered_count"),
        F.col("median_0").alias("dam_progeny_median_price"),
        (sold == 0).cast("int").alias("dam_first_foal_flag"),
    )


def volume_bucket(sold: Column) -> Column:
    """0 New, <=5 Small, <=20 Medium, else Large."""
    return (F.when(sold == 0, "New")
            .when(sold <= S.VENDOR_BUCKET_SMALL_MAX, "Small")
            .when(sold <= S.VENDOR_BUCKET_MEDIUM_MAX, "Medium")
            .otherwise("Large"))


def vendor_metrics(lots: DataFrame, history: DataFrame, hist_map: DataFrame, months: int = 36,
                   hot: DataFrame | None = None) -> DataFrame:
    """J6 + A1-A3/A7: vendor block over the last ``months`` months."""
    g = windowed(lots, history, hist_map, "vendor_id", (months,), hot)
    sold, passed = F.col("sold_0"), F.col("passed_0")
    m = months
    return g.select(
        "country_code", "vendor_id", F.col("as_of").alias("sale_date"),
        sold.alias(f"vendor_sold_count_{m}m"), passed.alias(f"vendor_passedin_count_{m}m"),
        (sold + passed).alias(f"vendor_total_offered_{m}m"),
        _rate(sold, sold + passed).alias(f"vendor_clearance_rate_{m}m"),
        F.col("median_0").alias(f"vendor_median_price_{m}m"),
        volume_bucket(sold).alias("vendor_volume_bucket"),
        (sold == 0).cast("int").alias("vendor_first_seen_flag"),
    )
