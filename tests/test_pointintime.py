"""Point-in-time features on hand-made history."""

import datetime as dt

from pyspark.sql import functions as F

from paddock.operators import pointintime as P
from paddock.sources.regions import region_hist

D = dt.date
COLS = "country_code string, sale_id long, sale_date date, sire_id long, dam_id long, vendor_id long, " \
       "price double, sold_flag int, passed_in_flag int"


def lots(spark, rows):
    return spark.createDataFrame(rows, COLS)


def one(df, **kw):
    for k, v in kw.items():
        df = df.where(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def test_window_bounds_and_same_day_exclusion(spark, regions):
    hist = lots(spark, [
        ("AFR", 1, D(2021, 4, 1), 7, 1, 1, 100.0, 1, 0),    # inside 12m and 36m (as-of 2022-03-31)
        ("AFR", 2, D(2019, 3, 31), 7, 1, 1, 200.0, 1, 0),   # exactly asof - 36 months: inside
        ("AFR", 3, D(2019, 3, 30), 7, 1, 1, 900.0, 1, 0),   # one day earlier: outside
        ("AFR", 4, D(2022, 3, 31), 7, 1, 1, 5000.0, 1, 0),  # same day as asof: never visible
        ("AFR", 5, D(2021, 6, 1), 7, 1, 1, 50.0, 0, 1),     # passed in
    ])
    base = lots(spark, [("AFR", 9, D(2022, 3, 31), 7, 1, 1, None, 0, 0)])
    r = one(P.sire_metrics(base, hist, region_hist(regions), regions), sire_id=7)
    assert r["sire_sold_count_36m"] == 2 and r["sire_passedin_count_36m"] == 1
    assert r["sire_total_offered_36m"] == 3
    assert r["sire_median_price_36m"] == 150.0
    assert r["sire_clearance_rate_36m"] == 66.7
    assert r["sire_sold_count_12m"] == 1 and r["sire_median_price_12m"] == 100.0
    assert r["sire_momentum"] == -50.0
    assert r["sire_sample_flag_36m"] == 1


def test_month_end_clamping(spark, regions):
    # 2024-02-29 minus 12 months is 2023-02-28 (clamped), which is inside the window
    hist = lots(spark, [("AFR", 1, D(2023, 2, 28), 7, 1, 1, 10.0, 1, 0),
                        ("AFR", 2, D(2023, 2, 27), 7, 1, 1, 20.0, 1, 0)])
    base = lots(spark, [("AFR", 9, D(2024, 2, 29), 7, 1, 1, None, 0, 0)])
    r = one(P.sire_metrics(base, hist, region_hist(regions), regions, (12,)), sire_id=7)
    assert r["sire_sold_count_12m"] == 1


def test_missing_history_fills_and_null_key(spark, regions):
    hist = lots(spark, [("AFR", 1, D(2020, 1, 1), 99, 99, 99, 10.0, 1, 0)])
    base = lots(spark, [("AFR", 9, D(2022, 1, 1), 7, 8, 5, None, 0, 0),
                        ("AFR", 9, D(2022, 1, 1), None, None, None, None, 0, 0)])
    hm = region_hist(regions)
    s = P.sire_metrics(base, hist, hm, regions)
    assert s.count() == 1                                  # NULL sire: no spine row
    r = one(s, sire_id=7)
    assert r["sire_sold_count_36m"] == 0 and r["sire_clearance_rate_36m"] is None
    assert r["sire_median_price_36m"] is None and r["sire_sample_flag_36m"] == 1
    d = one(P.dam_stats(base, hist, hm), dam_id=8)
    assert d["dam_first_foal_flag"] == 1 and d["dam_progeny_total_offered_count"] == 0
    v = one(P.vendor_metrics(base, hist, hm), vendor_id=5)
    assert v["vendor_volume_bucket"] == "New" and v["vendor_first_seen_flag"] == 1


def test_dam_has_no_lower_bound_and_unsold_offered_still_first_foal(spark, regions):
    hist = lots(spark, [("AFR", 1, D(2001, 1, 1), 1, 8, 1, 10.0, 1, 0),
                        ("AFR", 2, D(2021, 1, 1), 1, 9, 1, None, 0, 1)])
    base = lots(spark, [("AFR", 9, D(2022, 1, 1), 1, 8, 1, None, 0, 0),
                        ("AFR", 9, D(2022, 1, 1), 1, 9, 1, None, 0, 0)])
    dam = P.dam_stats(base, hist, region_hist(regions))
    assert one(dam, dam_id=8)["dam_progeny_sold_count"] == 1
    r9 = one(dam, dam_id=9)
    assert r9["dam_progeny_passedin_count"] == 1 and r9["dam_first_foal_flag"] == 1


def test_country_set_lookback(spark, regions):
    # ASI looks back at ASI and EUR; AFR only at itself
    hist = lots(spark, [("EUR", 1, D(2021, 1, 1), 7, 1, 1, 10.0, 1, 0)])
    base = lots(spark, [("ASI", 9, D(2022, 1, 1), 7, 1, 1, None, 0, 0),
                        ("AFR", 8, D(2022, 1, 1), 7, 1, 1, None, 0, 0)])
    s = P.sire_metrics(base, hist, region_hist(regions), regions)
    assert one(s, country_code="ASI")["sire_sold_count_36m"] == 1
    assert one(s, country_code="AFR")["sire_sold_count_36m"] == 0
    own = P.sire_metrics(base, hist, region_hist(regions, "own"), regions)
    assert one(own, country_code="ASI")["sire_sold_count_36m"] == 0


def test_vendor_buckets(spark, regions):
    rows = [("AFR", i, D(2021, 1, 1), 1, 1, 1, 10.0 + i, 1, 0) for i in range(6)]
    hist = lots(spark, rows)
    base = lots(spark, [("AFR", 99, D(2022, 1, 1), 1, 1, 1, None, 0, 0)])
    assert one(P.vendor_metrics(base, hist, region_hist(regions)), vendor_id=1)["vendor_volume_bucket"] == "Medium"
    got = spark.range(1).select(*[P.volume_bucket(F.lit(n)).alias(str(n)) for n in (0, 5, 6, 20, 21)]).first()
    assert list(got) == ["New", "Small", "Medium", "Medium", "Large"]


def test_no_leakage_invariance(spark):
    """Shifting every price dated on/after a sale must not move that sale's features."""
    import __spark_entry__ as E
    from paddock.operators import features as FT
    from paddock.plans.context import Context
    from conftest import SF_SMALL
    c = Context.of(spark, SF_SMALL)
    cutoff = D(2000, 1, 1)
    lots_df = c.lots
    shifted = lots_df.withColumn("price", F.when(F.col("sale_date") >= cutoff, F.col("price") * 3)
                                 .otherwise(F.col("price")))
    keep = F.col("sale_date") < cutoff
    cols = ["lot_id", "sire_median_price_36m", "sire_sold_count_36m", "dam_progeny_median_price",
            "vendor_median_price_36m", "vendor_sold_count_36m"]
    a = FT.lot_features(lots_df, c.regions, c.settings).where(keep).select(*cols)
    b = FT.lot_features(shifted, c.regions, c.settings).where(keep).select(*cols)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert E is not None


def test_partition_count_invariance(spark):
    """Same features whatever the shuffle partitioning."""
    from paddock.operators import features as FT
    from paddock.plans.context import Context
    from conftest import SF_SMALL
    c = Context.of(spark, SF_SMALL)
    cols = ["lot_id", "session_median_price", "sire_median_price_36m", "sire_clearance_rate_12m",
            "dam_progeny_median_price", "vendor_volume_bucket"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = FT.lot_features(c.lots, c.regions, c.settings).select(*cols).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = FT.lot_features(c.lots.repartition(5), c.regions, c.settings).select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 0


def test_hot_key_matches_brute_force(spark, regions):
    """One sire owns a third of all lots; Spark's plan must equal a direct per-row computation."""
    import pandas as pd
    from paddock.operators import lots as L
    from paddock.plans.context import Context
    from conftest import SF_SMALL
    c = Context.of(spark, SF_SMALL)
    hot = c.lots.withColumn("sire_id", F.when(F.col("lot_id") % 3 == 0, F.lit(424242)).otherwise(F.col("sire_id")))
    base = L.base_lots(hot, c.settings)
    hist = L.yearling_history(hot)
    got = P.sire_metrics(base, hist, region_hist(regions), regions).where(F.col("sire_id") == 424242).toPandas()
    assert len(got) > 0
    h = hist.where(F.col("sire_id") == 424242).select("country_code", "sale_date", "price", "sold_flag",
                                                      "passed_in_flag").toPandas()
    sets = {r["country_code"]: set(r["hist_countries"]) for r in regions.collect()}
    for _, r in got.iterrows():
        lo36 = (pd.Timestamp(r["sale_date"]) - pd.DateOffset(months=36)).date()
        lo12 = (pd.Timestamp(r["sale_date"]) - pd.DateOffset(months=12)).date()
        w = h[h["country_code"].isin(sets[r["country_code"]]) & (h["sale_date"] < r["sale_date"])]
        w36, w12 = w[w["sale_date"] >= lo36], w[w["sale_date"] >= lo12]
        for ww, m in ((w36, "36m"), (w12, "12m")):
            sold = ww[ww["sold_flag"] == 1]["price"]
            assert r[f"sire_sold_count_{m}"] == len(sold)
            assert r[f"sire_passedin_count_{m}"] == int(ww["passed_in_flag"].sum())
            med = sold.median() if len(sold) else None
            assert (med is None and pd.isna(r[f"sire_median_price_{m}"])) or med == r[f"sire_median_price_{m}"]


def crowd(spark, n=4000, days=300, seed=1):
    import numpy as np
    rng = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        sold = int(rng.rand() < 0.7)
        rows.append((("AFR", "EUR", "ASI")[i % 3], i, D(2015, 1, 1) + dt.timedelta(int(rng.randint(0, days)) * 7), 7 if i % 3 else int(rng.randint(0, 40)),
                     int(rng.randint(0, 9)), 1, float(rng.choice([500, 1000, 1000.5, 99999]) + rng.randint(0, 50)) if sold else None, sold, 1 - sold))
    return lots(spark, rows)


def test_two_looks_equal_one(spark, regions):
    """Crowded keys, ranked by price bins first, have the windows of the single look, and both those of brute force."""
    import statistics
    df = crowd(spark).checkpoint()
    hm = region_hist(regions)
    months = (36, 12, None)
    one_look = {tuple(r)[:3]: tuple(r)[3:] for r in P.windowed(df, df, hm, "sire_id", months, P.hot_keys(df, ("sire_id",), 10 ** 9)).collect()}
    hot = P.hot_keys(df, ("sire_id",), 50)
    assert 1 <= hot.count() < 40
    two = {tuple(r)[:3]: tuple(r)[3:] for r in P.windowed(df, df, hm, "sire_id", months, hot).collect()}
    assert one_look == two and len(two) > 1000
    sets = {r["country_code"]: set(r["hist_countries"]) for r in regions.collect()}
    rows = df.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["sire_id"], []).append(r)
    for (cc, key, day), got in list(two.items())[::37]:
        i = 0
        for m in months:
            start = D.min if m is None else D(day.year - m // 12, day.month, min(day.day, 28) if day.month == 2 else day.day)
            w = [r for r in by_key[key] if r["country_code"] in sets[cc] and start <= r["sale_date"] < day]
            prices = [r["price"] for r in w if r["sold_flag"]]
            k = len(months)
            assert got[2 * i: 2 * i + 2] == (len(prices), sum(r["passed_in_flag"] for r in w))
            assert got[2 * k + i] == (statistics.median(prices) if prices else None)
            i += 1


def test_rows_do_not_grow_with_the_window(spark, regions):
    """No operator of the plan makes more rows than history and probes have, however long the windows are."""
    df = crowd(spark, 1500, 100, 2).checkpoint()
    hot = P.hot_keys(df, ("sire_id",), 10 ** 9)

    def most_rows(months):
        out = P.windowed(df, df, region_hist(regions), "sire_id", months, hot)
        out.collect()
        plan, seen = out._jdf.queryExecution().executedPlan(), []

        def walk(p):
            if "AdaptiveSparkPlan" in p.nodeName():
                return walk(p.executedPlan())
            if "QueryStage" in p.nodeName():
                return walk(p.plan())
            metric = p.metrics().get("numOutputRows")
            if metric.isDefined():
                seen.append(metric.get().value())
            for i in range(p.children().size()):
                walk(p.children().apply(i))
        walk(plan)
        return max(seen)

    short, long = most_rows((1,)), most_rows((1200,))
    assert short == long <= 3 * 1500


def test_ranks_by_halving():
    import numpy as np
    rng = np.random.RandomState(0)
    value, weight = rng.randint(0, 30, 400).astype(float), rng.randint(0, 4, 400)
    a = rng.randint(0, 390, 500)
    b = np.minimum(400, a + 1 + rng.randint(0, 200, 500))
    total = np.array([weight[x:y].sum() for x, y in zip(a, b)])
    a, b, total = a[total > 0], b[total > 0], total[total > 0]
    k = (rng.rand(len(a)) * total).astype(int)
    got, place = P.kth(value, weight, a, b, k)
    for i in range(len(a)):
        s = np.sort(np.repeat(value[a[i]:b[i]], weight[a[i]:b[i]]))
        assert got[i] == s[k[i]] and place[i] == k[i] - np.searchsorted(s, s[k[i]])
    assert P.kth(np.array([5.0]), np.array([3]), np.array([0]), np.array([1]), np.array([2]))[0] == [5.0]


def test_runs_are_cut_between_keys(spark, regions, monkeypatch):
    """Runs of a few rows at a time, with keys longer than a run, change nothing."""
    import pyarrow as pa
    t = pa.table({"country_code": ["A"] * 5 + ["B"] * 9 + ["C"], "key": pa.array([1, 1, 2, 2, 2] + [1] * 9 + [4], pa.int64())})
    monkeypatch.setattr(P, "CHUNK", 4)
    for size in (1, 2, 3, 20):
        parts = list(P._runs(iter(t.to_batches(max_chunksize=size)), ["country_code", "key"]))
        assert pa.concat_tables(parts).equals(t) or pa.concat_tables(parts).to_pylist() == t.to_pylist()
        keys = [set(zip(p.column(0).to_pylist(), p.column(1).to_pylist())) for p in parts]
        assert sum(map(len, keys)) == 4


def test_history_is_dealt_once(spark, regions):
    """Lots of keys that aren't crowded go to their key as they are: one exchange for the probes, one for the runs."""
    df = crowd(spark, 300, 10, 2).checkpoint()
    out = P.windowed(df, df, region_hist(regions, "own"), "sire_id", (36,), P.hot_keys(df, ("sire_id",), 10 ** 9))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
