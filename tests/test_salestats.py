"""Sale statistics, goldens from the documented worked examples."""

import datetime as dt

from pyspark.sql import functions as F

from paddock.operators import salestats as ST


def lot_rows(spark, rows):
    return spark.createDataFrame(rows, "sale_id long, price double, is_withdrawn int, is_passed_in int, "
                                       "book_number int, day_number int")


def test_counts_clearance_and_price_block(spark):
    rows = [(1, 100.0, 0, 0, 1, 1), (1, 300.0, None, None, 1, 1), (1, 500.0, 0, 1, 1, 1),   # passed in: not sold
            (1, None, 1, None, None, 2), (1, 0.0, 0, 0, 0, 2),
            (2, None, 0, 0, 1, 1)]                                                          # nothing sold
    s = {r["sale_id"]: r for r in ST.sale_stats(lot_rows(spark, rows)).collect()}
    a = s[1]
    assert (a["total_lots"], a["withdrawn_count"], a["passed_in_count"], a["sold_count"]) == (5, 1, 1, 2)
    assert a["clearance_rate"] == round(100.0 * 2 / 4, 1)           # sold / (total - withdrawn)
    assert a["gross"] == 400.0 and a["avg_price"] == 200.0 and a["median_price"] == 200.0
    assert a["q1_price"] == 150.0 and a["q3_price"] == 250.0 and a["top10_avg"] == 200.0
    assert a["std_dev"] == round((2 * 100.0 ** 2) ** 0.5, 2) and a["under_50k"] == 2
    b = s[2]
    assert b["sold_count"] == 0 and b["gross"] is None and b["under_50k"] is None and b["clearance_rate"] == 0.0


def test_docs_golden_clearance_and_bands(spark):
    assert round(100.0 * 551 / (803 - 113), 1) == 79.9
    got = spark.range(1).select(F.bround(F.lit(100.0) * 551 / (803 - 113), 1).alias("c")).first()["c"]
    assert got == 79.9


def test_yoy_docs_golden(spark):
    cur = spark.createDataFrame([(1, 60584137.0, 110000.0, 80000.0, 551, 79.9)],
                                "sale_id long, gross double, avg_price double, median_price double, "
                                "sold_count long, clearance_rate double")
    prior = spark.createDataFrame([(1, 58373500.0, 104460.0, 75000.0, 559, 69.9)], cur.schema)
    y = ST.yoy_change(cur, prior).first()
    assert y["gross_pct"] == 3.8 and y["sold_count_change"] == -8 and y["clearance_rate_change"] == 10.0
    assert y["avg_price_pct"] == round(100.0 * (110000.0 - 104460.0) / 104460.0, 1)
    assert y["median_price_pct"] == 6.7


def test_top10_takes_ten_highest(spark):
    rows = [(1, float(p), 0, 0, 1, 1) for p in range(1, 31)]
    r = ST.sale_stats(lot_rows(spark, rows)).first()
    assert r["top10_avg"] == sum(range(21, 31)) / 10


def test_books_default_after_grouping(spark):
    rows = [(1, 1.0, 0, 0, None, 1), (1, 1.0, 0, 0, 0, 1), (1, 1.0, 0, 0, 1, 1), (1, 1.0, 0, 0, 2, 1)]
    got = sorted((r["book_number"], r["lot_count"]) for r in ST.sale_books(lot_rows(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1)]          # NULL, 0 and 1 stay separate groups


def test_assign_books_ranges(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (2, 1, 980, None), (3, 1, 981, 1), (4, 1, 0, 3)],
                               "lot_id long, sale_id long, lot_number int, book_number int")
    got = {r["lot_id"]: r["book_number"] for r in ST.assign_books(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_search_validation(spark):
    import pytest
    from paddock.settings import FIXTURE_SETTINGS
    with pytest.raises(ValueError):
        ST.sale_search("ab", None, None, None, None, None, FIXTURE_SETTINGS)
    assert dt.date(2001, 7, 1) == FIXTURE_SETTINGS.today


def test_hot_sale_matches_brute_force(spark):
    """One sale holds a third of all lots; pooled statistics equal a direct pandas computation."""
    from paddock.plans.context import Context
    from conftest import SF_SMALL
    c = Context.of(spark, SF_SMALL)
    rows = c.t("lot_rows").withColumn("sale_id", F.when(F.col("lot_id") % 3 == 0, F.lit(7)).otherwise(F.col("sale_id")))
    got = ST.sale_stats(rows).where(F.col("sale_id") == 7).first()
    pdf = rows.where(F.col("sale_id") == 7).select("price", "is_withdrawn", "is_passed_in").toPandas()
    sold = pdf[(pdf["price"] > 0) & (pdf["is_withdrawn"].fillna(0) == 0) & (pdf["is_passed_in"].fillna(0) == 0)]["price"]
    assert got["total_lots"] == len(pdf) and got["sold_count"] == len(sold)
    assert got["median_price"] == round(sold.median(), 2)
    assert got["q1_price"] == round(sold.quantile(0.25), 2) and got["q3_price"] == round(sold.quantile(0.75), 2)
    assert got["top10_avg"] == round(sold.nlargest(10).mean(), 2)
    assert abs(got["std_dev"] - round(sold.std(), 2)) <= 0.01
    assert got["gross"] == round(sold.sum(), 2)


def brute_stats(lots):
    """Statistics of pooled lots (price, withdrawn, passed in), as the source rounds them."""
    import numpy as np
    wd = [w == 1 for _, w, _ in lots]
    sold = sorted(p for (p, w, i) in lots if p is not None and p > 0 and w != 1 and i != 1)
    nz = lambda v, d=2: round(float(v), d) if v else None
    out = {"total_lots": len(lots), "sold_count": len(sold), "withdrawn_count": sum(wd),
           "passed_in_count": sum(1 for _, w, i in lots if w != 1 and i == 1)}
    eligible = len(lots) - sum(wd)
    out["clearance_rate"] = round(100.0 * len(sold) / eligible, 1) if eligible > 0 else None
    a = np.array(sold)
    out.update(dict.fromkeys(["gross", "avg_price", "median_price", "q1_price", "q3_price", "min_price", "max_price", "top10_avg", "std_dev"]))
    if sold:
        out.update(gross=nz(a.sum()), avg_price=nz(a.mean()), median_price=nz(np.median(a)), q1_price=nz(np.quantile(a, 0.25)),
                   q3_price=nz(np.quantile(a, 0.75)), min_price=nz(a[0]), max_price=nz(a[-1]), top10_avg=nz(a[::-1][:10].mean()),
                   std_dev=nz(a.std(ddof=1)) if len(a) > 1 else None)
    return out


def test_pooled_statistics_equal_a_pooling_of_lots(spark):
    """Groups of sales merged from summaries against the statistics of their lots put together: a sale with a third of all lots,
    sales without lots or sold lots, sales in several groups, equal and very large prices."""
    import numpy as np
    rng = np.random.RandomState(3)
    rows = []
    for i in range(900):
        sale = 1 if i % 3 == 0 else int(rng.randint(2, 9))
        price = None if rng.rand() < 0.1 else float(rng.choice([0, 1000, 5e4, 123456, 1e6, 7e7]) + rng.randint(0, 3))
        rows.append((sale, None if sale == 8 else price, int(rng.rand() < 0.1) or None, int(rng.rand() < 0.2), 1, 1))
    rows += [(20, 3e7, 0, 0, 1, 1)] * 25
    lots = lot_rows(spark, rows).repartition(6)
    members = {"a": [1, 2, 3], "b": [3, 4], "c": [8], "d": [99], "e": [20], "f": [20, 5], "g": [6]}
    m = spark.createDataFrame([(g, s) for g, ss in members.items() for s in ss] + [("a", 1)], "g string, sale_id long")
    got = {r["g"]: r.asDict() for r in ST.sale_stats(lots, m, ["g"]).collect()}
    alone = {r["sale_id"]: r.asDict() for r in ST.sale_stats(lots).collect()}
    assert set(got) == set(members)
    for g, sales in members.items():
        want = brute_stats([(p, w, i) for s, p, w, i, _, _ in rows if s in sales])
        assert {k: got[g][k] for k in want} == want, g
    for s in range(1, 9):
        want = brute_stats([(p, w, i) for x, p, w, i, _, _ in rows if x == s])
        assert {k: alone[s][k] for k in want} == want
    assert ST.sale_stats(lots, m, ["g"], columns=["gross", "total_lots"]).columns == ["g", "gross", "total_lots"]


def test_prior_year_and_history_equal_a_pooling(spark):
    """A17 and A19 with fuzzy names: every block equals the pooled lots of its matched sales."""
    from paddock.operators import fuzzy as FZ
    from paddock.plans import queries as Q
    from paddock.plans.context import Context
    c = Context.of(spark, "/root/testdata/sf0.001")
    by_sale = {}
    for r in c.t("lot_rows").select("sale_id", "price", "is_withdrawn", "is_passed_in").collect():
        by_sale.setdefault(r[0], []).append(tuple(r)[1:])
    matched, years = {}, {}
    for r in FZ.matches(c.t("sales"), 1, c.settings.sale_history_years, "fuzzy", c.settings.similarity_threshold).collect():
        years.setdefault((r["sale_id"], r["match_year"]), set()).add(r["match_sale_id"])
        matched.setdefault(r["sale_id"], []).append((r["match_year"], r["match_sale_id"]))
    pool = lambda ids: brute_stats([x for s in ids for x in by_sale.get(s, [])])
    year = {r["sale_id"]: r["start_date"].year for r in c.t("sales").collect()}
    prior = {r["sale_id"]: r for r in Q.q_prior_year_stats(c).collect()}
    assert set(prior) == {s for s, y in years if y == year[s] - 1} and len(prior) > 50
    pct = lambda a, b: round(100.0 * (a - b) / b, 1) if a and b else None
    for s, r in prior.items():
        want, own = pool(years[s, year[s] - 1]), brute_stats(by_sale.get(s, []))
        assert {k: r[f"prior_{k}"] for k in want} == want
        if own["sold_count"] and want["sold_count"]:
            assert r["gross_pct"] == pct(own["gross"], want["gross"]) and r["median_price_pct"] == pct(own["median_price"], want["median_price"])
    history = {(r["sale_id"], r["year"]): r for r in Q.q_sale_history_fuzzy(c).collect()}
    assert set(history) == set(years)
    for k, r in history.items():
        want = pool(years[k])
        assert all(r[x] == want[x] for x in ("total_lots", "sold_count", "gross", "avg_price", "median_price", "q1_price", "q3_price", "top10_avg"))


def test_rounding_by_name(spark):
    """The SQL form of Python's rounding, ties and near ties among the values."""
    import random

    from paddock.functions.rounding import py_round_of
    rng = random.Random(5)
    xs = [0.5, 1.5, 2.5, 2.675, 0.125, 2.45, 6.25, -0.05, -2.5, 0.0, -0.0, 1e16, 1e300, 1 / 3] + [rng.choice([1, -1]) * rng.randrange(10 ** 7) / 8000 for _ in range(3000)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[py_round_of("x", d).alias(f"r{d}") for d in (1, 2)]).collect():
        assert r["r1"] == round(r["x"], 1) and r["r2"] == round(r["x"], 2)
