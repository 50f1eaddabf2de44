"""Scoring semantics: elite scaling, adjustments, clamps, tiers, summary, compare."""

import math

import random

import pytest
from pyspark.sql import functions as F

from paddock.functions.rounding import np_round, price_round, py_round
from paddock.operators import predictions as PR
from paddock.operators import scoring as SC


def val(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_rounding_twins(spark):
    assert val(spark, np_round(F.lit(0.25), 1)) == 0.2          # numpy: half-even on the scaled value
    assert val(spark, np_round(F.lit(0.35), 1)) == 0.4
    assert val(spark, price_round(F.lit(12350.0))) == 12400.0   # np.round(x, -2)
    assert val(spark, price_round(F.lit(12250.0))) == 12200.0
    # exact binary ties agree with Python's round (half-even)
    assert val(spark, py_round(F.lit(6.25), 1)) == round(6.25, 1) == 6.2
    assert val(spark, py_round(F.lit(0.125), 2)) == round(0.125, 2) == 0.12
    # decimal-text ties whose binary value is beside the tie
    for x, d in [(2.675, 2), (2.45, 1), (49 / 20, 1), (-2.675, 2), (1.005, 2), (0.15, 1), (1e15 + 0.5, 1), (-0.004, 2), (5e-324, 6)]:
        assert val(spark, py_round(F.lit(x), d)) == round(x, d), x


def test_python_rounding_of_many_values(spark):
    rng = random.Random(3)
    xs = [rng.choice([rng.uniform(-1e6, 1e6), rng.randrange(-10**6, 10**6) / 200, rng.randrange(-10**7, 10**7) / 2000]) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", py_round(F.col("x"), 1).alias("a"), py_round(F.col("x"), 2).alias("b"), py_round(F.col("x"), 6).alias("c")).collect()
    assert all((r["a"], r["b"], r["c"]) == (round(r["x"], 1), round(r["x"], 2), round(r["x"], 6)) for r in rows)


@pytest.mark.parametrize("abs_log,flags,tier", [
    (0.1, 0, "high"), (0.1, 1, "medium"), (0.1, 2, "low"), (0.1, 3, "low"),
    (0.8, 0, "medium"), (0.8, 1, "medium"), (0.8, 2, "low"),
    (1.0, 0, "medium"), (1.5, 1, "low"), (0.7, 0, "medium"),
])
def test_tier_matrix(spark, abs_log, flags, tier):
    t = SC.confidence_tier(F.lit(abs_log), F.lit(flags), F.lit(0.7), F.lit(1.0))
    assert val(spark, t) == tier


def test_elite_offset(spark):
    e = SC.elite_offset(F.lit(200000.0), F.lit(100000.0), F.lit(0.25), F.lit(0.5))
    assert math.isclose(val(spark, e), 0.25 + math.log(2) * 0.5)
    assert val(spark, SC.elite_offset(F.lit(99999.0), F.lit(100000.0), F.lit(0.25), F.lit(0.5))) == 0.0


def _scored(spark, regions, rows):
    from paddock.settings import FIXTURE_SETTINGS
    from paddock.sources.regions import model_offsets
    df = spark.createDataFrame(rows, "lot_id long, horse_id long, sale_id long, country_code string, "
                                     "lot_number int, book_number int, sex string, horse_name string, "
                                     "sire_name string, session_median_price double, pred_q25 double, "
                                     "pred_q50 double, pred_q75 double, sire_sample_flag_36m int, "
                                     "dam_first_foal_flag int, vendor_first_seen_flag int")
    return SC.score(df, model_offsets(spark, regions), FIXTURE_SETTINGS)


def test_score_row_and_clamps(spark, regions):
    # AFR: region elite block (90000, 0.25, 0.5), offsets -0.05 / 0.06
    m = 50000.0
    rows = [(1, 1, 10, "AFR", 1, 1, "Colt", "h", "s", m, -0.35, 0.0, 0.35, None, 1, 0),
            (2, 2, 10, "AFR", 2, 1, "Colt", "h", "s", m, 0.5, 0.4, 0.3, 0, 0, 0)]   # crossed quantiles
    s = {r["lot_id"]: r for r in _scored(spark, regions, rows).collect()}
    r1 = s[1]
    assert r1["mv_expected_price"] == 50000.0
    assert r1["mv_low_price"] == round(m * math.exp(-0.40) / 100) * 100
    assert r1["mv_high_price"] == round(m * math.exp(0.41) / 100) * 100
    assert r1["mv_confidence_tier"] == "medium"          # close, NULL flag counts 0, one flag
    r2 = s[2]
    assert r2["mv_low_price"] <= r2["mv_expected_price"] <= r2["mv_high_price"]
    assert r2["mv_low_price"] >= 0


def test_model_elite_block_overrides_region(spark, regions):
    # EUR uses a model with its own elite block (120000, 0.3, 0.8)
    m = 100000.0
    p50 = math.log(1.5)                                   # raw 150000: above 120000, above region 90000
    rows = [(1, 1, 10, "EUR", 1, 1, "Colt", "h", "s", m, p50 - 0.35, p50, p50 + 0.35, 0, 0, 0)]
    r = _scored(spark, regions, rows).first()
    assert math.isclose(r["elite_offset"], 0.3 + (math.log(150000.0) - math.log(120000.0)) * 0.8, rel_tol=1e-12)


def test_summary_elite_percent_golden(spark):
    """Docs golden: 12 elite lots of 806 -> 1.49 %."""
    assert val(spark, py_round(F.lit(100.0) * F.lit(12) / F.lit(806), 2)) == 1.49


def test_compare_golden_and_edge_cases(spark):
    scored = spark.createDataFrame(
        [(1, 1, 10, 125000.0, 80000.0, 150000.0), (2, 2, 10, 5000.0, 3000.0, 7000.0),
         (3, 3, 10, 7000.0, 5000.0, 9000.0), (4, 4, 10, 9000.0, 6000.0, 12000.0)],
        "lot_id long, horse_id long, sale_id long, mv_expected_price double, mv_low_price double, "
        "mv_high_price double")
    store = spark.createDataFrame(
        [(1, 10, 120000.0, 70000.0, None), (2, 10, 0.0, None, None), (3, 10, None, None, None)],
        "horse_id long, sale_id long, market_value double, market_value_low double, market_value_high double")
    c = {r["lot_id"]: r for r in PR.compare(scored, store).collect()}
    assert c[1]["delta_expected"] == 5000.0 and c[1]["delta_expected_pct"] == 4.17     # docs golden
    assert c[1]["delta_low"] == 10000.0 and c[1]["delta_high"] is None
    assert c[2]["delta_expected_pct"] == 0.0                                            # old value 0
    assert c[3]["is_new"] is False and c[3]["delta_expected"] is None and c[3]["changed"] is False
    assert c[4]["is_new"] is True and c[4]["changed"] is False
    s = PR.compare_summary(PR.compare(scored, store)).first()
    assert (s["total_lots"], s["new_lots"], s["existing_lots"], s["changed_lots"], s["unchanged_lots"]) == (4, 1, 3, 2, 1)


def test_upsert_last_row_wins_and_tags(spark, regions):
    store = spark.createDataFrame(
        [(1, 10, 1.0, 1.0, 1.0, 1.0, "low", 1.0, 9), (5, 10, 5.0, 5.0, 5.0, 5.0, "low", 5.0, 9)],
        "horse_id long, sale_id long, market_value double, market_value_low double, market_value_high double, "
        "market_value_multiplier double, confidence string, session_median_price double, currency_id long")
    batch = spark.createDataFrame(
        [(1, 10, "AFR", 100.0, 90.0, 110.0, 1.1, "high", 50.0, 1), (1, 10, "AFR", 200.0, 190.0, 210.0, 1.2, "high", 50.0, 2),
         (2, 10, "AFR", 300.0, 290.0, 310.0, 1.3, "medium", 50.0, 1)],
        "horse_id long, sale_id long, country_code string, mv_expected_price double, mv_low_price double, "
        "mv_high_price double, mv_expected_index double, mv_confidence_tier string, session_median_price double, "
        "seq int")
    snap = {r["horse_id"]: r for r in PR.upsert(store, PR.batch_rows(batch, "seq"), regions, 2, "2001-01-01 00:00:00").collect()}
    assert snap[1]["action"] == "update" and snap[1]["market_value"] == 200.0 and snap[1]["currency_id"] == 1
    assert snap[2]["action"] == "insert" and snap[5]["action"] == "keep" and snap[5]["currency_id"] == 9


def test_band_invariants_on_every_scored_lot(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    s = E.queries()["score_lots"](spark, SF_SMALL)
    bad = s.where(~((F.col("mv_low_price") <= F.col("mv_expected_price"))
                    & (F.col("mv_expected_price") <= F.col("mv_high_price"))
                    & (F.col("mv_low_price") >= 0)
                    & F.col("mv_confidence_tier").isin("high", "medium", "low")))
    assert s.count() > 0 and bad.count() == 0


def test_commit_rejects_lot_of_another_sale(spark, regions):
    scored = spark.createDataFrame(
        [(1, 1, 10, "AFR", 100.0, 90.0, 110.0, 1.0, "high", 50.0),
         (2, 2, 11, "AFR", 200.0, 190.0, 210.0, 1.0, "high", 50.0)],
        "lot_id long, horse_id long, sale_id long, country_code string, mv_expected_price double, "
        "mv_low_price double, mv_high_price double, mv_expected_index double, mv_confidence_tier string, "
        "session_median_price double")
    store = spark.createDataFrame([(1, 10, 1.0, 1.0, 1.0, 1.0, "low", 1.0, 9)],
                                  "horse_id long, sale_id long, market_value double, market_value_low double, "
                                  "market_value_high double, market_value_multiplier double, confidence string, "
                                  "session_median_price double, currency_id long")
    ok = PR.commit(store, scored, spark.createDataFrame([(10, 1)], "sale_id long, lot_id long"), regions, 2, "2001-01-01 00:00:00").first()
    assert (ok["inserted"], ok["updated"], ok["total"]) == (0, 1, 1)
    asked = spark.createDataFrame([(10, 1), (10, 2), (10, 3)], "sale_id long, lot_id long")
    assert {(r["lot_id"], r["reason"]) for r in PR.rejected(asked, scored).collect()} == {(2, "other sale"), (3, "not scored")}
    for lot in (2, 3):
        with pytest.raises(Exception, match="a committed lot"):
            PR.commit(store, scored, asked.where(F.col("lot_id") == lot), regions, 2, "2001-01-01 00:00:00").collect()


def test_upsert_keeps_audit_columns(spark, regions):
    store = spark.createDataFrame(
        [(1, 10, 1.0, 1.0, 1.0, 1.0, "low", 1.0, 9, 7, "a", 55, "b", "x"), (5, 10, 5.0, 5.0, 5.0, 5.0, "low", 5.0, 9, 7, "a", 55, "b", "y")],
        "horse_id long, sale_id long, market_value double, market_value_low double, market_value_high double, "
        "market_value_multiplier double, confidence string, session_median_price double, currency_id long, "
        "created_by long, created_on string, modified_by long, modified_on string, note string")
    batch = spark.createDataFrame(
        [(k, 1, 10, "AFR", 100.0 + k, 90.0, 110.0, 1.1, "high", 50.0) for k in (1, 2)]
        + [(k, 2, 10, "AFR", 100.0 + k, 90.0, 110.0, 1.1, "high", 50.0) for k in (3, 4)],
        "lot_id long, horse_id long, sale_id long, country_code string, mv_expected_price double, mv_low_price double, "
        "mv_high_price double, mv_expected_index double, mv_confidence_tier string, session_median_price double")
    snap = PR.upsert(store, PR.batch_rows(batch), regions, 2, "now")
    got = {r["horse_id"]: (r["created_by"], r["created_on"], r["modified_by"], r["modified_on"], r["note"], r["market_value"])
           for r in snap.collect()}
    assert got == {1: (7, "a", 2, "now", "x", 102.0), 5: (7, "a", 55, "b", "y", 5.0), 2: (2, "now", 2, "now", None, 104.0)}
    c = PR.upsert_counts(snap).first()
    assert (c["inserted"], c["updated"]) == (1, 3)
