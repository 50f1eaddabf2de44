"""The versioned prediction store, the model registry and feature lists."""

import tempfile

import pytest
from pyspark.sql import functions as F

from paddock.operators import features as FT
from paddock.operators import registry as RG
from paddock.session import children, exists
from paddock.sources.store import PredictionStore

STORED = "horse_id long, sale_id long, market_value double, market_value_low double, market_value_high double, " \
         "market_value_multiplier double, confidence string, session_median_price double, currency_id long, created_by long, " \
         "created_on string, modified_by long, modified_on string, note string"
SCORED = "lot_id long, horse_id long, sale_id long, country_code string, mv_expected_price double, mv_low_price double, " \
         "mv_high_price double, mv_expected_index double, mv_confidence_tier string, session_median_price double"


def stored(spark, keys):
    return spark.createDataFrame([(h, s, 1.0, 1.0, 1.0, 1.0, "low", 9.0, 1, 5, "t0", None, None, f"n{h}") for h, s in keys], STORED)


def scored(spark, rows):
    return spark.createDataFrame([(lot, h, s, "AFR", v, v - 1, v + 1, 0.5, "high", 7.0) for lot, h, s, v in rows], SCORED)


def test_store_upserts_and_reads_back(spark, regions):
    root = tempfile.mkdtemp(prefix="paddock-store-")
    store = PredictionStore(spark, root + "/p", buckets=16)
    with pytest.raises(ValueError):
        store.read()
    store.create(stored(spark, [(h, h % 3) for h in range(40)]))
    with pytest.raises(ValueError):
        store.create(stored(spark, []))
    before = store.folders()
    # two rows of one new key, one update
    counts = store.upsert(scored(spark, [(1, 100, 5, 10.0), (2, 100, 5, 20.0), (3, 4, 1, 30.0)]), regions, 2, "t1").collect()
    assert {r["sale_id"]: (r["inserted"], r["updated"]) for r in counts} == {5: (1, 1), 1: (0, 1)}
    after = store.folders()
    assert {b for b in after if after[b] == 2} and sum(v == 2 for v in after.values()) <= 2     # only the touched buckets are new
    assert {b: v for b, v in after.items() if v == 1} == {b: 1 for b in before if after[b] == 1}
    now = {(r["horse_id"], r["sale_id"]): r for r in store.read().collect()}
    assert len(now) == 41 and now[100, 5]["market_value"] == 20.0 and now[100, 5]["created_on"] == "t1" and now[100, 5]["note"] is None
    assert now[4, 1]["market_value"] == 30.0 and now[4, 1]["created_on"] == "t0" and now[4, 1]["note"] == "n4"
    assert {(r["horse_id"], r["sale_id"]) for r in store.read(1).collect()} == {(h, h % 3) for h in range(40)}
    assert store.upsert(scored(spark, []), regions, 2, "t2").count() == 0 and store._versions() == [1, 2]


def test_an_unfinished_version_is_not_seen(spark, regions):
    root = tempfile.mkdtemp(prefix="paddock-store-")
    store = PredictionStore(spark, root + "/p", buckets=4)
    store.create(stored(spark, [(1, 1), (2, 2)]))
    # a writer that stopped after its data, and one whose list of folders isn't complete
    stored(spark, [(3, 3)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(root + "/p/data/v=2")
    spark.createDataFrame([(0, 2)], "bucket int, version int").write.parquet(root + "/p/versions/v=2")
    import os
    os.rename(root + "/p/versions/v=2/_SUCCESS", root + "/p/versions/v=2/_stopped")
    assert store.read().count() == 2 and store._versions() == [1]
    store.upsert(scored(spark, [(1, 1, 1, 50.0)]), regions, 2, "t1")
    rows = {r["horse_id"]: r["market_value"] for r in store.read().collect()}
    assert rows == {1: 50.0, 2: 1.0} and store._versions() == [1, 2]


def test_empty_store(spark, regions):
    store = PredictionStore(spark, tempfile.mkdtemp(prefix="paddock-store-") + "/p")
    store.create(stored(spark, []))
    assert store.read().count() == 0 and store.read().columns == stored(spark, []).columns
    store.upsert(scored(spark, [(1, 1, 1, 50.0)]), regions, 2, "t1")
    assert store.read().count() == 1


def run(spark, at, countries):
    return spark.createDataFrame([(c, at, 10, 0.5) for c in countries], "country_code string, generated_at string, test_rows long, mae double")


def gains(spark, countries, g):
    return spark.createDataFrame([(c, q, f, x) for c in countries for q in ("q25", "average") for f, x in (("b", g), ("a", 1 - g))],
                                 "country_code string, quantile string, feature string, gain double")


def test_registry_versions(spark, regions):
    root = tempfile.mkdtemp(prefix="paddock-registry-")
    assert RG.read_registry(spark, root) is None
    RG.append_run(run(spark, "2020-01-01", ["AFR", "EUR"]), gains(spark, ["AFR", "EUR"], 0.256), root)
    RG.append_run(run(spark, "2021-01-01", ["AFR"]), gains(spark, ["AFR"], 0.004), root)
    RG.append_run(run(spark, "2022-01-01", ["AFR", "EUR", "ASI"]), gains(spark, ["AFR"], 0.9), root)
    metrics, importance = RG.read_registry(spark, root)
    assert metrics.columns == RG.METRICS_SCHEMA.names and len(metrics.columns) >= 28
    rows = {(r["country_code"], r["version"]): r for r in RG.versions(metrics, importance, regions).collect()}
    assert set(rows) == {("AFR", 1), ("AFR", 2), ("AFR", 3), ("EUR", 1), ("EUR", 2), ("ASI", 1)}
    assert rows["AFR", 2]["model"] == "afr_v2" and rows["AFR", 2]["generated_at"] == "2021-01-01"
    assert [rows["AFR", v]["is_latest"] for v in (1, 2, 3)] == [False, False, True]
    assert rows["AFR", 1]["importance_average"] == {"a": 0.74, "b": 0.26} and rows["AFR", 2]["importance_q25"] == {"a": 1.0, "b": 0.0}
    assert rows["EUR", 2]["importance_average"] is None and rows["AFR", 1]["importance_q50"] == {}
    assert rows["AFR", 1]["small_test_set"] and rows["AFR", 1]["trees_q25"] is None
    past = {(r["country_code"], r["version"]): r["is_latest"] for r in RG.versions(metrics, importance, regions, "2021-06-01").collect()}
    assert past == {("AFR", 1): False, ("AFR", 2): True, ("EUR", 1): True}
    assert RG.next_version(metrics, "afr") == 4


def test_active_version_is_the_configured_one(spark, regions):
    name = regions.where("country_code = 'AFR'").first()["model"]
    rows = spark.createDataFrame([("AFR", name.upper(), 1), ("AFR", "other", 2)], "country_code string, model string, version int")
    rows = RG.as_table(rows, RG.METRICS_SCHEMA)
    none = spark.createDataFrame([], RG.IMPORTANCE_SCHEMA)
    assert {r["version"]: r["active"] for r in RG.versions(rows, none, regions).collect()} == {1: True, 2: False}


def test_feature_lists(spark):
    frame = spark.createDataFrame([(1, "AFR", 2.0, "7", None), (2, "EUR", None, "x", 3)], "lot_id long, country_code string, a double, b string, `c.d` long")
    lists = spark.createDataFrame([("AFR", "m1", ["b", "a"], [1.0, 10.0]), ("AFR", "m2", ["log_a", "gone", "a"], [0.0, 5.0, 1.0]), ("EUR", "m3", ["b", "a"], [1.0, 1.0]),
                                   ("ASI", "m4", ["a"], [1.0])], "country_code string, model string, features array<string>, weights array<double>")
    got = {(r["lot_id"], r["model"]): (r["x"], r["s"]) for r in FT.listed_matrix(frame, lists, ["lot_id"]).withColumn("s", FT.linear_score()).collect()}
    import math
    assert got == {(1, "m1"): ([7.0, 2.0], 27.0), (1, "m2"): ([math.log1p(2.0), 0.0, 2.0], 2.0), (2, "m3"): ([0.0, 0.0], 0.0)}
    assert FT.listed_matrix(frame, lists.where("false"), ["lot_id"]).count() == 0


def test_folder_listing(spark):
    root = tempfile.mkdtemp(prefix="paddock-names-")
    assert children(spark, root) == [] and children(spark, root + "/none") == [] and not exists(spark, root + "/none")
