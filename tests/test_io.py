"""Activity log source and CSV sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from paddock.operators import registry as RG
from paddock.sources import files as FL


def test_activity_log(spark):
    d = tempfile.mkdtemp(prefix="paddock-test-")
    p = os.path.join(d, "activity.jsonl")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(40).collect()
    with open(p, "w") as f:
        for e in ev:
            f.write(json.dumps({"timestamp": e["ts"].isoformat(), "user": str(e["user_id"]), "action": "POST",
                                "detail": e["props"], "category": e["event_type"],
                                "status": "error" if e["event_type"] == "error" else "success"}) + "\n")
        f.write(json.dumps({"timestamp": "t", "user": "u", "action": "a", "detail": "d"}) + "\n")
        f.write(json.dumps({"timestamp": "t", "user": "u"}) + "\n")     # missing required fields
        f.write("{not json\n")
        f.write("\n")
        f.write("[1, 2\n")
    log = RG.read_activity(spark, p)
    assert RG.activity_total(spark, p) == 45
    last = RG.recent_activity(log, 6).collect()
    assert len(last) == 6 and [r["user"] for r in last[:5]] == [str(e["user_id"]) for e in ev[-5:]]
    assert last[5]["category"] == "general" and last[5]["status"] == "success"
    errs = RG.recent_activity(log, 500, status="error").count()
    assert errs == sum(1 for e in ev if e["event_type"] == "error")


def test_inference_csv_roundtrip(spark):
    from paddock.plans.context import Context
    from paddock.operators import features as FT
    c = Context.of(spark, "/root/testdata/sf0.001")
    feats = FT.lot_features(c.lots, c.regions, c.settings)
    d = tempfile.mkdtemp(prefix="paddock-test-")
    FL.write_inference(feats, d + "/inference")
    back = spark.read.option("header", True).csv(d + "/inference")
    assert back.count() == feats.count()
    assert "sire_median_price_36m" in back.columns
    tr = FT.training_frame(c.lots, c.regions, c.settings)
    FL.write_training(tr, d + "/train")
    t2 = FL.read_training_csv(spark, d + "/train")
    assert t2.count() == tr.count()
    assert t2.where(F.col("log_price_index").isNull()).count() == 0


def test_scored_sink_snapshot_and_registry_sinks(spark, regions):
    import __spark_entry__ as E
    from paddock.operators import lots as L
    from paddock.operators import predictions as PR
    from paddock.plans.context import Context
    from conftest import SF_SMALL
    c = Context.of(spark, SF_SMALL)
    scored = E.queries()["score_lots"](spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="paddock-test-")
    FL.write_scored(scored, d + "/scored", fmt="parquet")
    back = spark.read.parquet(d + "/scored")
    assert back.count() == scored.count()
    snap = PR.upsert(c.t("predictions"), PR.batch_rows(scored.withColumn("mv_expected_index", F.lit(1.0))),
                     regions, 2, "2001-01-01 00:00:00")
    p1 = PR.write_snapshot(snap, d + "/store", 1)
    assert spark.read.parquet(p1).count() == snap.count()
    m = spark.createDataFrame([("AFR", "afr_v1", 1)], "country_code string, model string, version int")
    from paddock.operators import registry as RG2
    assert RG2.next_version(m, "afr") == 2 and RG2.next_version(None, "AFR") == 1
    sale = c.t("sales").first()["sale_id"]
    assert L.require_sale_country(c.t("sales"), c.t("countries"), sale) in {"AFR", "AME", "ASI", "EUR", "MID"}
    import pytest
    with pytest.raises(ValueError):
        L.require_sale_country(c.t("sales"), c.t("countries"), -1)
