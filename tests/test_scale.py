"""Steps that have to grow with the input: tables written once and only where needed, partitions in proportion, medians from
counted values, boosters routed node by node."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paddock.operators import boosting as BO
from paddock.operators import medians as M
from paddock.operators import scoring as SC
from paddock.plans import queries as Q
from paddock.plans.context import Context
from paddock.session import SHUFFLE_CLEANUP, children, exists, saved
from paddock.settings import FIXTURE_SETTINGS
from paddock.sources import fixture as FX

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_written_when_needed_and_projections_never(spark, monkeypatch):
    fx = FX.Fixture(spark, SMALL)
    monkeypatch.setattr(fx, "root", fx.root + "-scale")
    assert fx.table("report_queue").count() > 0 and not exists(spark, f"{fx.root}/lots_src")
    assert fx.table("lot_rows").count() == fx.table("lots_src").count() == fx.table("horses").count()
    assert exists(spark, f"{fx.root}/lots_src") and not exists(spark, f"{fx.root}/lot_rows") and not exists(spark, f"{fx.root}/sales")


def test_lots_deal_lineitem_once_in_partitions_of_the_input(spark, monkeypatch):
    """The join order and the number of partitions; the caller's settings are as they were."""
    fx = FX.Fixture(spark, SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(FX, "INPUT_BYTES", 1000)
    assert int(fx._sizes()["spark.sql.shuffle.partitions"]) > 50
    s = fx._session(FX.TPCH_TABLES)
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    s.sql(FX.LOCATED_SQL).createOrReplaceTempView("located")
    text = s.sql(FX.LOTS_BY_ORDER_SQL)._jdf.queryExecution().executedPlan().toString()
    large = [line for line in text.splitlines() if "Exchange hashpartitioning(l_orderkey" in line or "Exchange hashpartitioning(o_custkey" in line]
    assert len(large) == 2 and "ShuffledHashJoin" in text     # lineitem by order, orders by customer
    a, b = s.sql(FX.LOTS_BY_ORDER_SQL), s.sql(FX.LOTS_SRC_SQL)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_medians_from_counted_values(spark):
    rows = [("a", 1, 5.0, 1), ("a", 1, 5.0, 1), ("a", 1, 9.0, 1), ("a", 1, 9.0, 1), ("a", 2, 3.0, 0), (None, 1, 7.0, 1), (None, 1, None, 1)]
    df = spark.createDataFrame(rows, "sale_name string, sale_year int, price double, sold_flag int").repartition(3)
    got = M.median_by(df, ["sale_name", "sale_year"], M.sold_price())
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {("a", 1): 7.0, ("a", 2): None, (None, 1): 7.0}
    assert "percentile(_v" in plan(got) and plan(got).count("Aggregate [") == 2


def test_score_summary_equals_one_over_rows(spark):
    rng = np.random.RandomState(4)
    rows = [("AFR", int(s), float(a), float(a + 100), float(b), t) for s, a, b, t in zip(
        rng.randint(0, 3, 300), 100 * rng.randint(1, 9, 300), 100 * rng.randint(9, 20, 300), rng.choice(["high", "medium", "low"], 300))]
    rows += [("AFR", 7, None, None, None, "low"), ("ZZZ", 8, 1.0, 1.0, 1.0, "low")]
    scored = spark.createDataFrame(rows, "country_code string, sale_id long, mv_low_price double, mv_expected_price double, "
                                         "mv_high_price double, mv_confidence_tier string").repartition(4)
    offsets = spark.createDataFrame([("AFR", 500.0)], "country_code string, summary_elite_threshold double")
    out = SC.score_summary(scored, offsets)
    got = {r["sale_id"]: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 7} and got[7]["total_lots"] == 1 and got[7]["median_low"] is None and got[7]["gross_low"] is None
    for sale in range(3):
        own = [r for r in rows if r[1] == sale]
        g = got[sale]
        assert (g["total_lots"], g["elite_scaling_count"]) == (len(own), sum(r[3] >= 500 for r in own))
        for i, k in ((2, "low"), (3, "expected"), (4, "high")):
            v = [r[i] for r in own]
            assert (g[f"gross_{k}"], g[f"median_{k}"]) == (sum(v), float(np.median(v)))
            assert g[f"tier_{'medium' if k == 'expected' else k}"] == sum(r[5] == ("medium" if k == "expected" else k) for r in own)
    assert plan(out).count("Aggregate [") == 2


def test_the_training_frame_is_computed_once(spark):
    c = Context.of(spark, SMALL)
    for query in (Q.q_model_matrix, Q.q_model_matrix_by_list, Q.q_label_encode):
        assert "MapInArrow" not in plan(query(c))
    assert FIXTURE_SETTINGS.lot_type == c.yearlings.select("lot_type").distinct().first()[0]


def test_routing_splits_rows_node_by_node():
    rng = np.random.RandomState(1)
    x = rng.randint(0, 9, (500, 3))
    tree = tuple(map(np.array, ([2, 0, -1, -1, -1], [4, 1, 0, 0, 0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1])))
    want = np.where(x[:, 2] > 4, 2, np.where(x[:, 0] <= 1, 3, 4))
    assert (BO.routed(x.T, 500, tree) == want).all()
    assert (BO.routed(x.T, 500, tuple(map(np.array, ([-1], [0], [-1], [-1])))) == 0).all()


def test_batches_are_put_together():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(i, i + 3))}) for i in range(0, 21, 3)]
    got = list(BO._chunks(iter(batches), 7))
    assert [len(b) for b in got] == [9, 9, 3] and [v for b in got for v in b.column("a").to_pylist()] == list(range(21))
    assert not list(BO._chunks(iter([])))


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffled_files(spark, tmp_path):
    """The shuffled files of a written table go as its write ends; the session's settings stay as they were."""
    before, conf = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    saved(spark.range(50_000).groupBy((F.col("id") % 1000).alias("g")).agg(F.sum("id").alias("s")), f"{tmp_path}/t")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP, None) == conf


def test_feature_blocks_are_written_one_after_the_other(spark):
    """The plan that joins lots with their blocks doesn't make the blocks: their shuffled files are gone."""
    for df in (Q.all_features(Context.of(spark, SMALL)), Q.train_frame(Context.of(spark, SMALL))):
        assert "MapInArrow" not in plan(df) and "Join" in plan(df)


def test_registry_writes_only_what_its_runs_read(spark):
    c = Context.of(spark, SMALL)
    Q.q_model_registry(c)
    assert len(c.fx.derived("fixed_predictions", None).columns) == 8 + len(Q.REGISTRY_FEATURES)


def test_booster_rows_that_tasks_hold_are_not_shuffled(spark, monkeypatch):
    rows = [("AAA" if i % 3 else "BBB", i, float(i % 7), "validation" if i % 5 == 0 else "train", float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "country_code string, lot_id long, log_price_index double, split string, a double")
    written, paths = {}, []
    monkeypatch.setattr(BO, "saved", lambda df, path, **kw: paths.append(path) or written.setdefault(path.rsplit("/", 1)[1][:12], plan(df)) and saved(df, path, **kw))
    assert BO.train_boosters(df, ["a"], rounds=2).count() > 6
    trees = next(p for p in paths if "booster-trees" in p)
    assert len([f for f in children(spark, trees) if f.startswith("part-")]) == 6   # a task a model
    assert set(written) == {"booster-rows", "booster-tree"} and not any("true" in line for p in written.values()
                                                                         for line in p.splitlines() if "Repartition" in line)
