"""Typed sources: declared columns, exact decimals, ranges that hold every row once."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paddock.operators import salestats as ST
from paddock.sources import typed as TY

SF = "/root/testdata/sf0.001"


def lots(spark, rows):
    return spark.createDataFrame(rows, "sale_id long, price decimal(12,2), is_withdrawn int, is_passed_in int")


def test_columns_and_types(spark):
    df = spark.sql("SELECT '7' AS LOT_TYPE_ID, 'Yearling' AS lot_type_name, 1 AS more")
    got = TY.typed(df, "lot_types")
    assert got.schema == TY.schema("lot_types") or [f.dataType for f in got.schema] == [f.dataType for f in TY.schema("lot_types")]
    assert got.collect() == [(7, "Yearling")]
    with pytest.raises(ValueError, match="lot_type_name"):
        TY.typed(df.drop("lot_type_name"), "lot_types")
    with pytest.raises(Exception):
        TY.typed(spark.sql("SELECT 1 AS sale_id, 1e12 AS session_median_override"), "session_overrides").collect()
    got = TY.typed(spark.sql("SELECT 1 AS sale_id, '0.125' AS session_median_override"), "session_overrides").first()
    assert got["session_median_override"] == Decimal("0.13")


def test_csv_by_header(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="paddock-test-"), "lot_types.csv")
    with open(path, "w") as f:
        f.write("extra,lot_type_name,lot_type_id\nx,Yearling,1\ny,,\n")
    assert sorted(TY.read_csv(spark, path, "lot_types").collect(), key=str) == [(1, "Yearling"), (None, None)]
    with open(path, "a") as f:
        f.write("z,Weanling,two\n")
    with pytest.raises(Exception):
        TY.read_csv(spark, path, "lot_types").collect()


@pytest.mark.parametrize("parts", [1, 2, 7, 100])
def test_ranges_hold_every_row_once(spark, parts):
    rows = spark.range(-20, 60).select(F.col("id").cast("int").alias("n"), F.date_add(F.lit(dt.date(1999, 12, 20)), F.col("id").cast("int")).alias("d"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS INT) AS n, CAST(NULL AS DATE) AS d"))
    for column, low, high in (("n", 0, 40), ("d", dt.date(2000, 1, 1), dt.date(2000, 1, 31)), ("n", 5, 5)):
        held = TY.ranges(column, low, high, parts)
        assert 1 <= len(held) <= parts
        hits = sum((F.when(F.expr(p), 1).otherwise(0) for p in held), F.lit(0))
        assert rows.where(hits != 1).count() == 0
    with pytest.raises(ValueError):
        TY.ranges("n", 2, 1, parts)


def test_database_read_is_narrow_and_typed():
    assert TY.jdbc_table("sires", "dbo.Horse") == "(SELECT horse_id, horse_name FROM dbo.Horse) sires_read"
    assert "price decimal(12,2)" in TY.jdbc_options("lot_rows")["customSchema"]


def test_exact_sums_whatever_the_partitioning(spark):
    rows = [(1, Decimal("0.10"), None, None)] * 7 + [(1, Decimal("9999999999.99"), 0, 0)] * 3 + [(1, Decimal("5.00"), 1, 0)]
    rows += [(2, None, 0, 0), (3, Decimal("0.01"), 0, 0), (3, Decimal("0.02"), 0, 0), (4, Decimal("1.00"), 0, 1)]
    want = {1: (10, Decimal("30000000000.67"), Decimal("3000000000.07"), Decimal("0.10"), Decimal("9999999999.99")),
            2: (0, Decimal("0.00"), None, None, None), 3: (2, Decimal("0.03"), Decimal("0.02"), Decimal("0.01"), Decimal("0.02")),
            4: (0, Decimal("0.00"), None, None, None)}
    for n in (1, 9):
        got = {r[0]: tuple(r)[1:] for r in ST.exact_price_stats(lots(spark, rows).repartition(n)).collect()}
        assert got == want
    assert ST.exact_price_stats(lots(spark, [])).count() == 0
