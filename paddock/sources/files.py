"""File sources and sinks (S6-S8): CSV training data in, inference/scored rows out.

Schemas are declared, never inferred. Sinks write one directory per
``sale_id`` in one job and leave the other sales' directories alone. Rows are
range-split by (sale, lot number): a very large sale is written by several tasks,
and the order of its files is the order of its lots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pyspark.sql import functions as F

from paddock import settings as S

def _by_sale(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("sale_id", "lot_number").sortWithinPartitions("sale_id", "lot_number")


_LONG = {"lot_id", "horse_id", "sale_id", "sale_year", "lot_number", "book_number", "day_number"}
_STR = {"sex", "horse_name", "sire_name", "sale_company", "vendor_volume_bucket", "sale_name", "country_code"}


def training_csv_schema() -> T.StructType:
    cols = list(dict.fromkeys(S.INFERENCE_EXPORT_COLS + ["log_price_index", "price", "sale_name", "country_code"]))
    fields = []
    for c in cols:
        t = T.LongType() if c in _LONG else T.StringType() if c in _STR else T.DoubleType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """A training export read back by its header; declared columns it lacks are NULL, text that is no number too."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
                        for f in training_csv_schema().fields])


def write_inference(features: DataFrame, path: str) -> None:
    """Keep the export columns that exist, one CSV per sale, ordered by lot number."""
    cols = [c for c in S.INFERENCE_EXPORT_COLS if c in features.columns]
    out = features.select(*cols) if "sale_id" in cols else features.select(*cols, "sale_id")
    _by_sale(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sale_id").option("header", True).csv(path)


def write_scored(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Full score rows per sale (CSV or parquet)."""
    w = _by_sale(scored).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sale_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_training(frame: DataFrame, path: str) -> None:
    """S17 export: the training frame as CSV with the columns S6 reads back."""
    cols = [f.name for f in training_csv_schema().fields if f.name in frame.columns]
    frame.select(*cols).write.mode("overwrite").option("header", True).csv(path)

