"""Model registry and activity log.

Training results are data: one metrics row per trained model (S13) and a long
importance table (S14), appended per run; a run's models get the next version of their country.
Listing a country's models is a join of the two with the region config (M20), as of any moment; the "active"
model is the region's configured model, matched case-insensitively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.rounding import py_round
from paddock.session import exists, saved, work_path

METRICS_SCHEMA = T.StructType([
    T.StructField("country_code", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("features_count", T.IntegerType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("validation_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("baseline_name", T.StringType()),
    T.StructField("baseline_train_mae", T.DoubleType()),
    T.StructField("baseline_train_r2", T.DoubleType()),
    T.StructField("baseline_test_r2", T.DoubleType()),
    T.StructField("naive_mae", T.DoubleType()),
    T.StructField("baseline_test_mae", T.DoubleType()),
    T.StructField("baseline_passes", T.BooleanType()),
    T.StructField("trees_q25", T.IntegerType()),
    T.StructField("trees_q50", T.IntegerType()),
    T.StructField("trees_q75", T.IntegerType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("raw_coverage_p25", T.DoubleType()),
    T.StructField("raw_coverage_p75", T.DoubleType()),
    T.StructField("offset_p25", T.DoubleType()),
    T.StructField("offset_p75", T.DoubleType()),
    T.StructField("calibrated_coverage_p25", T.DoubleType()),
    T.StructField("calibrated_coverage_p75", T.DoubleType()),
    T.StructField("mape", T.DoubleType()),
])

IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("country_code", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("quantile", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("gain", T.DoubleType()),
])

# A test set smaller than this is reported as unreliable (one source model had 28 rows).
MIN_TEST_ROWS = 100


def next_version(metrics: DataFrame | None, country_code: str) -> int:
    """Next version number = max existing version of the country + 1."""
    if metrics is None:
        return 1
    v = metrics.where(F.upper("country_code") == country_code.upper()).agg(F.max("version")).first()[0]
    return int(v or 0) + 1


def as_table(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the columns and types of a registry table; absent values are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def versioned(run: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """The metrics rows of a run with their version: the country's highest so far + 1, and a model name made of both.

    Several rows of a country are numbered in the order of ``generated_at``. A country without versions starts at 1.
    """
    order = Window.partitionBy(F.upper("country_code")).orderBy("generated_at")
    out = run.drop("version", "model").withColumn("_place", F.row_number().over(order))
    if metrics is None:
        last = F.lit(0)
    else:
        held = metrics.groupBy(F.upper("country_code").alias("_cc")).agg(F.max("version").alias("_last"))  # one row a country
        out = out.join(F.broadcast(held), F.upper("country_code") == F.col("_cc"), "left").drop("_cc")
        last = F.coalesce("_last", F.lit(0))
    out = out.withColumn("version", (last + F.col("_place")).cast("int")).drop("_last", "_place")
    return out.withColumn("model", F.concat(F.lower("country_code"), F.lit("_v"), F.col("version").cast("string")))


def append_run(metrics: DataFrame, importance: DataFrame, root: str) -> None:
    """S13/S14 sink: one training run's models as the next versions of their countries, and their importance.

    ``importance`` has a row for each (country, quantile, feature); it belongs to the version that this run makes. Rows
    are only ever added, partitioned by country; one run is appended at a time.
    """
    root = root.rstrip("/")
    spark = metrics.sparkSession
    held = read_registry(spark, root)
    made = as_table(versioned(metrics, None if held is None else held[0]), METRICS_SCHEMA)
    made = saved(made, work_path(spark, "registry-run"))   # one row a country; the tables below don't read what they write
    names = made.select("country_code", "model", "version")
    owned = as_table(importance.drop("model", "version").join(F.broadcast(names), "country_code"), IMPORTANCE_SCHEMA)
    owned.write.mode("append").partitionBy("country_code").parquet(f"{root}/model_importance")
    made.write.mode("append").partitionBy("country_code").parquet(f"{root}/model_metrics")


def read_registry(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(metrics, importance) of all versions, or None before the first run. Importance of a run that wrote no metrics is left out."""
    root = root.rstrip("/")
    if not exists(spark, f"{root}/model_metrics/_SUCCESS"):
        return None
    metrics = spark.read.schema(METRICS_SCHEMA).parquet(f"{root}/model_metrics").select(*METRICS_SCHEMA.names)
    importance = spark.read.schema(IMPORTANCE_SCHEMA).parquet(f"{root}/model_importance").select(*IMPORTANCE_SCHEMA.names)
    return metrics, importance.join(metrics.select("country_code", "version"), ["country_code", "version"], "left_semi")


def importance_maps(importance: DataFrame, digits: int = 2) -> DataFrame:
    """One row a version: ``importance_<quantile>``, a map of feature to gain rounded to ``digits``."""
    pair = F.struct("feature", py_round(F.col("gain"), digits).alias("gain"))
    of = lambda q: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("quantile") == q, pair)))).alias(f"importance_{q}")
    return importance.groupBy("country_code", "version").agg(*[of(q) for q in ("q25", "q50", "q75", "average")])


def versions(metrics: DataFrame, importance: DataFrame, regions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Every version of every country known at ``as_of`` (all without it): its values, importance maps, whether it is
    the country's latest and whether it is the configured one."""
    known = metrics if as_of is None else metrics.where(F.col("generated_at") <= F.lit(as_of))
    latest = known.groupBy("country_code").agg(F.max("version").alias("_latest"))                     # one row a country
    active = regions.select(F.upper("country_code").alias("_cc"), F.lower("model").alias("_active"))  # one row a region
    out = known.join(F.broadcast(latest), "country_code").join(importance_maps(importance), ["country_code", "version"], "left")
    out = out.join(F.broadcast(active), F.upper("country_code") == F.col("_cc"), "left")
    return (out.withColumn("is_latest", F.col("version") == F.col("_latest"))
            .withColumn("active", F.coalesce(F.lower("model") == F.col("_active"), F.lit(False)))
            .withColumn("small_test_set", F.col("test_rows") < MIN_TEST_ROWS).drop("_latest", "_cc", "_active"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """L4: per model, the ``n`` features with the highest average gain (ties by name)."""
    avg = importance.where(F.col("quantile") == "average")
    w = Window.partitionBy("country_code", "model").orderBy(F.col("gain").desc(), F.col("feature"))
    return avg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def model_listing(metrics: DataFrame, importance: DataFrame, regions: DataFrame) -> DataFrame:
    """Every model with its metrics, its top feature and the active mark."""
    top1 = top_features(importance, 1).select("country_code", "model", F.col("feature").alias("top_feature"))
    act = F.broadcast(regions.select(F.upper("country_code").alias("country_code"),
                                     F.lower("model").alias("_active_model")))
    return (metrics.join(top1, ["country_code", "model"], "left")
            .join(act, "country_code", "left")
            .withColumn("active", F.coalesce(F.lower("model") == F.col("_active_model"), F.lit(False)))
            .withColumn("small_test_set", F.col("test_rows") < MIN_TEST_ROWS)
            .drop("_active_model"))


ACTIVITY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """JSONL activity log; malformed lines are kept aside, not fatal.

    Adds ``line_no`` (file name, place of the split in the file, line) so "the last N" is well defined.
    """
    df = (spark.read.schema(ACTIVITY_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.withColumn("line_no", F.struct(F.col("_metadata.file_name").alias("file"),
                                             F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("line")))


def parse_activity(lines: DataFrame, text: str = "value", line_no: str = "line_no") -> DataFrame:
    """S12 from a DataFrame of lines (text, line_no); malformed lines keep their text in ``_corrupt_record``."""
    fields = T.StructType([f for f in ACTIVITY_SCHEMA if f.name != "_corrupt_record"])
    parsed = F.from_json(F.col(text), T.StructType([*fields, ACTIVITY_SCHEMA["_corrupt_record"]]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(F.length(F.trim(F.col(text))) > 0).select(parsed.alias("_l"), F.col(line_no).alias("line_no")).select(
        "_l.*", "line_no")


def recent_activity(log: DataFrame, limit: int = 50, category: str | None = None,
                    status: str | None = None) -> DataFrame:
    """P14 + L3: parsed entries, optional filters, the last ``limit`` in file order."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    required = ["timestamp", "user", "action", "detail"]
    ok = log.where(F.col("_corrupt_record").isNull())
    for c in required:
        ok = ok.where(F.col(c).isNotNull())
    # fixed values: an entry without category/status counts as "general" / "success"
    ok = (ok.withColumn("category", F.coalesce(F.col("category"), F.lit("general")))
          .withColumn("status", F.coalesce(F.col("status"), F.lit("success"))))
    if category:
        ok = ok.where(F.col("category") == category)
    if status:
        ok = ok.where(F.col("status") == status)
    return ok.orderBy(F.col("line_no").desc()).limit(limit).orderBy("line_no").drop("_corrupt_record")


def activity_total(spark: SparkSession, path: str) -> int:
    """``total_in_file``: every line of the file, parsed, malformed or blank (the text source keeps blanks)."""
    return spark.read.text(path).count()
