"""Region configuration (S11) and model offsets (S15) as small DataFrames.

The config is the reference's nested JSON (country -> struct). Spark reads it
with an explicit schema, explodes the map into one row per region and fills the
documented defaults. A region table is config-sized (one row per country), so it
may be broadcast by hint without a size check; other hinted broadcasts in the
library are preceded by a row-count check.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock import settings as S

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")
FIXTURE_REGIONS = os.path.join(RESOURCES, "regions_fixture.json")
FIXTURE_MODELS = os.path.join(RESOURCES, "models_fixture.json")

ELITE_T = T.StructType([
    T.StructField("threshold", T.DoubleType()),
    T.StructField("base_offset", T.DoubleType()),
    T.StructField("scaling_factor", T.DoubleType()),
])
TIERS_T = T.StructType([
    T.StructField("close_threshold", T.DoubleType()),
    T.StructField("extreme_threshold", T.DoubleType()),
])
REGION_T = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("currency_id", T.LongType()),
    T.StructField("hist_countries", T.ArrayType(T.StringType())),
    T.StructField("elite_scaling", ELITE_T),
    T.StructField("confidence_tiers", TIERS_T),
    T.StructField("sire_sample_min_count", T.LongType()),
])
CONFIG_T = T.StructType([
    T.StructField("year_start", T.LongType()),
    T.StructField("year_end", T.LongType()),
    T.StructField("model_test_last_years", T.LongType()),
    T.StructField("sale_history_years", T.LongType()),
    T.StructField("audit_user_id", T.LongType()),
    T.StructField("regions", T.MapType(T.StringType(), REGION_T)),
])
OFFSETS_T = T.StructType([
    T.StructField("offset_p25", T.DoubleType()),
    T.StructField("offset_p75", T.DoubleType()),
    T.StructField("elite_scaling", ELITE_T),
])
MODELS_T = T.StructType([T.StructField("models", T.MapType(T.StringType(), OFFSETS_T))])


def region_dim(spark: SparkSession, path: str = FIXTURE_REGIONS) -> DataFrame:
    """One row per region, absent fields filled with the documented defaults."""
    cfg = spark.read.schema(CONFIG_T).option("multiLine", True).json(path)
    r = cfg.select(F.explode("regions").alias("country_code", "r"))
    return r.select(
        F.upper("country_code").alias("country_code"),
        F.col("r.model").alias("model"),
        F.col("r.currency_id").alias("currency_id"),
        F.coalesce(F.col("r.hist_countries"), F.array(F.upper("country_code"))).alias("hist_countries"),
        F.coalesce(F.col("r.elite_scaling.threshold"), F.lit(S.DEFAULT_ELITE_THRESHOLD)).alias("elite_threshold"),
        F.coalesce(F.col("r.elite_scaling.base_offset"), F.lit(S.DEFAULT_ELITE_BASE_OFFSET)).alias("elite_base_offset"),
        F.coalesce(F.col("r.elite_scaling.scaling_factor"), F.lit(S.DEFAULT_ELITE_SCALING_FACTOR)).alias("elite_scaling_factor"),
        F.coalesce(F.col("r.confidence_tiers.close_threshold"), F.lit(S.DEFAULT_CLOSE_THRESHOLD)).alias("close_threshold"),
        F.coalesce(F.col("r.confidence_tiers.extreme_threshold"), F.lit(S.DEFAULT_EXTREME_THRESHOLD)).alias("extreme_threshold"),
        F.coalesce(F.col("r.sire_sample_min_count"), F.lit(S.DEFAULT_SIRE_SAMPLE_MIN_COUNT)).cast("long").alias("sire_sample_min_count"),
    )


def region_hist(regions: DataFrame, scope: str = "set") -> DataFrame:
    """(country_code, hist_country): the lookback country set.

    ``scope='set'`` is the scoring rule (configured country set); ``'own'`` is
    the training rule (own country only).
    """
    if scope == "own":
        return regions.select("country_code", F.col("country_code").alias("hist_country"))
    return regions.select("country_code", F.explode("hist_countries").alias("hist_country")).distinct()


def model_offsets(spark: SparkSession, regions: DataFrame, path: str = FIXTURE_MODELS) -> DataFrame:
    """Per region: the model's calibration offsets and effective elite scaling.

    A model-level elite block overrides the region's (J14, S15).
    """
    m = spark.read.schema(MODELS_T).option("multiLine", True).json(path)
    m = m.select(F.explode("models").alias("model", "o"))
    j = regions.join(F.broadcast(m), "model", "left")
    has_model_elite = F.col("o.elite_scaling").isNotNull()
    return j.select(
        "country_code", "model",
        F.col("o.offset_p25").alias("offset_p25"),
        F.col("o.offset_p75").alias("offset_p75"),
        has_model_elite.alias("model_elite"),
        F.when(has_model_elite, F.coalesce(F.col("o.elite_scaling.threshold"), F.lit(S.DEFAULT_ELITE_THRESHOLD)))
         .otherwise(F.col("elite_threshold")).alias("elite_threshold"),
        F.when(has_model_elite, F.coalesce(F.col("o.elite_scaling.base_offset"), F.lit(S.DEFAULT_ELITE_BASE_OFFSET)))
         .otherwise(F.col("elite_base_offset")).alias("elite_base_offset"),
        F.when(has_model_elite, F.coalesce(F.col("o.elite_scaling.scaling_factor"), F.lit(S.DEFAULT_ELITE_SCALING_FACTOR)))
         .otherwise(F.col("elite_scaling_factor")).alias("elite_scaling_factor"),
        # the score summary counts elite lots at the model's threshold or a fixed fallback
        F.coalesce(F.col("o.elite_scaling.threshold"), F.lit(S.SUMMARY_ELITE_FALLBACK_THRESHOLD)).alias("summary_elite_threshold"),
        "close_threshold", "extreme_threshold", "currency_id",
    )


def load_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
