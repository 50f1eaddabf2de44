"""Feature assembly, training frame, label encoding and the model matrix
(J9, P9-P13, M1, M2, S17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock import settings as S
from paddock.operators import lots as L
from paddock.operators import medians as M
from paddock.operators import pointintime as P
from paddock.session import saved, work_path
from paddock.sources.regions import region_hist
from paddock.settings import Settings

KEYS = ["country_code", "sale_date"]


def feature_blocks(base: DataFrame, history: DataFrame, regions: DataFrame, scope: str = "set",
                   year_start: int | None = None, hot: DataFrame | None = None):
    """``year_start``: the first year of ``base``; the 36-month blocks read history from three years before it.
    ``hot``: the crowded keys, where a table of them is at hand."""
    hm = region_hist(regions, scope)
    late = P.recent(history, None if year_start is None else year_start - 3)
    sire = P.sire_metrics(base, late, hm, regions, hot=hot)
    dam = P.dam_stats(base, history, hm, hot=hot)
    vendor = P.vendor_metrics(base, late, hm, hot=hot)
    # each is written by a job of its own, whose shuffled files go before the next one
    return tuple(saved(b, work_path(base.sparkSession, f"{k}-block")) for k, b in (("sire", sire), ("dam", dam), ("vendor", vendor)))


def assemble(base: DataFrame, medians: DataFrame, sire: DataFrame, dam: DataFrame, vendor: DataFrame,
             with_deltas: bool = True) -> DataFrame:
    """Lots left-joined to the three blocks on (country, key, as-of); NULL key -> NULL block.

    The medians, one row a sale, are written: their size is known where they are joined, so that lots aren't dealt by sale where
    they fit a broadcast. The narrowest block comes first, as later joins deal what earlier ones added.
    """
    medians = saved(medians.select("sale_id", "session_median_price"), work_path(base.sparkSession, "session-medians"))
    f = base.join(medians, "sale_id", "left")
    for block, key in ((dam, "dam_id"), (vendor, "vendor_id"), (sire, "sire_id")):
        f = f.join(block, KEYS + [key], "left")
    if with_deltas:
        m = F.col("session_median_price")
        f = (f.withColumn("sire_vs_sale_median_delta", F.col("sire_median_price_36m") - m)
             .withColumn("dam_vs_sale_median_delta", F.col("dam_progeny_median_price") - m)
             .withColumn("vendor_vs_sale_median_delta", F.col("vendor_median_price_36m") - m))
    return f


def lot_features(lots: DataFrame, regions: DataFrame, settings: Settings,
                 overrides: DataFrame | None = None, use_prior_year: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """Scoring features for every lot of every sale in the year range (the inference rows)."""
    base = L.base_lots(lots, settings)
    history = L.yearling_history(lots, settings.lot_type)
    medians = M.session_median_final(base, lots, overrides, use_prior_year, settings.lot_type)
    sire, dam, vendor = feature_blocks(base, history, regions, "set", settings.year_start, hot)
    return assemble(base, medians, sire, dam, vendor, with_deltas=True)


def training_frame(lots: DataFrame, regions: DataFrame, settings: Settings, scope: str = "own",
                   hot: DataFrame | None = None) -> DataFrame:
    """S17 + P9/P10: sold lots with point-in-time features and ``log_price_index``.

    Training history is the own country (``scope='own'``), as the reference trains.
    """
    base = L.training_lots(lots, settings)
    history = L.yearling_history(lots, settings.lot_type)
    medians = M.session_median(base)
    sire, dam, vendor = feature_blocks(base, history, regions, scope, settings.year_start, hot)
    f = assemble(base, medians, sire, dam, vendor, with_deltas=False)
    y = F.log(F.col("price") / F.col("session_median_price"))
    return (f.withColumn("log_price_index", y)
            .where((F.col("session_median_price") > 0) & (F.col("price") > 0)
                   & F.col("log_price_index").isNotNull() & ~F.isnan("log_price_index")))


def fit_label_encoder(frame: DataFrame, group_cols: list[str] = ("country_code",),
                      columns: list[str] = tuple(S.CATEGORICAL_COLS)) -> DataFrame:
    """Per group, sorted distinct values -> 0..k-1 (NULL encodes as 'Unknown').

    Returns the encoder as data: (group..., feature, value, code). Only distinct
    values travel; the window runs over that tiny table.
    """
    group_cols = list(group_cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value"))
                      for c in columns])
    vals = frame.select(*group_cols, F.explode(pairs).alias("_p")).select(*group_cols, "_p.feature", "_p.value").distinct()
    w = Window.partitionBy(*group_cols, "feature").orderBy("value")
    return vals.withColumn("code", (F.dense_rank().over(w) - 1).cast("int"))


def apply_label_encoder(frame: DataFrame, encoder: DataFrame, group_cols: list[str] = ("country_code",),
                        columns: list[str] = tuple(S.CATEGORICAL_COLS)) -> DataFrame:
    """Adds ``<col>_encoded``; values unseen at fit time get code k (handleInvalid='keep')."""
    group_cols = list(group_cols)
    sizes = encoder.groupBy(*group_cols).agg(*[F.count(F.when(F.col("feature") == c, 1)).cast("int").alias(f"__k_{c}")
                                               for c in columns])
    out = frame.join(sizes, group_cols, "left")
    for c in columns:
        e = (encoder.where(F.col("feature") == c)
             .select(*group_cols, F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"{c}_encoded")))
        out = (out.withColumn(f"__v_{c}", F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
               .join(e, group_cols + [f"__v_{c}"], "left")
               .withColumn(f"{c}_encoded", F.coalesce(F.col(f"{c}_encoded"), F.col(f"__k_{c}"), F.lit(0)))
               .drop(f"__v_{c}", f"__k_{c}"))
    return out


def _number(c: str):
    """The column as a number: NULL, NaN and text that is no number count as 0."""
    return F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def model_matrix(frame: DataFrame, feature_cols: list[str] = tuple(S.FEATURE_COLS),
                 keep: list[str] = ()) -> DataFrame:
    """M2 + P12/P13: ordered numeric feature columns, NULL/absent/non-numeric -> 0."""
    have = set(frame.columns)
    cols = [F.col(c) for c in keep if c in have]
    for c in feature_cols:
        if c in have:
            v = _number(c)
        elif c.startswith("log_") and c[4:] in have:
            v = F.log1p(_number(c[4:]))
        else:
            v = F.lit(0.0)
        cols.append(v.alias(c))
    return frame.select(*cols)


def listed_matrix(frame: DataFrame, lists: DataFrame, keep: list[str] = ()) -> DataFrame:
    """M2 for models that each bring their own feature list: keep..., model, ``x`` (the model's values in its own order).

    ``lists`` is (country_code, model, features array, further columns that are kept); a lot gets a row for every model of its
    country, all in one pass. Features that the frame lacks, nulls and text that is no number are 0, as in ``model_matrix``.
    """
    models = lists.collect()                                       # one row a model
    names = sorted({f for m in models for f in m["features"]})
    place = {f: i + 1 for i, f in enumerate(names)}
    spark = frame.sparkSession
    schema = T.StructType([*lists.schema, T.StructField("_places", T.ArrayType(T.IntegerType()))])
    placed = spark.createDataFrame([(*m, [place[f] for f in m["features"]]) for m in models], schema)
    more = [c for c in lists.columns if c not in ("country_code", "model", "features")]
    rows = model_matrix(frame, names, list(dict.fromkeys([*keep, "country_code"])))
    rows = rows.withColumn("_all", F.array(*[F.col(f"`{f}`") for f in names]) if names else F.array().cast("array<double>"))
    out = rows.join(F.broadcast(placed), "country_code")           # one row a model
    return out.select(*keep, "model", F.transform("_places", lambda p: F.element_at("_all", p)).alias("x"), *more)


def linear_score(x: str = "x", weights: str = "weights"):
    """The sum of the products of two arrays."""
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
