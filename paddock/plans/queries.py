"""Registered queries: name -> (spark plan, DuckDB oracle SQL or None).

Every plan reads the fixture tables Spark derived from the given parquet and
runs over all sales, all lots and all years.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import features as FT
from paddock.operators import lots as L
from paddock.operators import medians as M
from paddock.operators import pointintime as P
from paddock.plans import oracle as O
from paddock.plans.context import Context
from paddock.session import saved, work_path
from paddock.sources.regions import region_hist
from paddock.sources.store import PredictionStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _python_rounding(sql: str) -> str:
    """``round_even(x, d)`` as SQL: printing with d places rounds the exact binary value, half to even, as Python does;
    adding 0.0 drops the sign of a zero."""
    out, i, key = [], 0, "round_even("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, comma = 0, j + len(key) - 1, 0
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            elif sql[k] == "," and depth == 1:
                comma = k
            k += 1
        value, digits = _python_rounding(sql[j + len(key):comma]), sql[comma + 1:k].strip()
        out.append(f"{sql[i:j]}(CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE) + 0.0)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Context.of(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = _python_rounding(sql)
        return fn
    return deco


# ------------------------------------------------------------------ scans (S, P, J1-J3)

@register("lot_flags", O.with_() + """
SELECT lot_id, sale_id,
  CASE WHEN price > 0 AND coalesce(is_passed_in,0) = 0 AND coalesce(is_withdrawn,0) = 0 THEN 1 ELSE 0 END AS sold_flag,
  CASE WHEN coalesce(is_passed_in,0) = 1 THEN 1 ELSE 0 END AS passed_in_flag,
  CASE WHEN coalesce(is_withdrawn,0) = 0 THEN 0 ELSE 1 END AS withdrawn_flag
FROM lot_rows""")
def q_lot_flags(c: Context):
    return L.lot_flags(c.t("lot_rows"))


BASE_COLS = ["lot_id", "sale_id", "sale_date", "company_id", "sale_company", "sale_name", "sale_year",
             "book_number", "day_number", "lot_number", "sex", "sire_id", "dam_id", "vendor_id", "horse_id",
             "horse_name", "sire_name", "price", "sold_flag", "passed_in_flag"]


def _base_out(df, *more):
    return df.select(*more, *BASE_COLS,
                     F.coalesce("is_passed_in", F.lit(0)).alias("is_passed_in"),
                     F.coalesce("is_withdrawn", F.lit(0)).alias("is_withdrawn"))


_BASE_SQL_COLS = ", ".join(BASE_COLS) + ", coalesce(is_passed_in, 0) AS is_passed_in, coalesce(is_withdrawn, 0) AS is_withdrawn"


@register("base_lots", O.with_() + f"SELECT {_BASE_SQL_COLS} FROM base")
def q_base_lots(c: Context):
    return _base_out(c.base)


_BASE_DECIMAL_COLS = ", ".join("CAST(price AS DECIMAL(12,2)) AS price" if c.strip() == "price" else c for c in _BASE_SQL_COLS.split(","))


@register("base_lots_typed", O.with_() + f"SELECT {_BASE_DECIMAL_COLS} FROM base")
def q_base_lots_typed(c: Context):
    return _base_out(L.base_lots(c.typed_lots, c.settings))


@register("hist_lots", O.with_() + """
SELECT rh.country_code AS scope_country, h.lot_id, h.sale_id, h.sale_date, h.sire_id, h.dam_id, h.vendor_id,
  h.price, h.sold_flag, h.passed_in_flag
FROM hist h JOIN region_hist rh ON rh.hist_country = h.country_code""")
def q_hist_lots(c: Context):
    return L.hist_lots(c.lots, region_hist(c.regions, "set"), c.settings).select(
        "scope_country", "lot_id", "sale_id", "sale_date", "sire_id", "dam_id", "vendor_id",
        "price", "sold_flag", "passed_in_flag")


@register("training_lots", O.with_() + f"""
SELECT country_code, {_BASE_SQL_COLS} FROM base WHERE coalesce(is_passed_in, 0) = 0 AND price > 0""")
def q_training_lots(c: Context):
    return _base_out(L.training_lots(c.lots, c.settings), "country_code")


@register("training_hist", O.with_() + """
SELECT country_code AS scope_country, lot_id, sale_id, sale_date, sire_id, dam_id, vendor_id, price,
  sold_flag, passed_in_flag
FROM hist WHERE country_code IN (SELECT country_code FROM regions)""")
def q_training_hist(c: Context):
    return L.hist_lots(c.lots, region_hist(c.regions, "own"), c.settings).select(
        "scope_country", "lot_id", "sale_id", "sale_date", "sire_id", "dam_id", "vendor_id",
        "price", "sold_flag", "passed_in_flag")


@register("sale_country", O.with_() + """
SELECT s.sale_id, ct.country_code FROM sales s JOIN countries ct ON s.country_id = ct.country_id""")
def q_sale_country(c: Context):
    return L.sale_country(c.t("sales"), c.t("countries"))


@register("sale_header", O.with_() + f"""
SELECT s.sale_id, s.sale_code, s.sale_name, s.start_date, s.end_date, s.is_online, s.is_public,
  s.company_id AS sales_company_id, s.sale_type_id AS sales_type_id, co.company_name AS sale_company,
  co.website AS company_website, ct.country_code, ct.country_name, cu.currency_code, cu.currency_symbol,
  st.status AS sale_status, ty.sale_type_name AS sale_type,
  CASE WHEN s.start_date >= {O.TODAY} THEN 'upcoming' ELSE 'past' END AS status
FROM sales s JOIN countries ct ON s.country_id = ct.country_id JOIN companies co ON s.company_id = co.company_id
LEFT JOIN currencies cu ON ct.currency_id = cu.currency_id LEFT JOIN sale_statuses st ON s.status_id = st.status_id
LEFT JOIN sale_types ty ON s.sale_type_id = ty.sale_type_id""")
def q_sale_header(c: Context):
    return L.sale_header(c.t("sales"), c.t("companies"), c.t("countries"), c.t("currencies"),
                         c.t("sale_statuses"), c.t("sale_types"), c.settings)


# ------------------------------------------------------------------ medians

@register("session_median", O.with_() + """
SELECT sale_id, quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5) AS session_median_price
FROM base GROUP BY sale_id""")
def q_session_median(c: Context):
    return M.session_median(c.base)


@register("prior_year_median", O.with_() + """
SELECT sale_name, sale_year + 1 AS sale_year, CASE WHEN m <> 0 THEN m END AS prior_year_median
FROM (SELECT sale_name, sale_year, quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5) AS m
      FROM hist GROUP BY sale_name, sale_year) x""")
def q_prior_year_median(c: Context):
    return M.prior_year_median(c.lots, c.settings.lot_type)


@register("session_median_final", O.with_() + O.MEDIANS + " SELECT * FROM med")
def q_session_median_final(c: Context):
    return M.session_median_final(c.base, c.yearlings, c.t("session_overrides"))


# ------------------------------------------------------------------ point-in-time

def _sire(c: Context, months):
    return P.sire_metrics(c.base, P.recent(c.history, c.settings.year_start - 3), region_hist(c.regions, "set"), c.regions, months, c.hot_keys)


@register("sire_metrics_36m", O.with_() + O.sire_sql((36,)) + " SELECT * FROM sire")
def q_sire_36(c: Context):
    return _sire(c, (36,))


@register("sire_metrics_12m", O.with_() + O.sire_sql((12,)) + " SELECT * FROM sire")
def q_sire_12(c: Context):
    return _sire(c, (12,))


@register("sire_metrics", O.with_() + O.sire_sql() + " SELECT * FROM sire_full")
def q_sire(c: Context):
    return _sire(c, (36, 12))


@register("dam_stats", O.with_() + O.dam_sql() + " SELECT * FROM dam")
def q_dam(c: Context):
    return P.dam_stats(c.base, c.history, region_hist(c.regions, "set"), c.hot_keys)


@register("vendor_metrics", O.with_() + O.vendor_sql() + " SELECT * FROM vendor")
def q_vendor(c: Context):
    return P.vendor_metrics(c.base, P.recent(c.history, c.settings.year_start - 3), region_hist(c.regions, "set"), hot=c.hot_keys)


FEATURE_OUT = ["lot_id", "sale_id", "country_code", "sale_date", "session_median_price",
               "sire_sold_count_36m", "sire_total_offered_36m", "sire_clearance_rate_36m", "sire_median_price_36m",
               "sire_sold_count_12m", "sire_total_offered_12m", "sire_clearance_rate_12m", "sire_median_price_12m",
               "sire_momentum", "sire_sample_flag_36m",
               "dam_progeny_sold_count", "dam_progeny_total_offered_count", "dam_progeny_median_price",
               "dam_first_foal_flag",
               "vendor_sold_count_36m", "vendor_total_offered_36m", "vendor_clearance_rate_36m",
               "vendor_median_price_36m", "vendor_volume_bucket", "vendor_first_seen_flag",
               "sire_vs_sale_median_delta", "dam_vs_sale_median_delta", "vendor_vs_sale_median_delta"]


def all_features(c: Context) -> DataFrame:
    lots, overrides, hot = c.yearlings, c.t("session_overrides"), c.hot_keys
    with c.fx.sized():
        return FT.lot_features(lots, c.regions, c.settings, overrides, hot=hot)


def features_df(c: Context):
    return c.fx.derived("lot_features", lambda: all_features(c))


@register("lot_features", O.with_() + O.FEATURES + f" SELECT {', '.join(FEATURE_OUT)} FROM feat")
def q_lot_features(c: Context):
    return all_features(c).select(*FEATURE_OUT)


# ------------------------------------------------------------------ scoring

from paddock.functions.rounding import py_round  # noqa: E402
from paddock.operators import fuzzy as FZ  # noqa: E402
from paddock.operators import predictions as PR  # noqa: E402
from paddock.operators import salestats as ST  # noqa: E402
from paddock.operators import scoring as SC  # noqa: E402


def scored_df(c: Context, features: DataFrame | None = None) -> DataFrame:
    f = features if features is not None else all_features(c)
    return SC.score(SC.fixed_model(SC.scorable(f)), c.offsets, c.settings)


SCORE_COLS = ["lot_id", "horse_id", "sale_id", "country_code", "lot_number", "book_number", "sex",
              "horse_name", "sire_name", "session_median_price", "mv_expected_price", "mv_low_price",
              "mv_high_price", "mv_raw_price", "mv_confidence_tier", "mv_model_version"]


@register("score_lots", O.with_() + O.SCORE + f" SELECT {O.SCORE_OUT} FROM scored")
def q_score_lots(c: Context):
    s = scored_df(c)
    return s.select(*SCORE_COLS, *[py_round(F.col(x), 6).alias(x)
                                   for x in ("mv_expected_index", "mv_low_index", "mv_high_index")])


@register("elite_scaling", O.with_() + O.SCORE + """
SELECT lot_id, sale_id, country_code, mv_raw_price, round_even(elite_offset, 6) AS elite_offset,
  elite_offset > 0 AS elite_applied FROM scored""")
def q_elite_scaling(c: Context):
    s = scored_df(c)
    return s.select("lot_id", "sale_id", "country_code", "mv_raw_price",
                    py_round(F.col("elite_offset"), 6).alias("elite_offset"),
                    (F.col("elite_offset") > 0).alias("elite_applied"))


@register("confidence_tier", O.with_() + O.SCORE + """
SELECT lot_id, sale_id, flags AS flag_count, distance_band, mv_confidence_tier FROM scored""")
def q_confidence_tier(c: Context):
    f = all_features(c)
    p = SC.fixed_model(SC.scorable(f)).join(F.broadcast(c.offsets.select(
        "country_code", "close_threshold", "extreme_threshold")), "country_code")
    a = F.abs(F.col("pred_q50"))
    band = (F.when(a < F.col("close_threshold"), "close").when(a < F.col("extreme_threshold"), "moderate")
            .otherwise("extreme"))
    return p.select("lot_id", "sale_id", SC.flag_count().alias("flag_count"), band.alias("distance_band"),
                    SC.confidence_tier(a, SC.flag_count(), F.col("close_threshold"),
                                       F.col("extreme_threshold")).alias("mv_confidence_tier"))


@register("score_summary", O.with_() + O.SCORE + """
SELECT sale_id, count(*) AS total_lots, sum(mv_low_price) AS gross_low, sum(mv_expected_price) AS gross_expected,
  sum(mv_high_price) AS gross_high, quantile_cont(mv_low_price, 0.5) AS median_low,
  quantile_cont(mv_expected_price, 0.5) AS median_expected, quantile_cont(mv_high_price, 0.5) AS median_high,
  CAST(sum(CASE WHEN mv_confidence_tier = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS tier_high,
  CAST(sum(CASE WHEN mv_confidence_tier = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS tier_medium,
  CAST(sum(CASE WHEN mv_confidence_tier = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS tier_low,
  CAST(sum(CASE WHEN mv_expected_price >= summary_elite_threshold THEN 1 ELSE 0 END) AS BIGINT) AS elite_scaling_count,
  round_even(CAST(100.0 AS DOUBLE) * sum(CASE WHEN mv_expected_price >= summary_elite_threshold THEN 1 ELSE 0 END)
             / count(*), 2) AS elite_scaling_percent
FROM scored GROUP BY sale_id""")
def q_score_summary(c: Context):
    return SC.score_summary(scored_df(c), c.offsets)


@register("unscorable_sales", O.with_() + """
, own AS (SELECT sale_id, quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5) AS m
          FROM base GROUP BY sale_id)
SELECT b.sale_id, count(*) AS lot_count
FROM base b LEFT JOIN own ON own.sale_id = b.sale_id LEFT JOIN session_overrides o ON o.sale_id = b.sale_id
GROUP BY b.sale_id
HAVING max(CASE WHEN coalesce(o.session_median_override, own.m) IS NOT NULL
                 AND coalesce(o.session_median_override, own.m) <> 0 THEN 1 ELSE 0 END) = 0""")
def q_unscorable_sales(c: Context):
    med = M.session_median_final(c.base, c.yearlings, c.t("session_overrides"), False, c.settings.lot_type)
    return SC.unscorable_sales(c.base.select("sale_id").join(med.select("sale_id", "session_median_price"), "sale_id", "left"))


from paddock.settings import FIXTURE_SETTINGS  # noqa: E402

SETTINGS_RUN = str(FIXTURE_SETTINGS.run_ts)

# ------------------------------------------------------------------ predictions

CMP_COLS = ["lot_id", "horse_id", "sale_id", "lot_number", "horse_name", "sire_name", "mv_expected_price", "is_new",
            "old_expected", "old_low", "old_high", "old_index", "old_tier", "old_session_median", "delta_expected",
            "delta_expected_pct", "delta_low", "delta_high", "changed"]


@register("compare_lots", O.with_() + O.COMPARE + f" SELECT {', '.join(CMP_COLS)} FROM cmp2")
def q_compare_lots(c: Context):
    return PR.compare(scored_df(c), c.t("predictions")).select(*CMP_COLS)


@register("compare_summary", O.with_() + O.COMPARE + """
SELECT sale_id, count(*) AS total_lots, CAST(sum(CAST(is_new AS INTEGER)) AS BIGINT) AS new_lots,
  count(*) - CAST(sum(CAST(is_new AS INTEGER)) AS BIGINT) AS existing_lots,
  CAST(sum(CAST(changed AS INTEGER)) AS BIGINT) AS changed_lots,
  count(*) - CAST(sum(CAST(is_new AS INTEGER)) AS BIGINT) - CAST(sum(CAST(changed AS INTEGER)) AS BIGINT)
    AS unchanged_lots,
  round_even(coalesce(avg(d_raw), 0.0), 2) AS avg_price_delta,
  round_even(coalesce(avg(pct_raw), 0.0), 2) AS avg_price_delta_pct
FROM cmp2 GROUP BY sale_id""")
def q_compare_summary(c: Context):
    return PR.compare_summary(PR.compare(scored_df(c), c.t("predictions")))


UPSERT_COLS = ["horse_id", "sale_id", "market_value", "market_value_low", "market_value_high", "confidence",
               "session_median_price", "currency_id", "created_by", "created_on", "modified_by", "modified_on", "action"]


@register("upsert_predictions", O.with_() + O.SCORE + O.BATCH.format(src="scored", audit=2, run=SETTINGS_RUN)
          + f" SELECT {', '.join(UPSERT_COLS)}, round_even(market_value_multiplier, 6) AS market_value_multiplier"
            " FROM snap")
def q_upsert_predictions(c: Context):
    snap = PR.upsert(c.t("predictions"), PR.batch_rows(scored_df(c)), c.regions, c.settings.audit_user_id, str(c.settings.run_ts))
    return snap.select(*UPSERT_COLS, py_round(F.col("market_value_multiplier"), 6).alias("market_value_multiplier"))


@register("commit_lots", O.with_() + O.SCORE + """
, chosen AS (SELECT * FROM scored WHERE mv_confidence_tier = 'high')""" + O.BATCH.format(src="chosen", audit=2, run=SETTINGS_RUN) + """
SELECT sale_id, CAST(sum(CASE WHEN action = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
  CAST(sum(CASE WHEN action = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS updated,
  CAST(sum(CASE WHEN action IN ('insert', 'update') THEN 1 ELSE 0 END) AS BIGINT) AS total
FROM snap WHERE action <> 'keep' GROUP BY sale_id""")
def q_commit_lots(c: Context):
    s = saved(scored_df(c), work_path(c.spark, "scored"))     # the selection and the commit both read it
    selection = s.where(F.col("mv_confidence_tier") == "high").select("sale_id", "lot_id")
    return PR.commit(c.t("predictions"), s, selection, c.regions, c.settings.audit_user_id, str(c.settings.run_ts))


STORE_RUNS = [(7, "2001-07-01 00:00:00"), (8, "2001-08-01 00:00:00")]
STORE_COLS = [x for x in UPSERT_COLS if x != "action"]


def _second(sql: str) -> str:
    """The CTEs of a batch on top of the ones before."""
    return sql.replace(" batch ", " batch2 ").replace("snap AS", "snap2 AS").replace("FROM predictions p", "FROM snap p")


@register("prediction_store", O.with_() + O.SCORE + """
, high AS (SELECT * FROM scored WHERE mv_confidence_tier = 'high')
, region_two AS (SELECT * FROM scored WHERE sale_id % 10 = 2)""" + O.BATCH.format(src="high", audit=STORE_RUNS[0][0], run=STORE_RUNS[0][1])
          + _second(O.BATCH.format(src="region_two", audit=STORE_RUNS[1][0], run=STORE_RUNS[1][1]))
          + f" SELECT {', '.join(STORE_COLS)}, round_even(market_value_multiplier, 6) AS market_value_multiplier FROM snap2")
def q_prediction_store(c: Context):
    """S9 + S10: a store is created from the stored predictions, upserted twice and read back."""
    store = PredictionStore(c.spark, work_path(c.spark, "predictions"))
    store.create(c.t("predictions"))
    scored = saved(scored_df(c), work_path(c.spark, "scored"))
    for lots, (user, at) in zip((F.col("mv_confidence_tier") == "high", F.col("sale_id") % 10 == 2), STORE_RUNS):
        store.upsert(scored.where(lots), c.regions, user, at)
    return store.read().select(*STORE_COLS, py_round(F.col("market_value_multiplier"), 6).alias("market_value_multiplier"))


@register("commit_rejected", O.with_() + O.SCORE + """
, asked AS (SELECT lot_id, CASE WHEN lot_id % 7 = 0 THEN sale_id + 1 ELSE sale_id END AS sale_id FROM base)
SELECT a.sale_id, a.lot_id, CASE WHEN s.lot_id IS NULL THEN 'not scored' ELSE 'other sale' END AS reason
FROM asked a LEFT JOIN scored s ON s.lot_id = a.lot_id WHERE s.lot_id IS NULL OR s.sale_id <> a.sale_id""")
def q_commit_rejected(c: Context):
    asked = c.base.select(
        "lot_id", F.when(F.col("lot_id") % 7 == 0, F.col("sale_id") + 1).otherwise(F.col("sale_id")).alias("sale_id"))
    return PR.rejected(asked, scored_df(c))


# ------------------------------------------------------------------ sale statistics

POOLED_ALL = "\n, pooled AS (SELECT sale_id, price, is_withdrawn, is_passed_in FROM lot_rows)\n"
STATS_ALL = O.with_() + POOLED_ALL + O.stats_sql("pooled", ["sale_id"], every="SELECT sale_id FROM sales")


def _stats(c: Context, *columns: str):
    return ST.sale_stats(c.t("lot_rows"), every=c.t("sales").select("sale_id"), columns=columns).select("sale_id", *columns)


@register("sale_lot_stats", STATS_ALL + """
SELECT sale_id, total_lots, sold_count, passed_in_count, withdrawn_count, clearance_rate FROM st""")
def q_sale_lot_stats(c: Context):
    return _stats(c, "total_lots", "sold_count", "passed_in_count", "withdrawn_count", "clearance_rate")


@register("sale_price_stats", STATS_ALL + """
SELECT sale_id, gross, avg_price, min_price, max_price, std_dev FROM st""")
def q_sale_price_stats(c: Context):
    return _stats(c, "gross", "avg_price", "min_price", "max_price", "std_dev")


@register("sale_price_stats_typed", O.with_() + """
, p AS (SELECT sale_id, CASE WHEN price > 0 AND coalesce(is_withdrawn, 0) = 0 AND coalesce(is_passed_in, 0) = 0
                             THEN CAST(price AS DECIMAL(12,2)) END AS price FROM lot_rows)
, g AS (SELECT sale_id, sum(price) AS total, CAST(sum(price) * 100 AS HUGEINT) AS cents, count(price) AS n,
               min(price) AS min_price, max(price) AS max_price FROM p GROUP BY sale_id)
SELECT sale_id, n AS sold_count, coalesce(total, 0) AS gross,
  CASE WHEN n > 0 THEN CAST(CAST((2 * cents + n) // (2 * n) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) END AS avg_price,
  min_price, max_price
FROM g""")
def q_sale_price_stats_typed(c: Context):
    return ST.exact_price_stats(c.typed("lot_rows"))


@register("sale_quartiles", STATS_ALL + "SELECT sale_id, q1_price, median_price, q3_price FROM st")
def q_sale_quartiles(c: Context):
    return _stats(c, "q1_price", "median_price", "q3_price")


@register("sale_price_bands", STATS_ALL + """
SELECT sale_id, under_50k, band_50k_100k, band_100k_200k, band_200k_500k, band_500k_1m, over_1m FROM st""")
def q_sale_price_bands(c: Context):
    return _stats(c, *ST.BAND_COLS)


@register("sale_top10_avg", STATS_ALL + "SELECT sale_id, top10_avg FROM st")
def q_sale_top10_avg(c: Context):
    return _stats(c, "top10_avg")


@register("sale_books", O.with_() + """
SELECT sale_id, CASE WHEN book_number IS NULL OR book_number = 0 THEN 1 ELSE book_number END AS book_number,
  day_number, lot_count
FROM (SELECT sale_id, book_number, day_number, count(*) AS lot_count FROM lot_rows
      GROUP BY sale_id, book_number, day_number) g""")
def q_sale_books(c: Context):
    return ST.sale_books(c.t("lot_rows"))


SEARCH_Q = "yearling"


@register("sale_search", O.with_() + f"""
, top AS (SELECT s.sale_id, s.sale_name, s.start_date, ct.country_code, cu.currency_code, co.company_name
          FROM sales s JOIN countries ct ON s.country_id = ct.country_id
          JOIN companies co ON s.company_id = co.company_id LEFT JOIN currencies cu ON ct.currency_id = cu.currency_id
          WHERE s.sale_name ILIKE '%{SEARCH_Q}%' OR co.company_name ILIKE '%{SEARCH_Q}%'
          ORDER BY s.start_date DESC, s.sale_id DESC LIMIT 20)
SELECT t.sale_id, t.sale_name, t.start_date AS sale_date, t.country_code, t.currency_code,
  t.company_name AS sale_company, coalesce(n.lot_count, 0) AS lot_count,
  CASE WHEN t.start_date >= {O.TODAY} THEN 'upcoming' ELSE 'past' END AS status
FROM top t LEFT JOIN (SELECT sale_id, count(*) AS lot_count FROM lot_rows GROUP BY sale_id) n ON n.sale_id = t.sale_id""")
def q_sale_search(c: Context):
    return ST.sale_search(SEARCH_Q, c.t("sales"), c.t("companies"), c.t("countries"), c.t("currencies"),
                          c.t("lot_rows"), c.settings)


@register("queue_stats", O.with_() + """
SELECT s.sale_id,
  CASE WHEN q.sale_id IS NOT NULL THEN coalesce(q.completed, 0) END AS completed,
  CASE WHEN q.sale_id IS NOT NULL THEN coalesce(q.in_queue, 0) END AS in_queue,
  CASE WHEN q.sale_id IS NOT NULL THEN coalesce(q.failed, 0) END AS failed,
  CASE WHEN q.sale_id IS NOT NULL THEN coalesce(q.postponed, 0) END AS postponed,
  strftime(q.last_completed, '%Y-%m-%d %H:%M:%S') AS last_completed
FROM sales s LEFT JOIN report_queue q ON q.sale_id = s.sale_id""")
def q_queue_stats(c: Context):
    return ST.queue_stats(c.t("sales"), c.t("report_queue"))


@register("sale_listing", O.with_() + """
SELECT sale_id, sale_name, sale_year, count(*) AS lots FROM base GROUP BY sale_id, sale_name, sale_year""")
def q_sale_listing(c: Context):
    return ST.sale_listing(c.base)


MEDIAN_PATTERN = "%Premier%Sale%"


@register("median_history", O.with_() + O.MEDIANS + f"""
SELECT DISTINCT b.sale_year, b.sale_name, med.session_median_price
FROM base b JOIN med ON med.sale_id = b.sale_id WHERE b.sale_name LIKE '{MEDIAN_PATTERN}'""")
def q_median_history(c: Context):
    med = M.session_median_final(c.base, c.yearlings, c.t("session_overrides"))
    f = c.base.select("sale_id", "sale_year", "sale_name").join(med.select("sale_id", "session_median_price"),
                                                                   "sale_id")
    return ST.median_history(f, MEDIAN_PATTERN)


@register("assign_books", O.with_() + """
SELECT lot_id, sale_id, lot_number, book_number AS book_number_before,
  CASE WHEN lot_number >= 1 AND lot_number <= 980 THEN 1 WHEN lot_number >= 981 THEN 2 ELSE book_number END
    AS book_number
FROM base""")
def q_assign_books(c: Context):
    return ST.assign_books(c.base)


@register("lot_type_volume", O.with_() + f"""
SELECT lot_type, country_code, count(*) AS total_lots,
  CAST(sum(sold_flag) AS BIGINT) AS sold_lots, CAST(GROUPING(lot_type, country_code) AS INTEGER) AS grouping_level,
  round_even(CAST(100.0 AS DOUBLE) * sum(sold_flag) / count(*), 1) AS clearance_pct
FROM lots WHERE sale_date >= {O.Y0} GROUP BY ROLLUP (lot_type, country_code)""")
def q_lot_type_volume(c: Context):
    return ST.lot_type_volume(c.lots, c.settings)


# ------------------------------------------------------------------ matching, YoY, history

YOY_COLS = ["sale_id", "prior_sale_count", "prior_start_date", "prior_end_date", "prior_total_lots",
            "prior_sold_count", "prior_clearance_rate", "prior_gross", "prior_avg_price", "prior_median_price",
            "gross_pct", "avg_price_pct", "median_price_pct", "sold_count_change", "clearance_rate_change"]


YOY_GROUPS = ("""
, pm AS (SELECT l.sale_id AS member_id, m.sale_id AS group_id, l.price, l.is_withdrawn, l.is_passed_in
         FROM lot_rows l JOIN m ON m.match_sale_id = l.sale_id)
, pooled_p AS (SELECT group_id, price, is_withdrawn, is_passed_in FROM pm)
, pooled_c AS (SELECT sale_id, price, is_withdrawn, is_passed_in FROM lot_rows
               WHERE sale_id IN (SELECT sale_id FROM m))""" + O.stats_sql("pooled_p", ["group_id"], "ps")
          + O.stats_sql("pooled_c", ["sale_id"], "cs") + """
, meta AS (SELECT sale_id, count(*) AS prior_sale_count, min(match_start_date) AS prior_start_date,
    string_agg(CAST(match_sale_id AS VARCHAR), ',' ORDER BY match_start_date, match_sale_id) AS prior_sale_ids,
    string_agg(match_sale_name, '|' ORDER BY match_start_date, match_sale_id) AS prior_sale_names,
                  max(match_end_date) AS prior_end_date FROM m GROUP BY sale_id)
""")
YOY_CHANGE = """  CASE WHEN cs.sold_count > 0 AND ps.sold_count > 0 AND cs.gross IS NOT NULL AND cs.gross <> 0 AND ps.gross > 0
       THEN round_even(CAST(100.0 AS DOUBLE) * (cs.gross - ps.gross) / ps.gross, 1) END AS gross_pct,
  CASE WHEN cs.sold_count > 0 AND ps.sold_count > 0 AND cs.avg_price IS NOT NULL AND cs.avg_price <> 0
            AND ps.avg_price > 0
       THEN round_even(CAST(100.0 AS DOUBLE) * (cs.avg_price - ps.avg_price) / ps.avg_price, 1) END AS avg_price_pct,
  CASE WHEN cs.sold_count > 0 AND ps.sold_count > 0 AND cs.median_price IS NOT NULL AND cs.median_price <> 0
            AND ps.median_price > 0
       THEN round_even(CAST(100.0 AS DOUBLE) * (cs.median_price - ps.median_price) / ps.median_price, 1) END
    AS median_price_pct,
  CASE WHEN cs.sold_count > 0 AND ps.sold_count > 0 THEN cs.sold_count - ps.sold_count END AS sold_count_change,
  CASE WHEN cs.sold_count > 0 AND ps.sold_count > 0 AND cs.clearance_rate IS NOT NULL
            AND ps.clearance_rate IS NOT NULL
       THEN round_even(cs.clearance_rate - ps.clearance_rate, 1) END AS clearance_rate_change
"""
YOY_FROM = "FROM meta JOIN ps ON ps.group_id = meta.sale_id LEFT JOIN cs ON cs.sale_id = meta.sale_id"


@register("sale_yoy", O.with_() + O.exact_matches(1, 1) + YOY_GROUPS + """
SELECT meta.sale_id, meta.prior_sale_ids, meta.prior_sale_names, meta.prior_sale_count, meta.prior_start_date, meta.prior_end_date,
  ps.total_lots AS prior_total_lots, ps.sold_count AS prior_sold_count, ps.clearance_rate AS prior_clearance_rate,
  ps.gross AS prior_gross, ps.avg_price AS prior_avg_price, ps.median_price AS prior_median_price,
""" + YOY_CHANGE + YOY_FROM)
def q_sale_yoy(c: Context):
    return _prior_lists(FZ.prior_year_block(c.t("sales"), c.t("lot_rows"), "exact", columns=["total_lots"])).select(
        *YOY_COLS, "prior_sale_ids", "prior_sale_names")


def _prior_lists(df):
    return df.withColumn("prior_sale_ids", F.array_join(F.transform("prior_sale_ids", lambda x: x.cast("string")), ",")) \
        .withColumn("prior_sale_names", F.array_join("prior_sale_names", "|"))


HIST_COLS = ["sale_id", "year", "start_date", "end_date", "total_lots", "sold_count", "passed_in_count",
             "withdrawn_count", "clearance_rate", "gross", "avg_price", "median_price", "q1_price", "q3_price",
             "top10_avg"]


def _history_out(df):
    return df.select(*HIST_COLS,
                     F.array_join(F.transform("sale_ids", lambda x: x.cast("string")), ",").alias("sale_ids"),
                     F.array_join("sale_names", "|").alias("sale_names"),
                     F.array_join(F.transform("sale_type_ids", lambda x: x.cast("string")), ",")
                      .alias("sale_type_ids"))


FIXTURE_YEARS = 5
HISTORY_SQL = ("""
, pooled_h AS (SELECT m.sale_id AS group_id, m.match_year AS year, l.price, l.is_withdrawn, l.is_passed_in
               FROM lot_rows l JOIN m ON m.match_sale_id = l.sale_id)""" + O.stats_sql("pooled_h", ["group_id", "year"], "hs") + """
, meta AS (SELECT sale_id, match_year AS year, min(match_start_date) AS start_date, max(match_end_date) AS end_date,
    string_agg(CAST(match_sale_id AS VARCHAR), ',' ORDER BY match_start_date, match_sale_id) AS sale_ids,
    string_agg(match_sale_name, '|' ORDER BY match_start_date, match_sale_id) AS sale_names,
    string_agg(CAST(match_sale_type_id AS VARCHAR), ',' ORDER BY match_start_date, match_sale_id) AS sale_type_ids
  FROM m GROUP BY sale_id, match_year)
SELECT meta.sale_id, meta.year, meta.start_date, meta.end_date, hs.total_lots, hs.sold_count, hs.passed_in_count,
  hs.withdrawn_count, hs.clearance_rate, hs.gross, hs.avg_price, hs.median_price, hs.q1_price, hs.q3_price,
  hs.top10_avg, meta.sale_ids, meta.sale_names, meta.sale_type_ids
FROM meta JOIN hs ON hs.group_id = meta.sale_id AND hs.year = meta.year""")


@register("sale_history", O.with_() + O.exact_matches(1, FIXTURE_YEARS) + HISTORY_SQL)
def q_sale_history(c: Context):
    return _history_out(FZ.history_block(c.t("sales"), c.t("lot_rows"), c.settings.sale_history_years, "exact"))


FUZZY = ST.S.FIXTURE_SETTINGS.similarity_threshold


@register("fuzzy_matches", O.with_recursive() + O.fuzzy_matches(1, FIXTURE_YEARS, FUZZY) + " SELECT * FROM m")
def q_fuzzy_matches(c: Context):
    return FZ.matches(c.t("sales"), 1, c.settings.sale_history_years, "fuzzy", c.settings.similarity_threshold)


@register("prior_year_stats", O.with_recursive() + O.fuzzy_matches(1, 1, FUZZY) + YOY_GROUPS + """
SELECT meta.sale_id, meta.prior_sale_ids, meta.prior_sale_names, meta.prior_sale_count, meta.prior_start_date, meta.prior_end_date,
  """ + ", ".join(f"ps.{x} AS prior_{x}" for x in ST.STAT_COLS) + """,
  cs.sold_count > 0 AND ps.sold_count > 0 AS has_yoy,
""" + YOY_CHANGE + YOY_FROM)
def q_prior_year_stats(c: Context):
    return _prior_lists(FZ.prior_year_block(c.t("sales"), c.t("lot_rows"), "fuzzy", c.settings.similarity_threshold))


@register("sale_history_fuzzy", O.with_recursive() + O.fuzzy_matches(1, FIXTURE_YEARS, FUZZY) + HISTORY_SQL)
def q_sale_history_fuzzy(c: Context):
    return _history_out(FZ.history_block(c.t("sales"), c.t("lot_rows"), c.settings.sale_history_years, "fuzzy",
                                         c.settings.similarity_threshold))


# ------------------------------------------------------------------ training

from paddock import settings as SETTINGS  # noqa: E402
from paddock.operators import training as TR  # noqa: E402

TRAIN_OUT = ["lot_id", "sale_id", "country_code", "sale_year", "price", "session_median_price",
             "sire_sold_count_36m", "sire_total_offered_36m", "sire_clearance_rate_36m", "sire_median_price_36m",
             "sire_sold_count_12m", "sire_total_offered_12m", "sire_clearance_rate_12m", "sire_median_price_12m",
             "sire_momentum", "sire_sample_flag_36m", "dam_progeny_sold_count", "dam_progeny_total_offered_count",
             "dam_progeny_median_price", "dam_first_foal_flag", "vendor_sold_count_36m",
             "vendor_total_offered_36m", "vendor_clearance_rate_36m", "vendor_median_price_36m",
             "vendor_volume_bucket", "vendor_first_seen_flag"]


def train_frame(c: Context) -> DataFrame:
    lots, hot = c.yearlings, c.hot_keys
    with c.fx.sized():
        return FT.training_frame(lots, c.regions, c.settings, "own", hot)


@register("training_frame", O.with_() + O.TRAIN + f"""
SELECT {', '.join(TRAIN_OUT)}, round_even(log_price_index, 6) AS log_price_index, split FROM tfeat""")
def q_training_frame(c: Context):
    return train_frame(c).select(*TRAIN_OUT, py_round(F.col("log_price_index"), 6).alias("log_price_index"),
                                 TR.split_column(c.settings).alias("split"))


@register("label_encode", O.with_() + O.TRAIN + " SELECT * FROM enc")
def q_label_encode(c: Context):
    return trained_encoder(c)


TRAIN_KEEP = ["lot_id", "country_code", "log_price_index", "sale_year", "price"]


def trained_rows(c: Context) -> DataFrame:
    """The columns of the training frame that encoders and matrices read, written once: both read them."""
    used = {*TRAIN_KEEP, *SETTINGS.FEATURE_COLS, *SETTINGS.SERVED_FEATURE_COLS, *SETTINGS.LOG_PRICE_COLS, *SETTINGS.CATEGORICAL_COLS}

    def build() -> DataFrame:
        tf = train_frame(c)
        return tf.select(*[x for x in tf.columns if x in used])
    return c.fx.derived("trained_rows", build)


def trained_encoder(c: Context) -> DataFrame:
    """The label encoder of the training frame, written: its size is known where it is joined."""
    return c.fx.derived("trained_encoder", lambda: FT.fit_label_encoder(trained_rows(c)))


def _encoded_matrix(c: Context) -> DataFrame:
    enc = FT.apply_label_encoder(trained_rows(c), trained_encoder(c))
    return FT.model_matrix(TR.split_frame(enc, c.settings), keep=[*TRAIN_KEEP[:2], "split", *TRAIN_KEEP[2:]])


def _feature_sql(f: str) -> str:
    if f.startswith("log_"):
        return f"ln(1 + coalesce(CAST(t.{f[4:]} AS DOUBLE), 0.0))"
    if f.endswith("_encoded"):
        return f"CAST(e_{f[: -len('_encoded')]}.code AS DOUBLE)"
    return f"coalesce(CAST(t.{f} AS DOUBLE), 0.0)"


def _matrix_sql(select: str = "") -> str:
    cols = [(f"round_even({_feature_sql(f)}, 6)" if f.startswith("log_") else _feature_sql(f)) + f" AS {f}" for f in SETTINGS.FEATURE_COLS]
    joins = "".join(
        f" LEFT JOIN enc e_{b} ON e_{b}.country_code = t.country_code AND e_{b}.feature = '{b}'"
        f" AND e_{b}.value = coalesce(t.{b}, 'Unknown')" for b in SETTINGS.CATEGORICAL_COLS)
    return f"SELECT {select or 't.lot_id, t.country_code, t.split, ' + ', '.join(cols)} FROM tfeat t{joins}"


@register("model_matrix", O.with_() + O.TRAIN + _matrix_sql())
def q_model_matrix(c: Context):
    m = _encoded_matrix(c)
    return m.select("lot_id", "country_code", "split",
                    *[(py_round(F.col(f), 6) if f.startswith("log_") else F.col(f)).alias(f)
                      for f in SETTINGS.FEATURE_COLS])


# Two models a country with lists of their own; the i-th weight is i.
LISTS = {"trained": SETTINGS.FEATURE_COLS, "served": SETTINGS.SERVED_FEATURE_COLS}


@register("model_matrix_by_list", O.with_() + O.TRAIN + " UNION ALL ".join(_matrix_sql(
    f"t.lot_id, '{m}' AS model, {len(fs)} AS n_features, round_even(" + " + ".join(f"{i + 1} * {_feature_sql(f)}" for i, f in enumerate(fs)) + ", 2) AS score")
    for m, fs in LISTS.items()))
def q_model_matrix_by_list(c: Context):
    """M2 + M16 with the feature list as data: both lists are scored side by side."""
    enc = FT.apply_label_encoder(trained_rows(c), trained_encoder(c))
    rows = [(m, fs, [float(i + 1) for i in range(len(fs))]) for m, fs in LISTS.items()]
    lists = c.regions.select("country_code", F.explode(F.array(*[F.struct(
        F.lit(m).alias("model"), F.array(*map(F.lit, fs)).alias("features"), F.array(*map(F.lit, w)).alias("weights")) for m, fs, w in rows])).alias("l"))
    x = FT.listed_matrix(enc, lists.select("country_code", "l.*"), ["lot_id"])
    return x.select("lot_id", "model", F.size("x").alias("n_features"), py_round(FT.linear_score(), 2).alias("score"))


@register("split_counts", O.with_() + O.TRAIN + """
SELECT country_code,
  CAST(sum(CASE WHEN split <> 'test' THEN 1 ELSE 0 END) AS BIGINT) AS train_all_rows,
  CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS BIGINT) AS validation_rows,
  CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows
FROM tfeat GROUP BY country_code""")
def q_split_counts(c: Context):
    return TR.split_counts(train_frame(c), c.settings)


@register("naive_baseline", O.with_() + O.TRAIN + """
, mu AS (SELECT country_code, avg(log_price_index) AS train_mean FROM tfeat WHERE split = 'train' GROUP BY country_code)
SELECT t.country_code, round_even(min(mu.train_mean), 6) AS train_mean,
  round_even(avg(abs(t.log_price_index - mu.train_mean)), 6) AS naive_mae, count(*) AS test_rows
FROM tfeat t JOIN mu ON mu.country_code = t.country_code WHERE t.split = 'test' GROUP BY t.country_code""")
def q_naive_baseline(c: Context):
    nb = TR.naive_baseline(train_frame(c), c.settings)
    return nb.select("country_code", py_round(F.col("train_mean"), 6).alias("train_mean"),
                     py_round(F.col("naive_mae"), 6).alias("naive_mae"), "test_rows")


def _fixed_test_predictions(c: Context) -> DataFrame:
    tf = train_frame(c).withColumn("split", TR.split_column(c.settings)).where(F.col("split") == "test")
    return SC.fixed_model(tf)


@register("eval_metrics", O.with_() + O.TRAIN + """
, te AS (SELECT * FROM tpred2 WHERE split = 'test')
, mu AS (SELECT country_code, avg(log_price_index) AS ybar FROM te GROUP BY country_code)
SELECT te.country_code, count(*) AS test_rows, round_even(avg(abs(log_price_index - pred_q50)), 6) AS mae,
  round_even(sqrt(avg((log_price_index - pred_q50) * (log_price_index - pred_q50))), 6) AS rmse,
  round_even(1.0 - sum((log_price_index - pred_q50) * (log_price_index - pred_q50))
             / sum((log_price_index - mu.ybar) * (log_price_index - mu.ybar)), 6) AS r2,
  round_even(avg(CASE WHEN log_price_index < pred_q25 THEN 1.0 ELSE 0.0 END) * 100, 6) AS raw_coverage_p25,
  round_even(avg(CASE WHEN log_price_index < pred_q75 THEN 1.0 ELSE 0.0 END) * 100, 6) AS raw_coverage_p75,
  round_even(avg(CASE WHEN price > 0 THEN abs(price - session_median_price * exp(pred_q50)) / price END) * 100, 6)
    AS mape
FROM te JOIN mu ON mu.country_code = te.country_code GROUP BY te.country_code""")
def q_eval_metrics(c: Context):
    ev = TR.evaluate(_fixed_test_predictions(c))
    return ev.select("country_code", "test_rows", *[py_round(F.col(x), 6).alias(x) for x in
                                                    ("mae", "rmse", "r2", "raw_coverage_p25", "raw_coverage_p75",
                                                     "mape")])


@register("calibration", O.with_() + O.TRAIN + """
, te AS (SELECT * FROM tpred2 WHERE split = 'test')
, off AS (SELECT country_code,
    quantile_cont(log_price_index - pred_q50, 0.25) - quantile_cont(pred_q25 - pred_q50, 0.5) AS offset_p25,
    quantile_cont(log_price_index - pred_q50, 0.75) - quantile_cont(pred_q75 - pred_q50, 0.5) AS offset_p75
  FROM te GROUP BY country_code)
SELECT off.country_code, round_even(min(off.offset_p25), 6) AS offset_p25, round_even(min(off.offset_p75), 6) AS offset_p75,
  round_even(avg(CASE WHEN te.log_price_index < te.pred_q25 + off.offset_p25 THEN 1.0 ELSE 0.0 END) * 100, 6)
    AS calibrated_coverage_p25,
  round_even(avg(CASE WHEN te.log_price_index < te.pred_q75 + off.offset_p75 THEN 1.0 ELSE 0.0 END) * 100, 6)
    AS calibrated_coverage_p75
FROM te JOIN off ON off.country_code = te.country_code GROUP BY off.country_code""")
def q_calibration(c: Context):
    cal = TR.calibrate(_fixed_test_predictions(c))
    return cal.select("country_code", *[py_round(F.col(x), 6).alias(x) for x in
                                        ("offset_p25", "offset_p75", "calibrated_coverage_p25",
                                         "calibrated_coverage_p75")])


# ------------------------------------------------------------------ trained models (rows-only checks)

from paddock.operators import boosting as BO  # noqa: E402
from paddock.operators import registry as RG  # noqa: E402


def trained(c: Context):
    """(baseline, metrics, importance) of every configured country, trained once in this run; also the trees and the encoder.

    Results are tables below the run's own folder: no other session reads them.
    """
    if getattr(c, "_trained", None) is not None:
        return c._trained
    c._encoder = trained_encoder(c)
    matrix = c.fx.derived("trained_matrix", lambda: _encoded_matrix(c), partition_by="country_code")
    c._trees = c.fx.derived("trained_trees", lambda: BO.train_boosters(matrix, SETTINGS.FEATURE_COLS))
    base = c.fx.derived("trained_baseline", lambda: TR.baseline_metrics(matrix, SETTINGS.FEATURE_COLS))
    metrics = c.fx.derived("trained_metrics", lambda: _model_metrics(c, matrix, base))
    model = F.broadcast(c.regions.select("country_code", "model"))
    importance = c.fx.derived("trained_importance", lambda: BO.importance(c._trees, SETTINGS.FEATURE_COLS).join(
        model, "country_code", "left"))
    c._trained = base, metrics, importance
    return c._trained


def _model_metrics(c: Context, matrix: DataFrame, base: DataFrame) -> DataFrame:
    """One row a country, named as the region's configured model."""
    pred = BO.predict_quantiles(matrix.where(F.col("split") == "test"), c._trees, SETTINGS.FEATURE_COLS)
    pred = pred.withColumn("session_median_price", F.exp(F.col("log_session_median_price")) - 1)
    pred = saved(pred, work_path(c.spark, "trained-predictions"))
    counts = matrix.groupBy("country_code").agg(*[
        F.sum(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"{s}_rows") for s in ("train", "validation", "test")])
    b = base.select("country_code", "naive_mae", *[F.col(x).alias(f"baseline_{x}") for x in (
        "train_mae", "train_r2", "test_mae", "test_r2", "passes")])
    out = (BO.tree_counts(c._trees).join(counts, "country_code").join(F.broadcast(c.regions.select("country_code", "model")), "country_code")
           .join(b, "country_code", "left").join(TR.evaluate(pred).drop("test_rows"), "country_code", "left")
           .join(TR.calibrate(pred), "country_code", "left").withColumn("version", F.lit(1)))
    out = out.withColumns({"generated_at": F.lit(str(c.settings.run_ts)), "features_count": F.lit(len(SETTINGS.FEATURE_COLS)),
                           "total_samples": F.col("train_rows") + F.col("validation_rows") + F.col("test_rows"),
                           "baseline_name": F.lit("Elastic Net")})
    return RG.as_table(out, RG.METRICS_SCHEMA)


@register("baseline_metrics")
def q_baseline_metrics(c: Context):
    return trained(c)[0]


@register("quantile_model")
def q_quantile_model(c: Context):
    return trained(c)[1].select("country_code", "model", "trees_q25", "trees_q50", "trees_q75", "mae", "r2",
                                "raw_coverage_p25", "raw_coverage_p75", "offset_p25", "offset_p75")


@register("model_metrics")
def q_model_metrics(c: Context):
    return trained(c)[1]


@register("top_features")
def q_top_features(c: Context):
    return RG.top_features(trained(c)[2], 15)


@register("model_listing")
def q_model_listing(c: Context):
    _, metrics, importance = trained(c)
    return RG.model_listing(metrics, importance, c.regions)


# A run a cutoff year, of the fixed model: its test rows are those from that year on. The listing is as of the second run.
REGISTRY_RUNS = [(2, "2001-01-01 00:00:00"), (1, "2001-02-01 00:00:00"), (0, "2001-03-01 00:00:00")]
REGISTRY_FEATURES = ["sire_sold_count_36m", "dam_progeny_sold_count", "vendor_sold_count_36m"]
REGISTRY_VALUES = ["mae", "rmse", "r2", "raw_coverage_p25", "raw_coverage_p75", "mape"]


@register("model_registry", O.with_() + O.TRAIN + """
, runs AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i + 1}, {SETTINGS.FIXTURE_SETTINGS.cutoff_year - back}, '{at}')" for i, (back, at) in enumerate(REGISTRY_RUNS[:2])) + """) r(run, cutoff, generated_at))
, te AS (SELECT r.run, r.generated_at, p.*, avg(log_price_index) OVER (PARTITION BY r.run, country_code) AS ybar
  FROM tpred2 p JOIN runs r ON p.sale_year >= r.cutoff)
, ev AS (SELECT run, generated_at, country_code, count(*) AS test_rows, avg(abs(log_price_index - pred_q50)) AS mae,
    sqrt(avg((log_price_index - pred_q50) * (log_price_index - pred_q50))) AS rmse,
    1.0 - sum((log_price_index - pred_q50) * (log_price_index - pred_q50)) / sum((log_price_index - ybar) * (log_price_index - ybar)) AS r2,
    avg(CASE WHEN log_price_index < pred_q25 THEN 1.0 ELSE 0.0 END) * 100 AS raw_coverage_p25,
    avg(CASE WHEN log_price_index < pred_q75 THEN 1.0 ELSE 0.0 END) * 100 AS raw_coverage_p75,
    avg(CASE WHEN price > 0 THEN abs(price - session_median_price * exp(pred_q50)) / price END) * 100 AS mape
  FROM te GROUP BY run, generated_at, country_code)
, seen AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY run) AS version FROM ev)
, gains AS (SELECT r.run, p.country_code, f.feature, CAST(sum(CASE f.feature """ + " ".join(
    f"WHEN '{x}' THEN p.{x}" for x in REGISTRY_FEATURES) + """ END) AS DOUBLE) AS g
  FROM tpred2 p JOIN runs r ON p.sale_year < r.cutoff, (VALUES """ + ", ".join(f"('{x}')" for x in REGISTRY_FEATURES) + """) f(feature)
  GROUP BY r.run, p.country_code, f.feature)
, shares AS (SELECT run, country_code, feature, g / sum(g) OVER (PARTITION BY run, country_code) AS gain FROM gains)
, maps AS (SELECT run, country_code, string_agg(concat(feature, '=', CAST(CAST(round_even(gain, 2) AS DECIMAL(6, 2)) AS VARCHAR)), ',' ORDER BY feature) AS importance
  FROM shares GROUP BY run, country_code)
SELECT s.country_code, CAST(s.version AS INTEGER) AS version, concat(lower(s.country_code), '_v', CAST(s.version AS VARCHAR)) AS model, s.generated_at, s.test_rows,
  """ + ", ".join(f"round_even(s.{x}, 6) AS {x}" for x in REGISTRY_VALUES) + """,
  s.version = max(s.version) OVER (PARTITION BY s.country_code) AS is_latest, m.importance
FROM seen s LEFT JOIN maps m ON m.run = s.run AND m.country_code = s.country_code""")
def q_model_registry(c: Context):
    """S13 + S14 + M20: three runs appended one after the other, listed as of the second one."""
    # only the columns that the runs read are dealt and written
    used = ["country_code", "sale_year", "price", "session_median_price", "log_price_index", "pred_q25", "pred_q50", "pred_q75", *REGISTRY_FEATURES]
    pred = c.fx.derived("fixed_predictions", lambda: SC.fixed_model(train_frame(c)).select(*used))
    root = work_path(c.spark, "registry")
    for back, at in REGISTRY_RUNS:
        year = c.settings.cutoff_year - back
        run = TR.evaluate(pred.where(F.col("sale_year") >= year)).withColumn("generated_at", F.lit(at))
        sums = pred.where(F.col("sale_year") < year).groupBy("country_code").agg(*[F.sum(x).cast("double").alias(x) for x in REGISTRY_FEATURES])
        whole = sum((F.col(x) for x in REGISTRY_FEATURES[1:]), F.col(REGISTRY_FEATURES[0]))
        gains = F.array(*[F.struct(F.lit(x).alias("feature"), (F.col(x) / whole).alias("gain")) for x in REGISTRY_FEATURES])
        importance = sums.select("country_code", F.lit("average").alias("quantile"), F.explode(gains).alias("g")).select("country_code", "quantile", "g.*")
        RG.append_run(run, importance, root)
    out = RG.versions(*RG.read_registry(c.spark, root), c.regions, as_of=REGISTRY_RUNS[1][1])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("importance_average")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(6,2)").cast("string"))), ",")
    return out.select("country_code", "version", "model", "generated_at", "test_rows", *[py_round(F.col(x), 6).alias(x) for x in REGISTRY_VALUES],
                      "is_latest", shown.alias("importance"))


@register("activity_recent", """
SELECT user, action, detail, category, status FROM (
  SELECT CAST(user_id AS VARCHAR) AS user, event_type AS action, props AS detail,
    CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'general' END AS category,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, event_id
  FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_type <> 'error') e
ORDER BY event_id DESC LIMIT 50""")
def q_activity_recent(c: Context):
    """S12 + P14 + L3 over the events as log lines: every seventh is cut off, every eleventh lacks a required field."""
    e = c.fx.raw("events")
    fields = [F.col("ts").cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("user"),
              F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("action"), F.col("props").alias("detail"),
              F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("category"),
              F.when(F.col("event_type") == "error", "error").alias("status")]
    line = F.to_json(F.struct(*fields))
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"),
                     F.col("event_id").alias("line_no"))
    return RG.recent_activity(RG.parse_activity(lines), 50, status="success").select("user", "action", "detail", "category", "status")


@register("score_lots_trained")
def q_score_lots_trained(c: Context):
    """M11 + M16 with the boosters trained above: features -> stored encoder -> matrix -> predict -> score."""
    trained(c)
    encoder, metrics = c._encoder, c._trained[1]
    f = SC.scorable(all_features(c))
    enc = FT.apply_label_encoder(f, encoder)
    keep = ["lot_id", "horse_id", "sale_id", "country_code", "lot_number", "book_number", "sex", "horse_name",
            "sire_name"]
    mm = FT.model_matrix(enc, keep=keep)
    pred = BO.predict_quantiles(mm, c._trees, SETTINGS.FEATURE_COLS)
    return SC.score(pred, TR.trained_offsets(metrics, c.regions), c.settings).select(
        *SCORE_COLS, *[py_round(F.col(x), 6).alias(x) for x in ("mv_expected_index", "mv_low_index",
                                                                  "mv_high_index")])
