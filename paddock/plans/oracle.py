"""DuckDB oracle SQL, written independently of the Spark plans.

Each query is a direct, row-level statement of the semantics (no histograms, no
spine tricks), over the same fixture tables (``fixture.TABLE_SQL`` as CTEs).
Rounding twins: numpy-style ``rint`` -> ``round_even``; Python ``round`` ->
``round_even``; ``percentile`` -> ``quantile_cont``; ``add_months(d, -n)`` ->
``d - INTERVAL n MONTH``.
"""

from __future__ import annotations

from paddock.settings import FIXTURE_SETTINGS as FS
from paddock.sources import regions as R
from paddock.sources.fixture import TABLE_SQL

Y0 = f"DATE '{FS.year_start}-01-01'"
Y1 = f"DATE '{FS.get_year_end() + 1}-01-01'"
TODAY = f"DATE '{FS.today.isoformat()}'"


def _regions_sql() -> tuple[str, str, str]:
    cfg = R.load_json(R.FIXTURE_REGIONS)
    models = R.load_json(R.FIXTURE_MODELS)["models"]
    rows, hist, offs = [], [], []
    for code, r in cfg["regions"].items():
        e = r.get("elite_scaling", {})
        t = r.get("confidence_tiers", {})
        rows.append("('{c}', '{m}', {cur}, {thr}, {bo}, {sf}, {cl}, {ex}, {mc})".format(
            c=code.upper(), m=r["model"], cur=r["currency_id"],
            thr=float(e.get("threshold", 500000)), bo=float(e.get("base_offset", 0.25)),
            sf=float(e.get("scaling_factor", 0.5)), cl=float(t.get("close_threshold", 0.7)),
            ex=float(t.get("extreme_threshold", 1.0)), mc=int(r.get("sire_sample_min_count", 10))))
        for h in dict.fromkeys(r.get("hist_countries", [code])):
            hist.append(f"('{code.upper()}', '{h}')")
        mo = models.get(r["model"], {})
        me = mo.get("elite_scaling")
        if me:
            thr, bo, sf, sthr = (float(me.get("threshold", 500000)), float(me.get("base_offset", 0.25)),
                                 float(me.get("scaling_factor", 0.5)), float(me.get("threshold", 300000)))
        else:
            thr, bo, sf, sthr = (float(e.get("threshold", 500000)), float(e.get("base_offset", 0.25)),
                                 float(e.get("scaling_factor", 0.5)), 300000.0)
        offs.append(f"('{code.upper()}', {float(mo['offset_p25'])}, {float(mo['offset_p75'])}, "
                    f"{thr}, {bo}, {sf}, {sthr}, {float(t.get('close_threshold', 0.7))}, "
                    f"{float(t.get('extreme_threshold', 1.0))}, {r['currency_id']})")
    regions = ("regions AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(country_code, model, "
               "currency_id, elite_threshold, elite_base_offset, elite_scaling_factor, close_threshold, "
               "extreme_threshold, sire_sample_min_count))")
    region_hist = ("region_hist AS (SELECT * FROM (VALUES " + ", ".join(hist)
                   + ") AS t(country_code, hist_country))")
    offsets = ("offsets AS (SELECT * FROM (VALUES " + ", ".join(offs) + ") AS t(country_code, offset_p25, "
               "offset_p75, elite_threshold, elite_base_offset, elite_scaling_factor, summary_elite_threshold, "
               "close_threshold, extreme_threshold, currency_id))")
    return regions, region_hist, offsets


REGIONS, REGION_HIST, OFFSETS = _regions_sql()

LOTS = """lots AS (
 SELECT l.lot_id, l.sale_id, s.start_date AS sale_date, CAST(year(s.start_date) AS INTEGER) AS sale_year,
   s.company_id, c.company_name AS sale_company, s.sale_name, ct.country_code, l.book_number, l.day_number,
   l.lot_number, l.sex, h.sire_id, h.dam_id, l.vendor_id, l.horse_id, h.horse_name, sn.horse_name AS sire_name,
   l.price, lt.lot_type_name AS lot_type, l.is_passed_in, l.is_withdrawn,
   CASE WHEN l.price > 0 AND coalesce(l.is_passed_in, 0) = 0 AND coalesce(l.is_withdrawn, 0) = 0
        THEN 1 ELSE 0 END AS sold_flag,
   CASE WHEN coalesce(l.is_passed_in, 0) = 1 THEN 1 ELSE 0 END AS passed_in_flag
 FROM lot_rows l JOIN sales s ON l.sale_id = s.sale_id JOIN companies c ON s.company_id = c.company_id
 JOIN lot_types lt ON l.lot_type_id = lt.lot_type_id JOIN countries ct ON s.country_id = ct.country_id
 JOIN horses h ON l.horse_id = h.horse_id LEFT JOIN sires sn ON h.sire_id = sn.horse_id)"""
HIST = "hist AS (SELECT * FROM lots WHERE lot_type = 'Yearling' AND coalesce(is_withdrawn, 0) = 0)"
BASE = f"base AS (SELECT * FROM hist WHERE sale_date >= {Y0} AND sale_date < {Y1})"


def with_(*ctes: str) -> str:
    fixture = [f"{name} AS ({sql.strip()})" for name, sql in TABLE_SQL]
    return "WITH " + ",\n".join(fixture + [REGIONS, REGION_HIST, OFFSETS, LOTS, HIST, BASE] + list(ctes)) + "\n"


def rate1(sold: str, offered: str) -> str:
    return f"CASE WHEN ({offered}) > 0 THEN round_even(CAST(100.0 AS DOUBLE) * ({sold}) / ({offered}), 1) END"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ---------------------------------------------------------------- point-in-time

def sire_sql(months=(36, 12), region_map: str = "region_hist", base: str = "base") -> str:
    w = max(months)
    aggs = []
    for m in months:
        inside = "TRUE" if m == w else f"h_date >= as_of - INTERVAL {m} MONTH"
        sold = f"coalesce(sum(CASE WHEN {inside} THEN sold_flag END), 0)"
        passed = f"coalesce(sum(CASE WHEN {inside} THEN passed_in_flag END), 0)"
        aggs += [
            f"{big(sold)} AS sire_sold_count_{m}m",
            f"{big(passed)} AS sire_passedin_count_{m}m",
            f"{big(sold + ' + ' + passed)} AS sire_total_offered_{m}m",
            f"{rate1(sold, sold + ' + ' + passed)} AS sire_clearance_rate_{m}m",
            f"quantile_cont(CASE WHEN {inside} AND sold_flag = 1 THEN price END, 0.5) AS sire_median_price_{m}m",
        ]
    q = f"""
, sp AS (SELECT DISTINCT country_code, sire_id, sale_date AS as_of FROM {base} WHERE sire_id IS NOT NULL)
, j AS (SELECT sp.country_code, sp.sire_id, sp.as_of, h.sale_date AS h_date, h.price, h.sold_flag, h.passed_in_flag
        FROM sp JOIN {region_map} rh ON rh.country_code = sp.country_code
        LEFT JOIN hist h ON h.country_code = rh.hist_country AND h.sire_id = sp.sire_id
             AND h.sale_date < sp.as_of AND h.sale_date >= sp.as_of - INTERVAL {w} MONTH)
, sire AS (SELECT j.country_code, sire_id, as_of AS sale_date, {', '.join(aggs)}
        FROM j GROUP BY j.country_code, sire_id, as_of)
"""
    if 36 in months and 12 in months:
        q += """, sire_full AS (SELECT sire.*, sire_median_price_12m - sire_median_price_36m AS sire_momentum,
        CAST(sire_sold_count_36m < r.sire_sample_min_count AS INTEGER) AS sire_sample_flag_36m
        FROM sire JOIN regions r ON r.country_code = sire.country_code)
"""
    return q


def dam_sql(region_map: str = "region_hist", base: str = "base") -> str:
    sold, passed = "coalesce(sum(sold_flag), 0)", "coalesce(sum(passed_in_flag), 0)"
    return f"""
, dsp AS (SELECT DISTINCT country_code, dam_id, sale_date AS as_of FROM {base} WHERE dam_id IS NOT NULL)
, dj AS (SELECT dsp.country_code, dsp.dam_id, dsp.as_of, h.price, h.sold_flag, h.passed_in_flag
         FROM dsp JOIN {region_map} rh ON rh.country_code = dsp.country_code
         LEFT JOIN hist h ON h.country_code = rh.hist_country AND h.dam_id = dsp.dam_id AND h.sale_date < dsp.as_of)
, dam AS (SELECT dj.country_code, dam_id, as_of AS sale_date,
         {big(sold)} AS dam_progeny_sold_count, {big(passed)} AS dam_progeny_passedin_count,
         {big(sold + ' + ' + passed)} AS dam_progeny_total_offered_count,
         quantile_cont(CASE WHEN sold_flag = 1 THEN price END, 0.5) AS dam_progeny_median_price,
         CAST({sold} = 0 AS INTEGER) AS dam_first_foal_flag
         FROM dj GROUP BY dj.country_code, dam_id, as_of)
"""


def vendor_sql(region_map: str = "region_hist", base: str = "base") -> str:
    sold, passed = "coalesce(sum(sold_flag), 0)", "coalesce(sum(passed_in_flag), 0)"
    return f"""
, vsp AS (SELECT DISTINCT country_code, vendor_id, sale_date AS as_of FROM {base} WHERE vendor_id IS NOT NULL)
, vj AS (SELECT vsp.country_code, vsp.vendor_id, vsp.as_of, h.price, h.sold_flag, h.passed_in_flag
         FROM vsp JOIN {region_map} rh ON rh.country_code = vsp.country_code
         LEFT JOIN hist h ON h.country_code = rh.hist_country AND h.vendor_id = vsp.vendor_id
              AND h.sale_date < vsp.as_of AND h.sale_date >= vsp.as_of - INTERVAL 36 MONTH)
, vendor AS (SELECT vj.country_code, vendor_id, as_of AS sale_date,
         {big(sold)} AS vendor_sold_count_36m, {big(passed)} AS vendor_passedin_count_36m,
         {big(sold + ' + ' + passed)} AS vendor_total_offered_36m,
         {rate1(sold, sold + ' + ' + passed)} AS vendor_clearance_rate_36m,
         quantile_cont(CASE WHEN sold_flag = 1 THEN price END, 0.5) AS vendor_median_price_36m,
         CASE WHEN {sold} = 0 THEN 'New' WHEN {sold} <= 5 THEN 'Small' WHEN {sold} <= 20 THEN 'Medium'
              ELSE 'Large' END AS vendor_volume_bucket,
         CAST({sold} = 0 AS INTEGER) AS vendor_first_seen_flag
         FROM vj GROUP BY vj.country_code, vendor_id, as_of)
"""


MEDIANS = f"""
, own AS (SELECT sale_id, quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5)
            AS session_median_own FROM base GROUP BY sale_id)
, prior AS (SELECT sale_name, sale_year + 1 AS sale_year, CASE WHEN m <> 0 THEN m END AS prior_year_median
            FROM (SELECT sale_name, sale_year,
                    quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5) AS m
                  FROM hist GROUP BY sale_name, sale_year) x)
, med AS (SELECT b.sale_id, own.session_median_own, prior.prior_year_median, o.session_median_override,
            coalesce(o.session_median_override, own.session_median_own, prior.prior_year_median)
              AS session_median_price,
            CASE WHEN o.session_median_override IS NOT NULL THEN 'override'
                 WHEN own.session_median_own IS NOT NULL THEN 'sale'
                 WHEN prior.prior_year_median IS NOT NULL THEN 'prior_year' END AS median_source
          FROM (SELECT DISTINCT sale_id, sale_name, sale_year FROM base) b
          LEFT JOIN own ON own.sale_id = b.sale_id
          LEFT JOIN prior ON prior.sale_name = b.sale_name AND prior.sale_year = b.sale_year
          LEFT JOIN session_overrides o ON o.sale_id = b.sale_id)
"""

FEATURES = (sire_sql() + dam_sql() + vendor_sql() + MEDIANS + """
, feat AS (SELECT b.*, med.session_median_price,
    s.sire_sold_count_36m, s.sire_passedin_count_36m, s.sire_total_offered_36m, s.sire_clearance_rate_36m,
    s.sire_median_price_36m, s.sire_sold_count_12m, s.sire_passedin_count_12m, s.sire_total_offered_12m,
    s.sire_clearance_rate_12m, s.sire_median_price_12m, s.sire_momentum, s.sire_sample_flag_36m,
    d.dam_progeny_sold_count, d.dam_progeny_passedin_count, d.dam_progeny_total_offered_count,
    d.dam_progeny_median_price, d.dam_first_foal_flag,
    v.vendor_sold_count_36m, v.vendor_passedin_count_36m, v.vendor_total_offered_36m, v.vendor_clearance_rate_36m,
    v.vendor_median_price_36m, v.vendor_volume_bucket, v.vendor_first_seen_flag,
    s.sire_median_price_36m - med.session_median_price AS sire_vs_sale_median_delta,
    d.dam_progeny_median_price - med.session_median_price AS dam_vs_sale_median_delta,
    v.vendor_median_price_36m - med.session_median_price AS vendor_vs_sale_median_delta
  FROM base b LEFT JOIN med ON med.sale_id = b.sale_id
  LEFT JOIN sire_full s ON s.country_code = b.country_code AND s.sire_id = b.sire_id AND s.sale_date = b.sale_date
  LEFT JOIN dam d ON d.country_code = b.country_code AND d.dam_id = b.dam_id AND d.sale_date = b.sale_date
  LEFT JOIN vendor v ON v.country_code = b.country_code AND v.vendor_id = b.vendor_id AND v.sale_date = b.sale_date)
""")


# ---------------------------------------------------------------- scoring (fixed model)

SCORE = FEATURES + """
, pred AS (SELECT f.*, 2.0 * ln((0.5 * coalesce(f.sire_median_price_36m, f.session_median_price)
                               + 0.3 * coalesce(f.dam_progeny_median_price, f.session_median_price)
                               + 0.2 * coalesce(f.vendor_median_price_36m, f.session_median_price))
                              / f.session_median_price) AS pred_q50
           FROM feat f WHERE f.session_median_price IS NOT NULL AND f.session_median_price <> 0)
, pred2 AS (SELECT p.*, p.pred_q50 - 0.35 AS pred_q25, p.pred_q50 + 0.35 AS pred_q75,
              p.session_median_price * exp(p.pred_q50) AS mv_raw, o.offset_p25, o.offset_p75,
              o.elite_threshold, o.elite_base_offset, o.elite_scaling_factor, o.close_threshold,
              o.extreme_threshold, o.summary_elite_threshold
            FROM pred p JOIN offsets o ON o.country_code = p.country_code)
, el AS (SELECT *, CASE WHEN mv_raw >= elite_threshold
                        THEN elite_base_offset + (ln(mv_raw) - ln(elite_threshold)) * elite_scaling_factor
                        ELSE 0.0 END AS elite_offset,
           coalesce(sire_sample_flag_36m, 0) + coalesce(dam_first_foal_flag, 0)
             + coalesce(vendor_first_seen_flag, 0) AS flags
         FROM pred2)
, adj AS (SELECT *, pred_q50 + elite_offset AS adj_q50, pred_q25 + offset_p25 + elite_offset AS adj_q25,
            pred_q75 + offset_p75 + elite_offset AS adj_q75 FROM el)
, px AS (SELECT *, round_even(session_median_price * exp(adj_q50) / 100, 0) * 100 AS e_price,
           round_even(session_median_price * exp(adj_q25) / 100, 0) * 100 AS l_price,
           round_even(session_median_price * exp(adj_q75) / 100, 0) * 100 AS h_price FROM adj)
, scored AS (SELECT lot_id, horse_id, sale_id, country_code, lot_number, book_number, sex, horse_name, sire_name,
    session_median_price, exp(adj_q50) AS mv_expected_index, exp(adj_q25) AS mv_low_index,
    exp(adj_q75) AS mv_high_index, e_price AS mv_expected_price,
    greatest(least(l_price, e_price), 0.0) AS mv_low_price, greatest(h_price, e_price) AS mv_high_price,
    round_even(mv_raw / 100, 0) * 100 AS mv_raw_price, elite_offset, flags, pred_q50,
    CASE WHEN abs(pred_q50) < close_threshold THEN 'close' WHEN abs(pred_q50) < extreme_threshold THEN 'moderate'
         ELSE 'extreme' END AS distance_band,
    CASE WHEN abs(pred_q50) < close_threshold
              THEN CASE WHEN flags = 0 THEN 'high' WHEN flags = 1 THEN 'medium' ELSE 'low' END
         WHEN abs(pred_q50) < extreme_threshold THEN CASE WHEN flags <= 1 THEN 'medium' ELSE 'low' END
         ELSE CASE WHEN flags = 0 THEN 'medium' ELSE 'low' END END AS mv_confidence_tier,
    summary_elite_threshold
  FROM px)
"""

SCORE_OUT = """lot_id, horse_id, sale_id, country_code, lot_number, book_number, sex, horse_name, sire_name,
  session_median_price, round_even(mv_expected_index, 6) AS mv_expected_index,
  round_even(mv_low_index, 6) AS mv_low_index, round_even(mv_high_index, 6) AS mv_high_index,
  mv_expected_price, mv_low_price, mv_high_price, mv_raw_price, mv_confidence_tier, 'v2.2' AS mv_model_version"""

COMPARE = SCORE + """
, cmp AS (SELECT s.lot_id, s.horse_id, s.sale_id, s.lot_number, s.horse_name, s.sire_name, s.mv_expected_price,
    p.horse_id IS NULL AS is_new, p.market_value AS old_expected, p.market_value_low AS old_low, p.market_value_high AS old_high,
    p.market_value_multiplier AS old_index, p.confidence AS old_tier, p.session_median_price AS old_session_median,
    CASE WHEN p.horse_id IS NOT NULL AND p.market_value IS NOT NULL THEN s.mv_expected_price - p.market_value END
      AS d_raw,
    CASE WHEN p.horse_id IS NOT NULL AND p.market_value IS NOT NULL THEN
      CASE WHEN p.market_value <> 0 THEN (s.mv_expected_price - p.market_value) / p.market_value * 100.0
           ELSE 0.0 END END AS pct_raw,
    CASE WHEN p.horse_id IS NOT NULL AND p.market_value IS NOT NULL AND p.market_value_low IS NOT NULL
         THEN round_even(s.mv_low_price - p.market_value_low, 2) END AS delta_low,
    CASE WHEN p.horse_id IS NOT NULL AND p.market_value IS NOT NULL AND p.market_value_high IS NOT NULL
         THEN round_even(s.mv_high_price - p.market_value_high, 2) END AS delta_high
  FROM scored s LEFT JOIN predictions p ON p.horse_id = s.horse_id AND p.sale_id = s.sale_id)
, cmp2 AS (SELECT *, round_even(d_raw, 2) AS delta_expected, round_even(pct_raw, 2) AS delta_expected_pct,
    coalesce(round_even(d_raw, 2) <> 0, FALSE) AND NOT is_new AS changed FROM cmp)
"""

BATCH = """
, batch AS (SELECT s.horse_id, s.sale_id, s.mv_expected_price AS market_value, s.mv_low_price AS market_value_low,
    s.mv_high_price AS market_value_high, s.mv_expected_index AS market_value_multiplier,
    s.mv_confidence_tier AS confidence, s.session_median_price, r.currency_id
  FROM {src} s LEFT JOIN regions r ON r.country_code = s.country_code)
, snap AS (SELECT coalesce(b.horse_id, p.horse_id) AS horse_id, coalesce(b.sale_id, p.sale_id) AS sale_id,
    CASE WHEN b.horse_id IS NOT NULL THEN b.market_value ELSE p.market_value END AS market_value,
    CASE WHEN b.horse_id IS NOT NULL THEN b.market_value_low ELSE p.market_value_low END AS market_value_low,
    CASE WHEN b.horse_id IS NOT NULL THEN b.market_value_high ELSE p.market_value_high END AS market_value_high,
    CASE WHEN b.horse_id IS NOT NULL THEN b.market_value_multiplier ELSE p.market_value_multiplier END
      AS market_value_multiplier,
    CASE WHEN b.horse_id IS NOT NULL THEN b.confidence ELSE p.confidence END AS confidence,
    CASE WHEN b.horse_id IS NOT NULL THEN b.session_median_price ELSE p.session_median_price END
      AS session_median_price,
    CASE WHEN b.horse_id IS NOT NULL THEN b.currency_id ELSE p.currency_id END AS currency_id,
    CASE WHEN p.horse_id IS NOT NULL THEN p.created_by ELSE {audit} END AS created_by,
    CASE WHEN p.horse_id IS NOT NULL THEN p.created_on ELSE '{run}' END AS created_on,
    CASE WHEN b.horse_id IS NOT NULL THEN {audit} ELSE p.modified_by END AS modified_by,
    CASE WHEN b.horse_id IS NOT NULL THEN '{run}' ELSE p.modified_on END AS modified_on,
    CASE WHEN b.horse_id IS NOT NULL AND p.horse_id IS NOT NULL THEN 'update'
         WHEN b.horse_id IS NOT NULL THEN 'insert' ELSE 'keep' END AS action
  FROM predictions p FULL OUTER JOIN batch b ON p.horse_id = b.horse_id AND p.sale_id = b.sale_id)
"""


# ---------------------------------------------------------------- sale statistics

SOLD = "(price > 0 AND coalesce(is_withdrawn, 0) = 0 AND coalesce(is_passed_in, 0) = 0)"


def truthy2(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> 0 THEN round_even({x}, 2) END"


def stats_sql(pooled: str, groups: list[str], prefix: str = "st", every: str = "") -> str:
    """CTEs ``{prefix}`` with A11-A16 per group over CTE ``pooled`` (groups..., price, flags); ``every`` selects
    groups that get a row even without lots."""
    g = ", ".join(groups)
    band = lambda lo, hi: (f"CAST(sum(CASE WHEN {SOLD} " + (f"AND price >= {lo} " if lo else "")
                           + (f"AND price < {hi} " if hi else "") + "THEN 1 ELSE 0 END) AS BIGINT)")
    return f"""
, {prefix}_a AS (SELECT {g}, count(*) AS total_lots,
    CAST(sum(CASE WHEN is_withdrawn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS withdrawn_count,
    CAST(sum(CASE WHEN coalesce(is_withdrawn, 0) = 0 AND is_passed_in = 1 THEN 1 ELSE 0 END) AS BIGINT)
      AS passed_in_count,
    CAST(sum(CASE WHEN {SOLD} THEN 1 ELSE 0 END) AS BIGINT) AS sold_count,
    sum(CASE WHEN {SOLD} THEN price ELSE 0.0 END) AS _gross, avg(CASE WHEN {SOLD} THEN price END) AS _avg,
    min(CASE WHEN {SOLD} THEN price END) AS _min, max(CASE WHEN {SOLD} THEN price END) AS _max,
    stddev_samp(CASE WHEN {SOLD} THEN price END) AS _std,
    quantile_cont(CASE WHEN {SOLD} THEN price END, 0.25) AS _q1,
    quantile_cont(CASE WHEN {SOLD} THEN price END, 0.5) AS _q2,
    quantile_cont(CASE WHEN {SOLD} THEN price END, 0.75) AS _q3,
    {band(None, 50000)} AS under_50k, {band(50000, 100000)} AS band_50k_100k,
    {band(100000, 200000)} AS band_100k_200k, {band(200000, 500000)} AS band_200k_500k,
    {band(500000, 1000000)} AS band_500k_1m, {band(1000000, None)} AS over_1m
  FROM {pooled} GROUP BY {g})
, {prefix}_t AS (SELECT {g}, avg(price) AS _top10 FROM (
    SELECT {g}, price, row_number() OVER (PARTITION BY {g} ORDER BY price DESC) AS rn
    FROM {pooled} WHERE {SOLD}) x WHERE rn <= 10 GROUP BY {g})
, {prefix}_e AS ({every or f"SELECT DISTINCT {g} FROM {pooled}"})
, {prefix} AS (SELECT {', '.join('e.' + c for c in groups)}, coalesce(total_lots, 0) AS total_lots,
    coalesce(sold_count, 0) AS sold_count, coalesce(passed_in_count, 0) AS passed_in_count,
    coalesce(withdrawn_count, 0) AS withdrawn_count,
    CASE WHEN total_lots - withdrawn_count > 0
         THEN round_even(CAST(100.0 AS DOUBLE) * sold_count / (total_lots - withdrawn_count), 1) END AS clearance_rate,
    CASE WHEN sold_count > 0 THEN {truthy2('_gross')} END AS gross,
    CASE WHEN sold_count > 0 THEN {truthy2('_avg')} END AS avg_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_q2')} END AS median_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_q1')} END AS q1_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_q3')} END AS q3_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_min')} END AS min_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_max')} END AS max_price,
    CASE WHEN sold_count > 0 THEN {truthy2('_top10')} END AS top10_avg,
    CASE WHEN sold_count > 0 THEN {truthy2('_std')} END AS std_dev,
    CASE WHEN sold_count > 0 THEN under_50k END AS under_50k,
    CASE WHEN sold_count > 0 THEN band_50k_100k END AS band_50k_100k,
    CASE WHEN sold_count > 0 THEN band_100k_200k END AS band_100k_200k,
    CASE WHEN sold_count > 0 THEN band_200k_500k END AS band_200k_500k,
    CASE WHEN sold_count > 0 THEN band_500k_1m END AS band_500k_1m,
    CASE WHEN sold_count > 0 THEN over_1m END AS over_1m
  FROM {prefix}_e e LEFT JOIN {prefix}_a a ON {' AND '.join(f'a.{c} = e.{c}' for c in groups)}
  LEFT JOIN {prefix}_t t ON {' AND '.join(f'e.{c} = t.{c}' for c in groups)})
"""


SALES_Y = """
, sl AS (SELECT sale_id, company_id, CAST(year(start_date) AS INTEGER) AS year, lower(sale_name) AS lname,
    sale_name, start_date, end_date, sale_type_id FROM sales)
"""


def with_recursive() -> str:
    """``with_`` for a query with a recursive CTE."""
    return with_().replace("WITH ", "WITH RECURSIVE ", 1)


def exact_matches(min_back: int, max_back: int) -> str:
    return SALES_Y + f"""
, m AS (SELECT c.sale_id, p.sale_id AS match_sale_id, p.year AS match_year, p.sale_name AS match_sale_name,
    p.start_date AS match_start_date, p.end_date AS match_end_date, p.sale_type_id AS match_sale_type_id
  FROM sl c JOIN sl p ON p.company_id = c.company_id AND p.lname = c.lname
   AND p.year >= c.year - {max_back} AND p.year <= c.year - {min_back} AND p.sale_id <> c.sale_id)
"""


def fuzzy_matches(min_back: int, max_back: int, threshold: float) -> str:
    """``m`` as in exact_matches with names that are similar instead of equal, and their ``ratio``.

    Ratcliff-Obershelp by its definition: the longest common run of a window (the first in the one name, then the first in the
    other, of equally long ones) splits it in two, and so on; the ratio is twice the matched characters over all. ``grid`` holds
    the length of the common run that starts at each pair of places, ``runs`` the longest run of each window as one number.
    """
    best = "max(least(g.k, {w}.ahi - g.i, {w}.bhi - g.j) * 1000000 + (999 - g.i) * 1000 + (999 - g.j)) AS best"
    inside = "g.an = {w}.an AND g.bn = {w}.bn AND g.i >= {w}.alo AND g.i < {w}.ahi AND g.j >= {w}.blo AND g.j < {w}.bhi"
    return SALES_Y + f"""
, pairs AS MATERIALIZED (SELECT DISTINCT c.lname AS an, p.lname AS bn FROM sl c JOIN sl p ON p.company_id = c.company_id
   AND p.year >= c.year - {max_back} AND p.year <= c.year - {min_back})
, chars_a AS (SELECT DISTINCT an, i, an[i] AS ch FROM (SELECT an, unnest(range(1, length(an) + 1)) AS i FROM pairs) u)
, chars_b AS (SELECT DISTINCT bn, j, bn[j] AS ch FROM (SELECT bn, unnest(range(1, length(bn) + 1)) AS j FROM pairs) u)
, equal_at AS (SELECT p.an, p.bn, a.i, b.j, a.i - row_number() OVER (PARTITION BY p.an, p.bn, a.i - b.j ORDER BY a.i) AS island
   FROM pairs p JOIN chars_a a ON a.an = p.an JOIN chars_b b ON b.bn = p.bn AND b.ch = a.ch)
, grid AS MATERIALIZED (SELECT an, bn, i, j, max(i) OVER (PARTITION BY an, bn, i - j, island) - i + 1 AS k FROM equal_at)
, runs(an, bn, alo, ahi, blo, bhi, best) AS (
   SELECT w.an, w.bn, w.alo, w.ahi, w.blo, w.bhi, {best.format(w="w")}
   FROM (SELECT an, bn, 1 AS alo, length(an) + 1 AS ahi, 1 AS blo, length(bn) + 1 AS bhi FROM pairs) w JOIN grid g ON {inside.format(w="w")}
   GROUP BY w.an, w.bn, w.alo, w.ahi, w.blo, w.bhi
   UNION ALL
   SELECT w.an, w.bn, w.alo, w.ahi, w.blo, w.bhi, {best.format(w="w")}
   FROM (SELECT an, bn, CASE side WHEN 0 THEN alo ELSE i + k END AS alo, CASE side WHEN 0 THEN i ELSE ahi END AS ahi,
           CASE side WHEN 0 THEN blo ELSE j + k END AS blo, CASE side WHEN 0 THEN j ELSE bhi END AS bhi
         FROM (SELECT *, best // 1000000 AS k, 999 - best // 1000 % 1000 AS i, 999 - best % 1000 AS j FROM runs) r, (VALUES (0), (1)) s(side)) w
   JOIN grid g ON {inside.format(w="w")}
   GROUP BY w.an, w.bn, w.alo, w.ahi, w.blo, w.bhi)
, alike AS (SELECT an, bn, CAST(2.0 AS DOUBLE) * CAST(sum(best // 1000000) AS BIGINT) / (length(an) + length(bn)) AS ratio FROM runs GROUP BY an, bn)
, m AS (SELECT c.sale_id, p.sale_id AS match_sale_id, p.year AS match_year, p.sale_name AS match_sale_name,
    p.start_date AS match_start_date, p.end_date AS match_end_date, p.sale_type_id AS match_sale_type_id, s.ratio
  FROM sl c JOIN sl p ON p.company_id = c.company_id
   AND p.year >= c.year - {max_back} AND p.year <= c.year - {min_back} AND p.sale_id <> c.sale_id
  JOIN alike s ON s.an = c.lname AND s.bn = p.lname AND s.ratio >= {threshold})
"""


# ---------------------------------------------------------------- training frame (own-country history)

TRAIN = ("""
, own_map AS (SELECT country_code, country_code AS hist_country FROM regions)
, tbase AS (SELECT * FROM base WHERE coalesce(is_passed_in, 0) = 0 AND price > 0)
""" + sire_sql(region_map="own_map", base="tbase") + dam_sql(region_map="own_map", base="tbase")
         + vendor_sql(region_map="own_map", base="tbase") + """
, tmed AS (SELECT sale_id, quantile_cont(CASE WHEN sold_flag = 1 AND price > 0 THEN price END, 0.5)
             AS session_median_price FROM tbase GROUP BY sale_id)
, tfeat AS (SELECT b.*, med.session_median_price,
    s.sire_sold_count_36m, s.sire_passedin_count_36m, s.sire_total_offered_36m, s.sire_clearance_rate_36m,
    s.sire_median_price_36m, s.sire_sold_count_12m, s.sire_passedin_count_12m, s.sire_total_offered_12m,
    s.sire_clearance_rate_12m, s.sire_median_price_12m, s.sire_momentum, s.sire_sample_flag_36m,
    d.dam_progeny_sold_count, d.dam_progeny_passedin_count, d.dam_progeny_total_offered_count,
    d.dam_progeny_median_price, d.dam_first_foal_flag,
    v.vendor_sold_count_36m, v.vendor_passedin_count_36m, v.vendor_total_offered_36m, v.vendor_clearance_rate_36m,
    v.vendor_median_price_36m, v.vendor_volume_bucket, v.vendor_first_seen_flag,
    ln(b.price / med.session_median_price) AS log_price_index,
    CASE WHEN b.sale_year >= {cutoff} THEN 'test'
         WHEN (b.lot_id * 31 + floor(b.lot_id / 7)) % 10 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM tbase b LEFT JOIN tmed med ON med.sale_id = b.sale_id
  LEFT JOIN sire_full s ON s.country_code = b.country_code AND s.sire_id = b.sire_id AND s.sale_date = b.sale_date
  LEFT JOIN dam d ON d.country_code = b.country_code AND d.dam_id = b.dam_id AND d.sale_date = b.sale_date
  LEFT JOIN vendor v ON v.country_code = b.country_code AND v.vendor_id = b.vendor_id AND v.sale_date = b.sale_date
  WHERE med.session_median_price > 0 AND b.price > 0)
, tpred AS (SELECT t.*, 2.0 * ln((0.5 * coalesce(t.sire_median_price_36m, t.session_median_price)
                                + 0.3 * coalesce(t.dam_progeny_median_price, t.session_median_price)
                                + 0.2 * coalesce(t.vendor_median_price_36m, t.session_median_price))
                               / t.session_median_price) AS pred_q50 FROM tfeat t)
, tpred2 AS (SELECT *, pred_q50 - 0.35 AS pred_q25, pred_q50 + 0.35 AS pred_q75 FROM tpred)
, enc_vals AS (SELECT DISTINCT country_code, 'sex' AS feature, coalesce(sex, 'Unknown') AS value FROM tfeat
               UNION SELECT DISTINCT country_code, 'vendor_volume_bucket', coalesce(vendor_volume_bucket, 'Unknown')
               FROM tfeat
               UNION SELECT DISTINCT country_code, 'sale_company', coalesce(sale_company, 'Unknown') FROM tfeat)
, enc AS (SELECT country_code, feature, value,
            CAST(dense_rank() OVER (PARTITION BY country_code, feature ORDER BY value) - 1 AS INTEGER) AS code
          FROM enc_vals)
""").replace("{cutoff}", str(FS.cutoff_year))
