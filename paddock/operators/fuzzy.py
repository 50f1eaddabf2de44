"""Matching sales across years and the blocks built on matches.

A *match* is (current sale, candidate sale): same company, candidate year in
[current year - max_back, current year - min_back], different id, and a name
similarity >= threshold (``mode='fuzzy'``) or equal lower-cased names
(``mode='exact'``). The similarity is not symmetric, so the pair is scored as
(current, candidate) and never canonicalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.similarity import char_tokens_udf, name_ratio, overlap_fraction
from paddock.packaging import ship_package
from paddock.operators.salestats import COUNT_COLS, QUARTILES, STAT_COLS, YOY_STATS, sale_stats, yoy_change
from paddock.session import saved, work_path


def _sales(sales: DataFrame) -> DataFrame:
    return sales.select("sale_id", "company_id", F.year("start_date").alias("year"), "sale_name",
                        F.lower("sale_name").alias("lname"), "start_date", "end_date", "sale_type_id")


def prefix_tokens(names: DataFrame, threshold: float) -> DataFrame:
    """Each name's prefix tokens under the global rarest-first order (exact candidate keys).

    Document frequency is counted over distinct names (a token table bounded by
    alphabet x longest name); the per-name ranking window holds one name's
    characters only.
    """
    toks = names.withColumn("tok", F.explode(char_tokens_udf(F.col("lname"))))
    freq = toks.select("lname", "tok").distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    p, d = overlap_fraction(threshold)
    n = F.length("lname")
    keep = F.greatest(n - F.expr(f"({p} * length(lname) + {d - 1}) div {d}") + F.lit(1), F.lit(1))
    w = Window.partitionBy("company_id", "year", "lname").orderBy("df", "tok")
    return (toks.join(freq, "tok").withColumn("_rk", F.row_number().over(w))
            .where(F.col("_rk") <= keep).drop("_rk", "df"))


def name_pairs(sales: DataFrame, min_back: int, max_back: int, threshold: float = 0.75) -> DataFrame:
    """Distinct (company, cur year, cur name, cand year, cand name, ratio) with ratio >= threshold.

    Candidates come from the prefix-token similarity join (exact, see
    ``functions.similarity``), then a length filter, then the exact ratio.
    """
    ship_package(sales.sparkSession)
    names = _sales(sales).select("company_id", "year", "lname").distinct()
    tok = prefix_tokens(names, threshold)
    a, b = tok.alias("a"), tok.alias("b")
    cand = (a.join(b, (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.tok") == F.col("b.tok"))
                   & (F.col("b.year") >= F.col("a.year") - max_back) & (F.col("b.year") <= F.col("a.year") - min_back))
            .select(F.col("a.company_id").alias("company_id"), F.col("a.year").alias("cur_year"),
                    F.col("a.lname").alias("cur_lname"), F.col("b.year").alias("cand_year"),
                    F.col("b.lname").alias("cand_lname"))
            .distinct())
    la, lb = F.length("cur_lname"), F.length("cand_lname")
    # necessary: ratio <= 2 min / (la + lb)
    cand = cand.where(F.lit(2.0) * F.least(la, lb) >= F.lit(threshold) * (la + lb) - F.lit(1e-9))
    pairs = cand.select("cur_lname", "cand_lname").distinct()
    scored = pairs.withColumn("ratio", name_ratio(F.col("cur_lname"), F.col("cand_lname")))
    scored = scored.where(F.col("ratio") >= threshold)
    return cand.join(scored, ["cur_lname", "cand_lname"])


def matches(sales: DataFrame, min_back: int, max_back: int, mode: str = "fuzzy",
            threshold: float = 0.75) -> DataFrame:
    """(sale_id, match_sale_id, match_year, ...) for every sale."""
    s = _sales(sales)
    cur = s.select(F.col("sale_id"), F.col("company_id"), F.col("year").alias("cur_year"),
                   F.col("lname").alias("cur_lname"))
    cand = s.select(F.col("sale_id").alias("match_sale_id"), F.col("company_id"),
                    F.col("year").alias("match_year"), F.col("lname").alias("cand_lname"),
                    F.col("sale_name").alias("match_sale_name"), F.col("start_date").alias("match_start_date"),
                    F.col("end_date").alias("match_end_date"), F.col("sale_type_id").alias("match_sale_type_id"))
    if mode == "exact":
        j = cur.join(cand, (cur.company_id == cand.company_id) & (cur.cur_lname == cand.cand_lname)
                     & (cand.match_year >= cur.cur_year - max_back) & (cand.match_year <= cur.cur_year - min_back))
        j = j.drop(cand.company_id).withColumn("ratio", F.lit(1.0))
    else:
        np_ = name_pairs(sales, min_back, max_back, threshold)
        j = (cur.join(np_, ["company_id", "cur_year", "cur_lname"])
             .join(cand.withColumnRenamed("match_year", "cand_year"), ["company_id", "cand_year", "cand_lname"])
             .withColumnRenamed("cand_year", "match_year"))
    return (j.where(F.col("sale_id") != F.col("match_sale_id"))
            .select("sale_id", "match_sale_id", "match_year", "match_sale_name", "match_start_date",
                    "match_end_date", "match_sale_type_id", "ratio"))


def _matched(sales: DataFrame, back: int, mode: str, threshold: float) -> DataFrame:
    """The matches, evaluated once: pairs of sales are few, and the similarity UDF stays out of every later branch."""
    return saved(matches(sales, 1, back, mode, threshold), work_path(sales.sparkSession, "sale-matches"))


def prior_year_block(sales: DataFrame, lot_rows: DataFrame, mode: str = "fuzzy",
                     threshold: float = 0.75, columns: list[str] | None = None) -> DataFrame:
    """A17 + A18: pooled stats over all matched sales of year - 1, and the YoY block.

    ``columns``: the pooled statistics wanted besides those of the YoY block (all without it).
    """
    m = _matched(sales, 1, mode, threshold)
    wanted = [c for c in STAT_COLS if c in YOY_STATS or columns is None or c in columns]
    meta = m.groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("prior_sale_count"),
        F.array_sort(F.collect_list(F.struct("match_start_date", "match_sale_id", "match_sale_name"))).alias("_l"),
        F.min("match_start_date").alias("prior_start_date"),
        F.max("match_end_date").alias("prior_end_date"))
    # a sale itself and its matches are two groups of sales: both come from one reading of the lots
    own = m.select("sale_id").distinct().select("sale_id", F.lit("own").alias("side"), F.col("sale_id").alias("member"))
    members = m.select("sale_id", F.lit("prior").alias("side"), F.col("match_sale_id").alias("member")).unionByName(own)
    both = sale_stats(lot_rows, members.select(F.col("sale_id").alias("group_id"), "side", F.col("member").alias("sale_id")),
                      ["group_id", "side"], columns=wanted).withColumnRenamed("group_id", "sale_id")
    both = saved(both, work_path(sales.sparkSession, "sale-years"))   # two rows a sale
    prior, cur = (both.where(F.col("side") == s).drop("side") for s in ("prior", "own"))
    yoy = yoy_change(cur, prior)
    p = prior.select("sale_id", *[F.col(c).alias(f"prior_{c}") for c in wanted])
    out = meta.join(p, "sale_id").join(yoy, "sale_id", "left")
    return out.withColumn("prior_sale_ids", F.col("_l.match_sale_id")).withColumn("prior_sale_names", F.col("_l.match_sale_name")).drop("_l")


def history_block(sales: DataFrame, lot_rows: DataFrame, years: int, mode: str = "fuzzy",
                  threshold: float = 0.75) -> DataFrame:
    """Per (sale, matched year): ordered id/name/type lists and pooled stats; ``years=0`` disables."""
    m = _matched(sales, years, mode, threshold) if years > 0 else matches(sales, 1, 1, "exact").where(F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("match_start_date", "match_sale_id", "match_sale_name",
                                                   "match_sale_type_id")))
    meta = m.groupBy("sale_id", F.col("match_year").alias("year")).agg(
        ordered.alias("_l"), F.min("match_start_date").alias("start_date"),
        F.max("match_end_date").alias("end_date"))
    meta = meta.select("sale_id", "year",
                       F.col("_l.match_sale_id").alias("sale_ids"),
                       F.col("_l.match_sale_name").alias("sale_names"),
                       F.col("_l.match_sale_type_id").alias("sale_type_ids"),
                       "start_date", "end_date")
    mem = m.select(F.col("sale_id").alias("group_id"), F.col("match_year").alias("year"),
                   F.col("match_sale_id").alias("sale_id"))
    st = sale_stats(lot_rows, mem, ["group_id", "year"], columns=[
        *COUNT_COLS, "clearance_rate", "gross", "avg_price", *QUARTILES, "top10_avg"]).withColumnRenamed("group_id", "sale_id")
    return meta.join(st, ["sale_id", "year"])
