"""Lot scans and the star join.

Everything is computed for all sales at once; a single-sale call is a filter on
``sale_id`` on top (Catalyst pushes it to the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.settings import Settings


def not_withdrawn(c: Column) -> Column:
    """``ISNULL(isWithdrawn, 0) = 0`` written so the parquet scan can push it down."""
    return c.isNull() | (c == 0)


def sold_flag(price: Column, passed_in: Column, withdrawn: Column) -> Column:
    """Price > 0 and not passed in and not withdrawn, NULL flags meaning 0."""
    return F.when((price > 0) & not_withdrawn(passed_in) & not_withdrawn(withdrawn), 1).otherwise(0)


def passed_in_flag(passed_in: Column) -> Column:
    """``ISNULL(isPassedIn, 0) = 1``."""
    return F.when(F.coalesce(passed_in, F.lit(0)) == 1, 1).otherwise(0)


def lot_flags(lot_rows: DataFrame) -> DataFrame:
    """P1/P2 on the raw lot table."""
    return lot_rows.select(
        "lot_id", "sale_id",
        sold_flag(F.col("price"), F.col("is_passed_in"), F.col("is_withdrawn")).alias("sold_flag"),
        passed_in_flag(F.col("is_passed_in")).alias("passed_in_flag"),
        F.when(not_withdrawn(F.col("is_withdrawn")), 0).otherwise(1).alias("withdrawn_flag"),
    )


def lot_view(lot_rows: DataFrame, sales: DataFrame, companies: DataFrame, countries: DataFrame,
             lot_types: DataFrame, horses: DataFrame, sire_names: DataFrame | None = None) -> DataFrame:
    """J1 inner star join + J2 left self-join for the sire name, all lot types and years.

    ``sire_names`` defaults to ``horses`` itself (the self-join); a separate
    sire dimension with the same (horse_id, horse_name) columns also works.
    The small dimensions (sales, companies, countries, lot types) are left to
    the planner: their parquet size is known, and AQE converts the join to a
    broadcast from measured sizes, with a shuffle join beyond the threshold.
    Lots meet their horses before they get the names of their sale, company and
    country, so that the large join deals narrow rows.
    """
    sire_names = horses if sire_names is None else sire_names
    sale = sales.select(
        "sale_id", F.col("start_date").alias("sale_date"), F.year("start_date").alias("sale_year"),
        "sale_name", "company_id", "country_id")
    comp = companies.select("company_id", F.col("company_name").alias("sale_company"))
    ctry = countries.select("country_id", "country_code")
    lt = lot_types.select("lot_type_id", F.col("lot_type_name").alias("lot_type"))
    h = horses.select("horse_id", "horse_name", "sire_id", "dam_id")
    sn = sire_names.select(F.col("horse_id").alias("sire_id"), F.col("horse_name").alias("sire_name"))
    j = (lot_rows.join(lt, "lot_type_id")
         .join(h, "horse_id")
         .join(sale, "sale_id")
         .join(comp, "company_id")
         .join(ctry, "country_id")
         .join(sn, "sire_id", "left"))
    return j.select(
        "lot_id", "sale_id", "sale_date", "sale_year", "company_id", "sale_company", "sale_name",
        "country_code", "book_number", "day_number", "lot_number", "sex", "sire_id", "dam_id",
        "vendor_id", "horse_id", "horse_name", "sire_name", "price", "lot_type",
        "is_passed_in", "is_withdrawn",
        sold_flag(F.col("price"), F.col("is_passed_in"), F.col("is_withdrawn")).alias("sold_flag"),
        passed_in_flag(F.col("is_passed_in")).alias("passed_in_flag"),
    )


def yearling_history(lots: DataFrame, lot_type: str = "Yearling") -> DataFrame:
    """One lot type, non-withdrawn, all years (the history every feature reads)."""
    return lots.where((F.col("lot_type") == lot_type) & not_withdrawn(F.col("is_withdrawn")))


def base_lots(lots: DataFrame, settings: Settings) -> DataFrame:
    """S1 for every sale: lot type, non-withdrawn, sale year inside [year_start, year_end].

    The year range is written as date bounds (P5) so it prunes by ``sale_date``.
    """
    lo = F.make_date(F.lit(settings.year_start), F.lit(1), F.lit(1))
    hi = F.make_date(F.lit(settings.get_year_end() + 1), F.lit(1), F.lit(1))
    out = (yearling_history(lots, settings.lot_type)
           .where((F.col("sale_date") >= lo) & (F.col("sale_date") < hi)))
    if "sale_year" in lots.columns:
        # same bounds on the year column: prunes whole partitions of a year-partitioned table
        out = out.where(F.col("sale_year").between(settings.year_start, settings.get_year_end()))
    return out


def hist_lots(lots: DataFrame, hist: DataFrame, settings: Settings) -> DataFrame:
    """The history rows visible to each region through its country set.

    ``hist`` is ``region_hist(regions, scope)``; output carries ``scope_country``
    (the region whose features may read the row).
    """
    h = F.broadcast(hist.select(F.col("country_code").alias("scope_country"),
                                F.col("hist_country").alias("country_code")))
    return yearling_history(lots, settings.lot_type).join(h, "country_code")


def training_lots(lots: DataFrame, settings: Settings) -> DataFrame:
    """S3: sold lots only (not withdrawn, not passed in, price > 0) in the year range."""
    return base_lots(lots, settings).where(
        not_withdrawn(F.col("is_passed_in")) & (F.col("price") > 0))


def sale_country(sales: DataFrame, countries: DataFrame) -> DataFrame:
    """Sale -> country code; a sale without a country drops out (the error case)."""
    return sales.join(countries, "country_id").select("sale_id", "country_code")


def require_sale_country(sales: DataFrame, countries: DataFrame, sale_id: int) -> str:
    """S5 for one sale: its country code; a missing sale (or country) is an error."""
    row = sale_country(sales.where(F.col("sale_id") == sale_id), countries).first()
    if row is None:
        raise ValueError(f"Sale {sale_id} not found or has no country")
    return row["country_code"]


def sale_header(sales: DataFrame, companies: DataFrame, countries: DataFrame, currencies: DataFrame,
                statuses: DataFrame, types: DataFrame, settings: Settings) -> DataFrame:
    """Sale header with inner company/country joins and left lookups, plus P7."""
    j = (sales.join(countries, "country_id")
         .join(companies, "company_id")
         .join(currencies, "currency_id", "left")
         .join(statuses, "status_id", "left")
         .join(types, "sale_type_id", "left"))
    return j.select(
        "sale_id", "sale_code", "sale_name", "start_date", "end_date", "is_online", "is_public",
        F.col("company_id").alias("sales_company_id"), F.col("sale_type_id").alias("sales_type_id"),
        F.col("company_name").alias("sale_company"), F.col("website").alias("company_website"),
        "country_code", "country_name", "currency_code", "currency_symbol",
        F.col("status").alias("sale_status"), F.col("sale_type_name").alias("sale_type"),
        upcoming_label(F.col("start_date"), settings).alias("status"),
    )


def upcoming_label(start_date: Column, settings: Settings) -> Column:
    """Date >= today -> 'upcoming'; earlier or NULL -> 'past'."""
    return F.when(start_date >= F.lit(settings.today), "upcoming").otherwise("past")
