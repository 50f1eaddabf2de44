"""Stored predictions: read, compare, upsert, selective commit.

The store is keyed by (horse_id, sale_id). Instead of one statement per lot,
an upsert is one full outer join of the stored rows with the new batch that
yields the next snapshot (written to a new path and swapped in by the caller:
parquet tables cannot be rewritten while being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.rounding import py_round

STORE_COLS = ["market_value", "market_value_low", "market_value_high", "market_value_multiplier",
              "confidence", "session_median_price"]


AUDIT_COLS = ["created_by", "created_on", "modified_by", "modified_on"]


def batch_rows(scored: DataFrame, order_col: str = "lot_id") -> DataFrame:
    """Scored lots -> store rows, one for each key: the last by ``order_col`` (X17); ``batch_rows`` counts them."""
    keys = ["horse_id", "sale_id"]
    rows = scored.select(
        *keys, "country_code",
        F.col("mv_expected_price").alias("market_value"),
        F.col("mv_low_price").alias("market_value_low"),
        F.col("mv_high_price").alias("market_value_high"),
        F.col("mv_expected_index").alias("market_value_multiplier"),
        F.col("mv_confidence_tier").alias("confidence"),
        "session_median_price", F.col(order_col).alias("_order"))
    value = F.struct("_order", *[c for c in rows.columns if c not in (*keys, "_order")])
    last = rows.groupBy(*keys).agg(F.max(value).alias("_v"), F.count(F.lit(1)).alias("batch_rows"))
    return last.select(*keys, "_v.*", "batch_rows").drop("_order")


def upsert(store: DataFrame, batch: DataFrame, regions: DataFrame, audit_user_id: int, run_ts: str) -> DataFrame:
    """The next store snapshot, each row tagged insert / update / keep.

    New values come with the region's currency and the audit user and time; a kept row keeps its own, and every
    other column of the store is carried along.
    """
    keys = ["horse_id", "sale_id"]
    cur = F.broadcast(regions.select("country_code", F.col("currency_id").alias("_cur")))
    b = batch.join(cur, "country_code", "left").select(
        *keys, *[F.col(c).alias(f"n_{c}") for c in STORE_COLS], F.col("_cur").alias("n_currency_id"), "batch_rows")
    audit = [c for c in AUDIT_COLS if c in store.columns]
    more = [c for c in store.columns if c not in (*keys, *STORE_COLS, "currency_id", *AUDIT_COLS)]
    s = store.select(*keys, *[F.col(c).alias(f"o_{c}") for c in (*STORE_COLS, "currency_id", *audit)], *more,
                     F.lit(True).alias("_old"))
    j = s.join(b.withColumn("_new", F.lit(True)), keys, "full_outer")
    new, old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    action = F.when(new & old, "update").when(new, "insert").otherwise("keep")
    cols = [F.when(new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in (*STORE_COLS, "currency_id")]
    stored = {c: F.col(f"o_{c}") if c in audit else F.lit(None) for c in AUDIT_COLS}
    user, now = F.lit(audit_user_id).cast("long"), F.lit(run_ts)
    return j.select(*keys, *cols, *more,
                    F.when(old, stored["created_by"]).otherwise(user).alias("created_by"),
                    F.when(old, stored["created_on"]).otherwise(now).alias("created_on"),
                    F.when(new, user).otherwise(stored["modified_by"]).alias("modified_by"),
                    F.when(new, now).otherwise(stored["modified_on"]).alias("modified_on"),
                    action.alias("action"), F.coalesce("batch_rows", F.lit(0)).alias("batch_rows"))


def upsert_counts(snapshot: DataFrame) -> DataFrame:
    """(inserted, updated) per sale. Of several batch rows of one new key the first inserts, the others update."""
    inserted = F.sum(F.when(F.col("action") == "insert", 1).otherwise(0)).cast("long")
    return snapshot.where(F.col("action") != "keep").groupBy("sale_id").agg(
        inserted.alias("inserted"), (F.sum("batch_rows") - inserted).cast("long").alias("updated"))


def rejected(selection: DataFrame, scored: DataFrame) -> DataFrame:
    """The selected (sale_id, lot_id) that can't be committed: without a score, or scored under another sale."""
    found = scored.select("lot_id", F.col("sale_id").alias("_scored_sale"))
    j = selection.select("sale_id", "lot_id").join(found, "lot_id", "left")
    reason = F.when(F.col("_scored_sale").isNull(), "not scored").when(F.col("_scored_sale") != F.col("sale_id"), "other sale")
    return j.select("sale_id", "lot_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def commit(store: DataFrame, scored: DataFrame, selection: DataFrame, regions: DataFrame,
           audit_user_id: int, run_ts: str) -> DataFrame:
    """The counts per sale of committing the selected lots.

    ``selection`` is (sale_id, lot_id) as requested for that sale. A selected lot without a score, or scored under
    another sale, is an error as in the source, raised when its row is computed; ``rejected`` lists such rows.
    """
    j = selection.select(F.col("sale_id").alias("_path_sale"), "lot_id").join(scored, "lot_id", "left")
    fits = F.coalesce(F.col("sale_id") == F.col("_path_sale"), F.lit(False))
    error = F.raise_error(F.concat(F.lit("a committed lot does not belong to the sale it was committed for, or has no score: lot "),
                                   F.col("lot_id").cast("string")))
    chosen = j.withColumn("sale_id", F.when(fits, F.col("sale_id")).otherwise(error.cast("long"))).drop("_path_sale")
    snap = upsert(store, batch_rows(chosen), regions, audit_user_id, run_ts)
    c = upsert_counts(snap)
    return c.withColumn("total", F.col("inserted") + F.col("updated"))


def compare(scored: DataFrame, store: DataFrame) -> DataFrame:
    """J13 + M18: new scores next to the stored values with deltas.

    is_new: no stored row. Deltas exist only when the stored expected value is
    not NULL; % delta is 0 when it is 0. changed: rounded delta != 0.
    """
    s = store.select("horse_id", "sale_id", F.col("market_value").alias("old_expected"),
                     F.col("market_value_low").alias("old_low"), F.col("market_value_high").alias("old_high"),
                     *[(F.col(c) if c in store.columns else F.lit(None)).alias(name) for c, name in (
                         ("market_value_multiplier", "old_index"), ("confidence", "old_tier"),
                         ("session_median_price", "old_session_median"))],
                     F.lit(True).alias("_has"))
    j = scored.join(s, ["horse_id", "sale_id"], "left")
    has_old = F.col("_has").isNotNull()
    has_delta = has_old & F.col("old_expected").isNotNull()
    d = F.col("mv_expected_price") - F.col("old_expected")
    pct = F.when(F.col("old_expected") != 0, d / F.col("old_expected") * F.lit(100.0)).otherwise(F.lit(0.0))
    out = j.select(
        "lot_id", "horse_id", "sale_id", *[c for c in ("lot_number", "horse_name", "sire_name") if c in scored.columns],
        "mv_expected_price",
        (~has_old).alias("is_new"),
        "old_expected", "old_low", "old_high", "old_index", "old_tier", "old_session_median",
        F.when(has_delta, d).alias("_delta"),
        F.when(has_delta, pct).alias("_pct"),
        F.when(has_delta, py_round(d, 2)).alias("delta_expected"),
        F.when(has_delta, py_round(pct, 2)).alias("delta_expected_pct"),
        F.when(has_delta & F.col("old_low").isNotNull(), py_round(F.col("mv_low_price") - F.col("old_low"), 2))
         .alias("delta_low"),
        F.when(has_delta & F.col("old_high").isNotNull(), py_round(F.col("mv_high_price") - F.col("old_high"), 2))
         .alias("delta_high"),
    )
    return out.withColumn("changed", has_delta_changed())


def has_delta_changed():
    return F.coalesce(F.col("delta_expected") != 0, F.lit(False)) & ~F.col("is_new")


def compare_summary(compared: DataFrame) -> DataFrame:
    """A23 per sale: counts and mean deltas (mean before rounding; 0 when none)."""
    g = compared.groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("total_lots"),
        F.sum(F.col("is_new").cast("int")).cast("long").alias("new_lots"),
        F.sum(F.col("changed").cast("int")).cast("long").alias("changed_lots"),
        F.avg("_delta").alias("_ad"), F.avg("_pct").alias("_ap"))
    return g.select(
        "sale_id", "total_lots", "new_lots", (F.col("total_lots") - F.col("new_lots")).alias("existing_lots"),
        "changed_lots", (F.col("total_lots") - F.col("new_lots") - F.col("changed_lots")).alias("unchanged_lots"),
        py_round(F.coalesce(F.col("_ad"), F.lit(0.0)), 2).alias("avg_price_delta"),
        py_round(F.coalesce(F.col("_ap"), F.lit(0.0)), 2).alias("avg_price_delta_pct"))


def write_snapshot(snapshot: DataFrame, store_root: str, version: int) -> str:
    """S9 sink: the next store version goes to a new path; readers switch to it afterwards.

    A parquet table cannot be overwritten while it is the input of the same
    job, so every upsert writes ``{store_root}/v={version}`` and the caller
    points readers at the newest complete version.
    """
    path = f"{store_root.rstrip('/')}/v={version}"
    snapshot.drop("action", "batch_rows").write.mode("errorifexists").parquet(path)
    return path
