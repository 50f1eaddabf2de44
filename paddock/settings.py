"""Run parameters (global config block) and fixed model-side constants."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    """Global parameters. Nothing reads the clock: ``today`` and ``run_ts`` are inputs."""

    year_start: int = 2020
    year_end: int | None = None          # None -> year of ``today``
    model_test_last_years: int = 2
    sale_history_years: int = 5
    audit_user_id: int = 2
    today: dt.date = field(default_factory=lambda: dt.date(2026, 1, 1))
    run_ts: dt.datetime = field(default_factory=lambda: dt.datetime(2026, 1, 1, 0, 0, 0))
    lot_type: str = "Yearling"
    similarity_threshold: float = 0.75
    model_version: str = "v2.2"

    def get_year_end(self) -> int:
        return self.year_end if self.year_end is not None else self.today.year

    @property
    def cutoff_year(self) -> int:
        return self.get_year_end() - self.model_test_last_years + 1

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


# Parameters of the test fixture (FIXTURES.md "globals").
FIXTURE_SETTINGS = Settings(
    year_start=1997,
    year_end=2001,
    model_test_last_years=2,
    sale_history_years=5,
    today=dt.date(2001, 7, 1),
    run_ts=dt.datetime(2001, 7, 1, 0, 0, 0),
)

# Fixed values that must equal the reference's for identical results.
# Region defaults when a field is absent from the region config.
DEFAULT_ELITE_THRESHOLD = 500000.0
DEFAULT_ELITE_BASE_OFFSET = 0.25
DEFAULT_ELITE_SCALING_FACTOR = 0.5
DEFAULT_CLOSE_THRESHOLD = 0.7
DEFAULT_EXTREME_THRESHOLD = 1.0
DEFAULT_SIRE_SAMPLE_MIN_COUNT = 10
# Elite count in the score summary when the model carries no elite block.
SUMMARY_ELITE_FALLBACK_THRESHOLD = 300000.0
# Vendor volume buckets on the 36-month sold count: 0 New, <=5 Small, <=20 Medium, else Large.
VENDOR_BUCKET_SMALL_MAX = 5
VENDOR_BUCKET_MEDIUM_MAX = 20
# Sale price bands (half-open): 0-50k-100k-200k-500k-1m-inf.
PRICE_BAND_EDGES = (50000, 100000, 200000, 500000, 1000000)
# Ordered model feature list of a freshly trained model.
FEATURE_COLS = [
    "session_median_price",
    "sire_sold_count_36m",
    "sire_total_offered_36m",
    "sire_clearance_rate_36m",
    "sire_median_price_36m",
    "sire_sold_count_12m",
    "sire_total_offered_12m",
    "sire_clearance_rate_12m",
    "sire_median_price_12m",
    "sire_momentum",
    "dam_progeny_sold_count",
    "dam_progeny_total_offered_count",
    "dam_progeny_median_price",
    "vendor_sold_count_36m",
    "vendor_total_offered_36m",
    "vendor_clearance_rate_36m",
    "vendor_median_price_36m",
    "log_session_median_price",
    "log_sire_median_price_36m",
    "log_sire_median_price_12m",
    "log_dam_progeny_median_price",
    "log_vendor_median_price_36m",
    "sex_encoded",
    "vendor_volume_bucket_encoded",
    "sale_company_encoded",
    "sire_sample_flag_36m",
    "dam_first_foal_flag",
    "vendor_first_seen_flag",
]
# The feature list of the model in service, which differs from a freshly trained one's.
SERVED_FEATURE_COLS = [
    "book_number",
    "day_number",
    "log_session_median_price",
    "sex_encoded",
    "sale_company_encoded",
    "sire_sold_count_36m",
    "sire_total_offered_36m",
    "sire_clearance_rate_36m",
    "log_sire_median_price_36m",
    "sire_sold_count_12m",
    "sire_total_offered_12m",
    "sire_clearance_rate_12m",
    "log_sire_median_price_12m",
    "sire_momentum",
    "sire_sample_flag_36m",
    "dam_progeny_sold_count",
    "dam_progeny_total_offered_count",
    "log_dam_progeny_median_price",
    "dam_first_foal_flag",
    "vendor_sold_count_36m",
    "vendor_total_offered_36m",
    "vendor_clearance_rate_36m",
    "log_vendor_median_price_36m",
    "vendor_volume_bucket_encoded",
    "vendor_first_seen_flag",
]
# Price columns that get a log1p companion.
LOG_PRICE_COLS = [
    "session_median_price",
    "sire_median_price_36m",
    "sire_median_price_12m",
    "dam_progeny_median_price",
    "vendor_median_price_36m",
]
# Label-encoded categorical columns; NULL encodes as "Unknown".
CATEGORICAL_COLS = ["sex", "vendor_volume_bucket", "sale_company"]
# Inference export column order.
INFERENCE_EXPORT_COLS = [
    "lot_id", "horse_id", "sale_id", "lot_number", "book_number", "sex",
    "horse_name", "sire_name", "sale_company", "sale_year", "day_number",
    "session_median_price",
    "sire_sold_count_36m", "sire_total_offered_36m", "sire_clearance_rate_36m", "sire_median_price_36m",
    "sire_sold_count_12m", "sire_total_offered_12m", "sire_clearance_rate_12m", "sire_median_price_12m",
    "sire_momentum", "sire_sample_flag_36m",
    "dam_progeny_sold_count", "dam_progeny_total_offered_count", "dam_progeny_median_price", "dam_first_foal_flag",
    "vendor_sold_count_36m", "vendor_total_offered_36m", "vendor_clearance_rate_36m", "vendor_median_price_36m",
    "vendor_volume_bucket", "vendor_first_seen_flag",
]
