"""Per-input wiring: fixture tables -> the shared DataFrames every plan starts from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from paddock.operators import lots as L
from paddock.operators import pointintime as P
from paddock.settings import FIXTURE_SETTINGS, Settings
from paddock.sources import regions as R
from paddock.sources import typed as TY
from paddock.sources.fixture import Fixture


class Context:
    _cache: dict[tuple, "Context"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE_SETTINGS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.settings = settings
        self.fx = Fixture.of(spark, sf_dir)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Context":
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def t(self, name: str) -> DataFrame:
        return self.fx.table(name)

    @cached_property
    def regions(self) -> DataFrame:
        return R.region_dim(self.spark)

    @cached_property
    def offsets(self) -> DataFrame:
        return R.model_offsets(self.spark, self.regions)

    @property
    def lots(self) -> DataFrame:
        """The joined lot view (all lot types, all years), for plans that read it once: only their columns are joined."""
        fx = self.fx
        return L.lot_view(fx.table("lot_rows"), fx.table("sales"), fx.table("companies"), fx.table("countries"),
                          fx.table("lot_types"), fx.table("horses"), fx.table("sires"))

    @property
    def yearlings(self) -> DataFrame:
        """The lots that features and medians read, all years, written once: such plans read them several times."""
        return self.fx.derived("yearlings", lambda: L.yearling_history(self.lots, self.settings.lot_type), partition_by="sale_year")

    def typed(self, name: str) -> DataFrame:
        """A table with its declared types: prices are decimals."""
        return TY.typed(self.t(name), name)

    @property
    def typed_lots(self) -> DataFrame:
        """The lot view over typed tables."""
        return self.fx.derived("lot_view_typed", lambda: L.lot_view(*(self.typed(t) for t in (
            "lot_rows", "sales", "companies", "countries", "lot_types", "horses", "sires"))), partition_by="sale_year")

    @property
    def hot_keys(self) -> DataFrame:
        """The crowded sires, dams and vendors of the history (few or none)."""
        return self.fx.derived("hot_keys", lambda: P.hot_keys(self.history))

    @property
    def base(self) -> DataFrame:
        return L.base_lots(self.yearlings, self.settings)

    @property
    def history(self) -> DataFrame:
        return L.yearling_history(self.yearlings, self.settings.lot_type)
