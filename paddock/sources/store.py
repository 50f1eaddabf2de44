"""The store of predictions as a versioned table in buckets.

A key (horse_id, sale_id) belongs to one of BUCKETS buckets. ``data/v=N/bucket=B`` holds the rows of bucket B as version N
wrote them, and ``versions/v=N`` tells for each bucket which version's folder is valid in version N. An upsert reads and
writes the buckets that its batch touches and no others; the new list of folders, which comes last, makes the version visible. Readers
take the newest complete list, so a reader never sees half a version, and a failed writer leaves the last one valid.
One writer at a time; older versions stay readable until their folders are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.predictions import batch_rows, upsert, upsert_counts
from paddock.session import children, exists, freed, saved, work_path

KEYS = ["horse_id", "sale_id"]
BUCKETS, FILES = 64, 8     # buckets of a store; files of a bucket at most


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in KEYS]), F.lit(buckets)).cast("int")


class PredictionStore:
    """A store below ``root``; it is created from its first rows and keeps their columns and its number of buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _versions(self) -> list[int]:
        """The complete versions, oldest first."""
        names = [n for n in children(self.spark, f"{self.root}/versions") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if exists(self.spark, f"{self.root}/versions/{n}/_SUCCESS"))

    def folders(self, version: int | None = None) -> dict[int, int]:
        """{bucket: version whose folder holds it} of a version, the newest one without it."""
        known = self._versions()
        if not known:
            raise ValueError(f"no complete version below {self.root}")
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} isn't complete")
        rows = self.spark.read.parquet(f"{self.root}/versions/v={version}").collect()   # one row a bucket
        return {r["bucket"]: r["version"] for r in rows}

    def _rows(self, folders: dict[int, int]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, the newest one without it."""
        return self._rows(self.folders(version))

    def _publish(self, version: int, rows: DataFrame, folders: dict[int, int]) -> None:
        """Writes rows as the version's buckets and then the list that makes them valid; ``folders`` are the untouched ones."""
        path = f"{self.root}/data/v={version}"
        if exists(self.spark, path):
            freed(self.spark, path)        # left by a writer that didn't finish: no list names it
        part = F.pmod(F.xxhash64(*KEYS, F.lit("file")), F.lit(FILES))
        rows.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket", part).write.partitionBy("bucket").parquet(path)
        made = {int(n[7:]): version for n in children(self.spark, path) if n.startswith("bucket=")}
        listed = sorted({**folders, **made}.items())
        self.spark.createDataFrame(listed, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/v={version}")

    def create(self, rows: DataFrame) -> None:
        """Version 1 from the given rows."""
        if self._versions():
            raise ValueError(f"there is a store below {self.root}")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.root}/schema")
        self._publish(1, rows, {})

    def upsert(self, scored: DataFrame, regions: DataFrame, audit_user_id: int, run_ts: str) -> DataFrame:
        """The scored lots become the next version; returns (sale_id, inserted, updated). No lots: no new version."""
        version = self._versions()[-1]
        folders = self.folders(version)
        batch = saved(batch_rows(scored), work_path(self.spark, "store-batch"))     # scored once, read twice
        touched = {r[0] for r in batch.select(bucket_of(self.buckets)).distinct().collect()}   # at most BUCKETS
        old = self._rows({b: v for b, v in folders.items() if b in touched})
        snapshot = saved(upsert(old, batch, regions, audit_user_id, run_ts), work_path(self.spark, "store-snapshot"))
        if touched:
            rows = snapshot.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])
            self._publish(version + 1, rows, {b: v for b, v in folders.items() if b not in touched})
        return upsert_counts(snapshot)
