"""Auction-schema test tables derived from the driver's TPC-H-like parquet.

The mapping is plain SQL that Spark SQL and DuckDB both accept, so the Spark
tables and the DuckDB oracle see identical inputs. Spark materialises each
table when it is first read, once per input set, below the shared folder
(``spark.checkpoint.dir``): later jobs read parquet instead of re-running the
lineitem x orders join, and the lineage is cut, so a lost executor only
recomputes from those files. Projections of the lots are not written again.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession

from paddock.session import SHUFFLE_CLEANUP, shared_dir, with_conf

FIXTURE_VERSION = "4"

TPCH_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "events")

# The lot mapping of FIXTURES.md, used verbatim.
LOTS_SRC_SQL = """
SELECT l_orderkey*1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)               AS lot_id,
  (year(o_orderdate)*100 + month(o_orderdate))*10 + n_regionkey                    AS sale_id,
  CAST(date_trunc('month', o_orderdate) AS DATE)                                   AS sale_date,
  year(o_orderdate) AS sale_year, upper(substr(r_name,1,3)) AS country_code,
  n_regionkey*10 + month(o_orderdate)%3                                            AS company_id,
  concat(r_name, ' ', CASE WHEN month(o_orderdate)<=3 THEN 'Premier Yearling Sale'
         WHEN month(o_orderdate)<=6 THEN 'Autumn Classic' WHEN month(o_orderdate)<=9 THEN 'Winter Mixed Bloodstock'
         ELSE 'Showcase Auction' END,
         CASE WHEN year(o_orderdate)%3=1 THEN concat(' ', CAST(year(o_orderdate) AS VARCHAR(4))) ELSE '' END) AS sale_name,
  CASE WHEN l_partkey%97=0 THEN NULL ELSE CAST(floor(l_partkey/10.0) AS BIGINT) END AS sire_id,
  o_custkey AS dam_id,
  CASE WHEN l_partkey%4=0 THEN l_suppkey%10 ELSE 1000+l_suppkey*20+l_partkey%20 END AS vendor_id,
  CASE WHEN l_discount=0.0 OR o_orderdate >= DATE '2001-07-01' THEN NULL
       ELSE CAST(round(l_extendedprice) AS DOUBLE) END                              AS price,
  CASE WHEN l_returnflag='R' AND l_linestatus='O' THEN 1 WHEN l_returnflag='N' THEN NULL ELSE 0 END AS is_passed_in,
  CASE WHEN l_returnflag='A' AND l_linestatus='F' AND l_linenumber<=2 THEN 1
       WHEN l_linestatus='O' THEN NULL ELSE 0 END                                   AS is_withdrawn,
  CASE WHEN l_linenumber<=5 THEN 'Yearling' WHEN l_linenumber=6 THEN 'Weanling' ELSE 'Broodmare' END AS lot_type,
  CASE WHEN CAST(l_quantity AS INT)%2=0 THEN 'Colt' ELSE 'Filly' END                AS sex,
  CASE WHEN l_tax=0.0 THEN NULL WHEN l_linenumber<=3 THEN 1 ELSE 2 END              AS book_number,
  l_linenumber%3 + 1                                                               AS day_number
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON c_custkey=o_custkey
JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
"""

# The normalised auction tables built on top of lots_src. Each
# entry is (name, SQL); later entries may read earlier ones.
TABLE_SQL: list[tuple[str, str]] = [
    ("lots_src", LOTS_SRC_SQL),
    ("lot_rows", """
SELECT CAST(lot_id AS BIGINT) AS lot_id, CAST(sale_id AS BIGINT) AS sale_id,
  CAST(book_number AS INT) AS book_number, CAST(day_number AS INT) AS day_number,
  CAST(lot_id % 1999 + 1 AS INT) AS lot_number, sex, CAST(vendor_id AS BIGINT) AS vendor_id,
  CAST(lot_id AS BIGINT) AS horse_id, price,
  CAST(is_passed_in AS INT) AS is_passed_in, CAST(is_withdrawn AS INT) AS is_withdrawn,
  CAST(CASE lot_type WHEN 'Yearling' THEN 1 WHEN 'Weanling' THEN 2 ELSE 3 END AS BIGINT) AS lot_type_id
FROM lots_src"""),
    ("horses", """
SELECT CAST(lot_id AS BIGINT) AS horse_id, concat('Horse ', CAST(lot_id AS VARCHAR(20))) AS horse_name,
  CAST(sire_id AS BIGINT) AS sire_id, CAST(dam_id AS BIGINT) AS dam_id
FROM lots_src"""),
    ("sires", """
SELECT DISTINCT CAST(floor(p_partkey/10.0) AS BIGINT) AS horse_id,
  concat('Sire ', CAST(CAST(floor(p_partkey/10.0) AS BIGINT) AS VARCHAR(20))) AS horse_name
FROM part"""),
    ("sales", """
SELECT sale_id, concat('S', CAST(sale_id AS VARCHAR(20))) AS sale_code, sale_name, start_date,
  CASE WHEN sale_id % 10 = 4 THEN NULL ELSE CAST(start_date + INTERVAL 2 DAY AS DATE) END AS end_date,
  company_id, CAST(month(start_date) % 3 + 1 AS BIGINT) AS sale_type_id,
  CAST(sale_id % 10 AS BIGINT) AS country_id,
  CAST(CASE WHEN start_date >= DATE '2001-07-01' THEN 1 ELSE 2 END AS BIGINT) AS status_id,
  (sale_id % 10 = 2) AS is_online, TRUE AS is_public
FROM (SELECT CAST(sale_id AS BIGINT) AS sale_id, min(sale_name) AS sale_name, min(sale_date) AS start_date,
             CAST(min(company_id) AS BIGINT) AS company_id
      FROM lots_src GROUP BY sale_id) s"""),
    ("companies", """
SELECT company_id,
  concat(country_code, CASE company_id % 10 WHEN 0 THEN ' Thoroughbred Sales'
                                            WHEN 1 THEN ' Bloodstock Auctions'
                                            ELSE ' Yearling Company' END) AS company_name,
  concat('www.', lower(country_code), CAST(company_id % 10 AS VARCHAR(2)), '.example') AS website
FROM (SELECT DISTINCT CAST(company_id AS BIGINT) AS company_id, country_code FROM lots_src) c"""),
    ("countries", """
SELECT CAST(r_regionkey AS BIGINT) AS country_id, upper(substr(r_name,1,3)) AS country_code,
  r_name AS country_name, CAST(r_regionkey + 1 AS BIGINT) AS currency_id
FROM region"""),
    ("currencies", """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS currency_id, concat(upper(substr(r_name,1,2)), 'D') AS currency_code,
  '$' AS currency_symbol
FROM region WHERE r_regionkey < 4"""),
    ("sale_statuses", """
SELECT CAST(status_id AS BIGINT) AS status_id, status
FROM (VALUES (1, 'Scheduled'), (2, 'Completed')) AS t(status_id, status)"""),
    ("sale_types", """
SELECT CAST(sale_type_id AS BIGINT) AS sale_type_id, sale_type_name
FROM (VALUES (1, 'Yearling Sale'), (2, 'Mixed Sale')) AS t(sale_type_id, sale_type_name)"""),
    ("lot_types", """
SELECT CAST(lot_type_id AS BIGINT) AS lot_type_id, lot_type_name
FROM (VALUES (1, 'Yearling'), (2, 'Weanling'), (3, 'Broodmare')) AS t(lot_type_id, lot_type_name)"""),
    ("predictions", """
SELECT horse_id, sale_id, market_value,
  market_value * 0.7 AS market_value_low, market_value * 1.4 AS market_value_high,
  market_value / 50000.0 AS market_value_multiplier,
  CASE WHEN market_value IS NULL THEN NULL ELSE 'medium' END AS confidence,
  CAST(50000.0 AS DOUBLE) AS session_median_price,
  CAST(sale_id % 10 + 1 AS BIGINT) AS currency_id,
  CAST(horse_id % 7 + 10 AS BIGINT) AS created_by, '2000-01-02 03:04:05' AS created_on,
  CASE WHEN horse_id % 2 = 0 THEN CAST(55 AS BIGINT) END AS modified_by,
  CASE WHEN horse_id % 2 = 0 THEN '2000-02-03 04:05:06' END AS modified_on
FROM (SELECT CAST(lot_id AS BIGINT) AS horse_id, CAST(sale_id AS BIGINT) AS sale_id,
        CASE WHEN lot_id % 21 = 0 THEN NULL
             WHEN price IS NULL THEN CAST(40000.0 AS DOUBLE)
             ELSE CAST(floor(price * 1.1 / 100 + 0.5) * 100 AS DOUBLE) END AS market_value
      FROM lots_src WHERE lot_type = 'Yearling' AND lot_id % 3 = 0) p"""),
    ("session_overrides", """
SELECT sale_id, CAST(50000.0 AS DOUBLE) AS session_median_override
FROM sales WHERE sale_id % 10 = 3 AND year(start_date) = 1999"""),
    ("report_queue", """
SELECT sale_id,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS in_queue,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS postponed,
  max(ts) AS last_completed
FROM (SELECT CAST(((1995 + CAST(floor(user_id / 12) AS BIGINT) % 7) * 100 + user_id % 12 + 1) * 10
                  + user_id % 5 AS BIGINT) AS sale_id, event_type, ts
      FROM events) e
GROUP BY sale_id"""),
]

TABLE_NAMES = [n for n, _ in TABLE_SQL]
ROW_WISE = ("lot_rows", "horses", "predictions")   # projections of lots_src: read from its files, not written again
READS = {"sales": ("lots_src",), "companies": ("lots_src",), "session_overrides": ("sales",)}

# The orders' side of the joins of LOTS_SRC_SQL comes first, so that lineitem is dealt once, by its order; rows are the same.
LOCATED_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate, n_regionkey, r_name
FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
"""
LOTS_BY_ORDER_SQL = (LOTS_SRC_SQL.split("FROM lineitem JOIN")[0].replace("SELECT", "SELECT /*+ SHUFFLE_HASH(located) */", 1)
                     + "FROM lineitem JOIN located ON l_orderkey=o_orderkey")
INPUT_BYTES = 4 << 20        # input bytes of a partition of the joins: the sorts of a task stay small whatever the input
PARTITION_BYTES = "16m"      # of shuffled data, where small partitions are put together


def oracle_prefix(names: list[str] | None = None) -> str:
    """``WITH`` clause defining the fixture tables for a DuckDB oracle query."""
    wanted = set(names or TABLE_NAMES)
    # keep dependencies: anything may read lots_src / sales
    parts = []
    for name, sql in TABLE_SQL:
        if name in wanted or name in ("lots_src", "sales"):
            parts.append(f"{name} AS ({sql.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"


def _signature(spark: SparkSession, sf_dir: str) -> str:
    """Of this run and of the input files (path, length, modification time, as the Hadoop filesystem lists them):
    derived tables are never shared between runs, and never outlive their input."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1(f"{FIXTURE_VERSION} {spark.sparkContext.applicationId} {sf_dir}".encode())
    for t in TPCH_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        files = fs.listStatus(path) if fs.exists(path) else []
        for s in sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files):
            h.update(s.encode())
    return h.hexdigest()[:16]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the session's Hadoop filesystem (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


class Fixture:
    """The auction tables for one input directory, materialised once."""

    _cache: dict[tuple, "Fixture"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        # dates are day-exact only in UTC (TIMESTAMP -> DATE casts follow the session zone)
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir
        self.root = f"{shared_dir(spark)}/paddock_tables/{_signature(spark, sf_dir)}"
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Fixture":
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        fx = cls._cache.get(key)
        if fx is None:
            fx = cls(spark, sf_dir)
            cls._cache[key] = fx
        return fx

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _done(self, path: str) -> bool:
        """A finished table has its ``_SUCCESS`` marker (works for any Hadoop filesystem)."""
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def sized(self):
        """Inside, tables are written with the settings for the size of the input."""
        return with_conf(self.spark, self._sizes())

    def _sizes(self) -> dict[str, str]:
        """Settings of the jobs that write tables: partitions in proportion to the input, so that no sort has to spill."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        size = 0
        for t in ("lineitem", "orders"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{t}.parquet")
            size += path.getFileSystem(conf).getContentSummary(path).getLength()
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / INPUT_BYTES))
        return {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION_BYTES}

    def _session(self, tables: tuple[str, ...]) -> SparkSession:
        """A sibling session with these tables as views: same SparkContext, its own temp views and SQL conf, so the
        caller's views named lineitem/orders/... are never replaced."""
        spark = self.spark.newSession()
        for k, v in {"spark.sql.session.timeZone": "UTC", SHUFFLE_CLEANUP: "true", **self._sizes()}.items():
            spark.conf.set(k, v)
        for t in tables:
            path = self._written(t) if t in TABLE_NAMES else f"{self.sf_dir}/{t}.parquet"
            spark.read.parquet(path).createOrReplaceTempView(t)
        return spark

    def _written(self, name: str) -> str:
        """The folder of a table, which is written first if it isn't there, as are the tables that it reads."""
        path = f"{self.root}/{name}"
        if not self._done(path):
            spark = self._session(READS.get(name, TPCH_TABLES))
            sql = dict(TABLE_SQL)[name]
            if name == "lots_src":
                spark.sql(LOCATED_SQL).createOrReplaceTempView("located")
                sql = LOTS_BY_ORDER_SQL
            spark.sql(sql).write.mode("overwrite").parquet(path)
        return path

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in ROW_WISE:
                sql = dict(TABLE_SQL)[name].replace("FROM lots_src", "FROM {lots_src}")
                self._tables[name] = self.spark.sql(sql, lots_src=self.table("lots_src"))
            else:
                self._tables[name] = self.spark.read.parquet(self._written(name))
        return self._tables[name]

    def derived(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        """A table Spark derives from the fixture, written once below the shared folder."""
        if name not in self._tables:
            path = f"{self.root}/derived/{name}"
            if not self._done(path):
                df = build()
                w = df.write.mode("overwrite")
                if partition_by:
                    # one file per (task, year) at most; rows of a year stay together in each task
                    w = df.sortWithinPartitions(partition_by).write.mode("overwrite").partitionBy(partition_by)
                with with_conf(self.spark, {SHUFFLE_CLEANUP: "true", **self._sizes()}):
                    w.parquet(path)
            self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES or name in TPCH_TABLES:
            if name in TPCH_TABLES and name not in TABLE_NAMES:
                return self.raw(name)
            return self.table(name)
        raise AttributeError(name)
