"""Typed sources (S1-S4): every auction table has declared columns, and prices are exact decimals.

A reader gives the declared columns in their order, whatever else the source holds. A missing column is an error, as is
a value that its type cannot hold; prices with more than two places round half up. Sums over ``DECIMAL(12,2)`` don't depend on the order
of the rows, so on the partitioning, however many lots there are.

Database tables are read in ranges of one column, one task each (``ranges``): the ranges hold every row once, rows
without a value in the first one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PRICE = "decimal(12,2)"

SCHEMAS = {
    "lot_rows": f"lot_id bigint, sale_id bigint, book_number int, day_number int, lot_number int, sex string, vendor_id bigint, "
                f"horse_id bigint, price {PRICE}, is_passed_in int, is_withdrawn int, lot_type_id bigint",
    "horses": "horse_id bigint, horse_name string, sire_id bigint, dam_id bigint",
    "sires": "horse_id bigint, horse_name string",
    "sales": "sale_id bigint, sale_code string, sale_name string, start_date date, end_date date, company_id bigint, "
             "sale_type_id bigint, country_id bigint, status_id bigint, is_online boolean, is_public boolean",
    "companies": "company_id bigint, company_name string, website string",
    "countries": "country_id bigint, country_code string, country_name string, currency_id bigint",
    "currencies": "currency_id bigint, currency_code string, currency_symbol string",
    "sale_statuses": "status_id bigint, status string",
    "sale_types": "sale_type_id bigint, sale_type_name string",
    "lot_types": "lot_type_id bigint, lot_type_name string",
    "session_overrides": f"sale_id bigint, session_median_override {PRICE}",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def typed(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of a table, cast; column names match without case."""
    have = {c.lower(): c for c in df.columns}
    fields = schema(table).fields
    missing = [f.name for f in fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name) for f in fields])


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    return typed(spark.read.parquet(path), table)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV file with a header. Columns are found by name; a value that isn't of its type is an error."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return typed(raw, table)


def _literal(v: int | dt.date) -> str:
    return f"'{v.isoformat()}'" if isinstance(v, dt.date) else str(v)


def ranges(column: str, low: int | dt.date, high: int | dt.date, parts: int) -> list[str]:
    """SQL predicates that deal all rows to at most ``parts`` reads by a whole number or date: equal steps from low to high,
    the first read open below and with the nulls, the last one open above."""
    width = high - low
    width = width.days if isinstance(width, dt.timedelta) else width
    if parts < 1 or width < 0:
        raise ValueError("ranges need one part or more, and low up to high")
    steps = sorted({width * k // parts for k in range(1, parts)} - {0})
    cuts = [_literal(low + (dt.timedelta(days=s) if isinstance(low, dt.date) else s)) for s in steps]
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *middle, f"{column} >= {cuts[-1]}"]


def jdbc_options(table: str) -> dict[str, str]:
    """Connection properties that every read of the table has: its declared types, rows fetched at a time."""
    return {"customSchema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(table).fields), "fetchsize": "10000"}


def jdbc_table(table: str, source: str | None = None) -> str:
    """The declared columns of a database table as a subquery, so that nothing else is sent."""
    return f"(SELECT {', '.join(schema(table).names)} FROM {source or table}) {table}_read"


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, source: str | None = None,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A database table in ``parts`` reads by ranges of column. The driver class and the login are in properties."""
    return typed(spark.read.jdbc(url, jdbc_table(table, source), predicates=ranges(column, low, high, parts),
                                 properties=jdbc_options(table) | (properties or {})), table)
