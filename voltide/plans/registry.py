"""Registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        key = name or f.__name__.rstrip("_")
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def spark_sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    """A Spark SQL text over the named tables."""
    return spark.sql(text, **{n: spark.read.parquet(f"{d}/{n}.parquet") for n in tables})


from voltide.plans import contracts, curated, extended, functions_, headline, operators_, relational, visibility_  # noqa: E402,F401
