"""All queries outside llm, by name, and the SQL that DuckDB runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables as a query, with the SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def scalars(name: str, table: str, key: str, **columns) -> None:
    """Register one query of expressions: column=(function that makes the Column, SQL)."""

    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(key, *(make().alias(c) for c, (make, _) in columns.items()))

    query(f"SELECT {key}, {', '.join(f'{sql} AS {c}' for c, (_, sql) in columns.items())} FROM {table}", name)(run)


def same_sql(name: str, sql: str, tables: str) -> None:
    """Register a statement that Spark SQL and DuckDB read alike."""

    def run(t: Tables) -> DataFrame:
        for x in tables.split():
            getattr(t, x).createOrReplaceTempView(x)
        return t.spark.sql(sql)

    query(sql, name)(run)


def money(c: str):
    """Exact sums of two-digit amounts, as a double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


from . import engine_queries, json_queries, kind_queries, relational, scalar, semantics, time_queries, value_queries  # noqa: E402, F401
