"""The list of registered queries: a Spark query over the given tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import tune

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, tables)`` under ``name``, with the SQL that must give the same rows."""

    def register(fn: Callable[[SparkSession, Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def sql_query(name: str, spark_sql: str, tables: str, oracle: str | None = None) -> None:
    """A query given as text: it passes the read-only policy and runs over the named tables."""
    from tablemill.operators.query import restricted_sql

    @query(name, oracle or spark_sql)
    def run(spark: SparkSession, t: Tables) -> DataFrame:
        return restricted_sql({n: getattr(t, n) for n in tables.split()}, spark_sql)
