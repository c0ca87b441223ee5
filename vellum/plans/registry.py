"""A decorator that names a query and pairs it with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the oracle SQL that gives the same rows."""

    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            key = name or function.__name__
            if key in self._queries:
                raise ValueError(f"two queries are named {key}")
            self._queries[key] = function
            if sql is not None:
                self._sql[key] = sql
            return function

        return register

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core over which orders are dealt before documents are written from them.
TASKS = 4


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all orders, dealt out by the name their documents get, so that these meet where they are written: a document is a hundred times its order, so the table's few splits would keep most cores idle."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return keys.repartition(TASKS * spark.sparkContext.defaultParallelism, F.col("o_orderkey").cast("string"))
