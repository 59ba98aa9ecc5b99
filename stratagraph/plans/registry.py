"""What a query is: a name, a function of (spark, folder of tables) and SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Registers a function of the tables under its own name; operators are the inventory's ids."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = Query(build.__name__, operators, build, sql)
        return build

    return register
