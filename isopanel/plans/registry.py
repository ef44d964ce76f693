"""Registered queries: a Spark plan and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .testbed import Testbed


@dataclass(frozen=True)
class Query:
    plan: Callable[[Testbed], DataFrame]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Testbed(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str) -> Callable[[Callable[[Testbed], DataFrame]], Callable[[Testbed], DataFrame]]:
    def register(plan: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(plan, sql)
        return plan

    return register
