"""Registered queries: a plan over the given tables and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of a folder by name, each read with the columns a plan uses (the scan prunes the rest)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _spark_frame(self, values: list, name: str) -> DataFrame:
        """A small inline dimension of one column."""
        return self.spark.createDataFrame([(v,) for v in values], [name])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # Times without a zone become instants of the session's zone, which the engine pins to UTC.
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Plan] = {}


def plan(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers the function under its name."""

    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if build.__name__ in REGISTRY:
            raise ValueError(f"two plans are named {build.__name__}")
        REGISTRY[build.__name__] = Plan(build.__name__, build, sql)
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, p=p: p.build(Tables(spark, folder))) for name, p in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: p.sql for name, p in REGISTRY.items() if p.sql is not None}
