"""Registered queries over the driver's tables, each beside its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder as attributes, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a plan of ``Tables`` under its name, with the SQL that DuckDB compares it with."""

    def add(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add


def r4(x: Column | str) -> Column:
    """Rounded to 4 places; the tiny addend breaks ties alike in both engines."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-9), 4)


def R4(x: str) -> str:
    """``r4`` in SQL."""
    return f"(round(({x})::DOUBLE + 1e-9, 4) + 0.0)"
