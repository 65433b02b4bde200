"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(value, places: int = 6) -> Column:
    """A result column rounded for display; operators themselves never round."""
    return F.round(value, places)
