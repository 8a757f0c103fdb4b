"""Query registry: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

import functools

from ..session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)      # Python workers import tessera from the shipped zip
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


class Loader:
    """Table loader for one data folder; ``key`` identifies it so derived
    fixtures can be defined once per application and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def loader(spark: SparkSession, sf_dir: str) -> Loader:
    return Loader(spark, sf_dir)
