"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Array columns as their elements joined by a comma, so that results compare as plain values."""
    for name, kind in df.dtypes:
        if kind.startswith("array<"):
            df = df.withColumn(name, F.array_join(F.transform(F.col(name).cast("array<string>"), lambda x: F.coalesce(x, F.lit(""))), ","))
    return df


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
