"""Constraints of the model as DataFrames of violations: parquet enforces none itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def report(violations: dict[str, DataFrame]) -> DataFrame:
    """rule, n_violations."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations") for rule, df in violations.items()]
    return reduce(DataFrame.unionAll, counted)
