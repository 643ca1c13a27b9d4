"""Joins that hold their promises: unique keys, no silent loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"keys {keys} are not unique")


def left_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "m:1") -> DataFrame:
    """Left join with unique keys on the right, and on the left too for 1:1."""
    require_columns(left, *keys)
    require_columns(right, *keys)
    assert_unique(right, keys)
    if validate == "1:1":
        assert_unique(left, keys)
    return left.join(right, keys, "left")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def coalesced(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Left join in which the right's value fills the left's nulls and NaNs."""
    r = right.select(*keys, F.col(column).alias("_r"))
    assert_unique(r, keys)
    base = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return left.join(r, keys, "left").withColumn(column, F.coalesce(base, F.col("_r"))).drop("_r")


def chained(df: DataFrame, *steps: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins with one small table after another, each of unique keys."""
    for right, keys in steps:
        df = left_join(df, right, keys)
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
