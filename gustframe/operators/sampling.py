"""Order, limits and samples that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_of_each(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def sort_known(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted by those of the columns that there are."""
    return df.orderBy(*[c for c in columns if c in df.columns])


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the least hash of seed and key, the same on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def complement(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    return df.join(part.select(key), key, "left_anti")
