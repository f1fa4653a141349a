"""Missing values: shares, thresholds, sweeps and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_shares(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def complete_enough(df: DataFrame, by: str, columns: list[str], threshold: float, never_empty: bool = False) -> DataFrame:
    """Rows of series in which no column's null share is above the threshold; never_empty: and in which every column has a value.

    Shares are windows over a series: one exchange, which what follows by the same key can use."""
    w = W.partitionBy(by)
    worst = F.greatest(*[F.avg(F.col(c).isNull().cast("double")).over(w) for c in columns], F.lit(0.0))
    good = worst <= threshold
    if never_empty:
        good = good & (F.least(*[F.count(c).over(w) for c in columns], F.lit(2**62)) > 0)
    return df.withColumn("__good", good).filter("__good").drop("__good")


def never_empty(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The series in which every column has a value."""
    return df.groupBy(by).agg(F.least(*[F.count(c) for c in columns], F.lit(2**62)).alias("n")).filter("n > 0").select(by)


def survivors(df: DataFrame, by: str, columns: list[str], thresholds: list[float]) -> DataFrame:
    """(threshold, n): how many series each threshold would leave. Shares are found once, thresholds are a small array."""
    worst = null_shares(df, by, columns).select(F.greatest(*columns, F.lit(0.0)).alias("worst"))
    each = worst.select("worst", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("worst") <= F.col("threshold")).alias("n"))


def missing_ranking(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Percent missing of each column and their mean, least first."""
    shares = null_shares(df, by, columns).select(by, *[(F.col(c) * 100).alias(c) for c in columns])
    return shares.withColumn("mean", sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)).orderBy("mean", by)


def daily_nulls(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Nulls of each column a day, for days with any."""
    per = df.groupBy(F.to_date(ts).alias("day")).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return per.filter(F.greatest(*[F.col(c) for c in columns], F.lit(0)) > 0)
