"""Tables of station series: by month, so that a merge rewrites the months it meets, and bucketed by station, so that work on one
station, or by station, moves no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.operators.relational import upsert

MONTH = "month"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_month(df: DataFrame, ts: str) -> DataFrame:
    """df with `month`, yyyy-MM; rows without a stamp have none."""
    return df.withColumn(MONTH, F.date_format(ts, "yyyy-MM"))


def write_months(df: DataFrame, path: str, ts: str) -> None:
    """A folder a month. Rows of a month come together first, in as many files as Spark finds fit."""
    with_month(df, ts).repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def merge_months(spark: SparkSession, path: str, new: DataFrame, keys: list[str], ts: str, update: bool, staging: str) -> list[str]:
    """Merge rows into a table by month under a conflict policy, and return the months that were rewritten; ts is one of keys.

    Only months of new rows are read, and only they are replaced: files of other months stay as they are. The merged rows are written to
    `staging` first. A merge that is cut off can be run again: with update, it ends in the same rows. The list of months is as long as
    the history has months.
    """
    if ts not in keys:
        raise ValueError("a key without its stamp may be in two months")
    held = with_month(new, ts)
    months = sorted((r[0] for r in held.select(MONTH).distinct().collect()), key=str)
    if not months:
        return []
    if exists(spark, path):
        # The month's type is told, since a folder's name alone may look like a date.
        old = spark.read.schema(held.schema).parquet(path)
        met = F.col(MONTH).isin([m for m in months if m is not None])
        old = old.filter(met | F.col(MONTH).isNull() if None in months else met)
    else:
        old = spark.createDataFrame([], held.schema)
    upsert(old, held.select(*old.columns), [*keys, MONTH], update).write.mode("overwrite").parquet(staging)
    merged = spark.read.schema(old.schema).parquet(staging)
    merged.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    remove(spark, staging)
    return months


def bucketed(df: DataFrame, name: str, by: str, ts: str, buckets: int) -> None:
    """A table in buckets of a station's hash, sorted by station and stamp. One station is read from one bucket; joins, windows and
    aggregates by station on tables of as many buckets need no exchange. Rows of a bucket come together first: one file a bucket."""
    df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, ts).saveAsTable(name)
