"""Writers: partitioned results, tables with keys, parameters that are appended and stay distinct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.operators.relational import upsert


def by_station(df: DataFrame, path: str, by: str = "station_id", fmt: str = "parquet", sep: str = ",") -> None:
    """One folder a station. Rows of a station come together first, so that it gets few files, not one a task."""
    writer = df.repartition(by).write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        writer.option("header", True).option("sep", sep).csv(path)
    else:
        writer.parquet(path)


def result_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def parameters(df: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """Distinct rows of old and new, to a new path: what is read can't be overwritten meanwhile."""
    both = df if old is None else old.unionByName(df, allowMissingColumns=True)
    both.dropDuplicates().write.mode("errorifexists").option("header", True).csv(path)


def create_table(spark: SparkSession, name: str, keys: dict[str, str], columns: list[str]) -> None:
    """A Parquet table with key columns and a FLOAT for each feature."""
    spec = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), *(f"`{c}` FLOAT" for c in columns)])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({spec}) USING parquet")


def merge_into(spark: SparkSession, name: str, new: DataFrame, keys: list[str], update: bool, staging: str) -> None:
    """Insert rows under a conflict policy: the merged rows are written beside the table, then take its place."""
    old = spark.table(name)
    merged = upsert(old, new.select(*old.columns), keys, update)
    merged.write.mode("overwrite").parquet(staging)
    spark.read.schema(old.schema).parquet(staging).write.mode("overwrite").insertInto(name)


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first where it isn't there yet, or a run that wrote it was cut off (no _SUCCESS)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def single_precision(df: DataFrame, columns: list[str]) -> DataFrame:
    """What a REAL column would give back."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})
