"""Recent measurements as a stream: duplicates dropped, hourly means, upserted into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.operators.relational import upsert_windowed
from gustframe.sources import tables


def read(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly(df: DataFrame, by: str, ts: str, columns: list[str], late: str = "1 day") -> DataFrame:
    """(by, ts, means) of each hour, once no more than `late` rows can come. A stamp that comes twice counts once."""
    once = df.withWatermark(ts, late).dropDuplicatesWithinWatermark([by, ts])
    means = once.groupBy(F.window(ts, "1 hour"), by).agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(by, F.col("window.start").alias(ts), *columns)


def upsert_to(stream: DataFrame, path: str, keys: list[str], checkpoint: str, once: bool = True):
    """Each micro-batch replaces the rows it has keys for. The table has numbered versions, so a batch that runs again writes the same one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        # The first batch has no version before it.
        old = spark.read.schema(batch.schema).parquet(before) if tables.exists(spark, before) else spark.createDataFrame([], batch.schema)
        upsert_windowed(old, batch, keys).write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:
            tables.remove(spark, f"{path}/v={number - 2}")  # a batch that runs again needs the one before it only

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def merge_to(stream: DataFrame, path: str, keys: list[str], ts: str, checkpoint: str, once: bool = True):
    """upsert_to() for a table by month: a micro-batch rewrites the months of its rows only. A batch that runs again ends in the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        tables.merge_months(batch.sparkSession, path, batch, keys, ts, True, f"{checkpoint}/staging-{number}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
