"""Where catalogue modules register their queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """The tables of one folder. `stations` is the event stream as a station feed: users are stations, values are measurements."""

    spark: SparkSession
    path: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def stations(self, holes: int = 0) -> DataFrame:
        """(event_id, station_id, timestamp, v, event_type). holes: every so-manieth event has no value."""
        v = F.col("value") if not holes else F.when(F.col("event_id") % holes != 0, F.col("value"))
        return self("events").select("event_id", F.col("user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("timestamp"), v.alias("v"), "event_type")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The station feed in SQL; {v} is the value.
FEED = "select event_id, user_id as station_id, ts, value as v, event_type from events"
HOLES = "select event_id, user_id as station_id, ts, case when event_id % 7 <> 0 then value end as v, event_type from events"


def query(sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


def r6(c: Column | str, digits: int = 6) -> Column:
    """Sums differ in their last digits with the order of rows; six decimals don't."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Scaled, rounded to a whole number and scaled back, as DuckDB rounds a double. Spark's round, in r6(), takes the shortest decimal that a double
    prints as, so the two differ where that ends in a 5 behind the digits."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(10.0**digits)) / F.lit(10.0**digits)


def epoch(c: Column | str) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
