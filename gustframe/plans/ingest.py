"""Raw files to clean station series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions.times import in_days
from gustframe.operators.quality import complete_enough
from gustframe.operators.relational import divide, join_all, rename_known, upsert, valid_interval


def valid_stations(registry: DataFrame, variables: list[str], begin: Column, end: Column) -> DataFrame:
    """Stations that measured exactly these variables from begin to end."""
    active = valid_interval(registry, "valid_from", "valid_to", begin, end)
    return divide(active.filter(F.col("variable").isin(*variables)), "station_id", "variable", variables)


def frames(variables: list[DataFrame], names: dict[str, str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows that every variable has, with this library's names, between two days; distinct."""
    joined = join_all(variables, ["station_id", "timestamp"])
    return rename_known(joined, names).filter(in_days("timestamp", first, last)).dropDuplicates(["station_id", "timestamp"])


def master_data(registry: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The latest place of each station; new rows replace old ones."""
    latest = registry.groupBy("station_id").agg(F.max_by(F.struct(F.col("height").alias("station_height"), "latitude", "longitude"), F.struct(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), "valid_from", "height", "latitude", "longitude")).alias("p")).select("station_id", "p.*")
    return latest if old is None else upsert(old, latest, ["station_id"], update=True)


def clean(stations: DataFrame, columns: list[str], threshold: float, first: str | None = None) -> DataFrame:
    """One scan instead of a query a station: the wanted columns of series that are complete enough."""
    own = stations.select("timestamp", "station_id", *columns).filter(in_days("timestamp", first))
    return complete_enough(own, "station_id", columns, threshold)
