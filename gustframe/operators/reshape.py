"""Long and wide layouts; long is the rule, wide is for sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], columns: list[str], names: str = "name", values: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, names, values)


def widen(df: DataFrame, ids: list[str], key: str, values: list[str], keys: list, fmt: str = "{value}_t{key}") -> DataFrame:
    """One column for each value and key, e.g. power_t1; the keys are given, so no job looks for them."""
    wide = df.groupBy(*ids).pivot(key, keys).agg(*[F.first(v).alias(v) for v in values])
    names = {(f"{k}_{v}" if len(values) > 1 else f"{k}"): fmt.format(value=v, key=k) for k in keys for v in values}
    return wide.withColumnsRenamed(names)


def plane_names(df: DataFrame, ids: list[str], value: str, planes: list[tuple[float, float]], prefix: str = "10kw") -> DataFrame:
    """One column a plane: 10kw_tilt{t}_az{a}."""
    keys = [f"{prefix}_tilt{t:g}_az{a:g}" for t, a in planes]
    named = df.withColumn("__k", F.concat(F.lit(f"{prefix}_tilt"), F.format_string("%s", _short("tilt")), F.lit("_az"), _short("azimuth")))
    return named.groupBy(*ids).pivot("__k", keys).agg(F.first(value))


def _short(c: str):
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def park(df: DataFrame, turbines: str = "turbines", heights: str = "hub_heights") -> DataFrame:
    """Parallel arrays of a park as one row a turbine, numbered from 1."""
    keep = [c for c in df.columns if c not in (turbines, heights)]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(F.col(turbines).alias("turbine"), F.col(heights).alias("hub_height"))).alias("n", "t"))
    return rows.select(*keep, (F.col("n") + 1).alias("turbine_no"), "t.turbine", "t.hub_height")


def pair_differences(df: DataFrame, ids: list[str], groups: dict[str, tuple[str, str]]) -> DataFrame:
    """(ids, name, difference, absolute) for named pairs of columns: first less second."""
    one = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(a) - F.col(b)).alias("difference")) for n, (a, b) in groups.items()])
    return df.select(*ids, F.inline(one)).withColumn("absolute", F.abs("difference"))
