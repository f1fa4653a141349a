"""Synthetic against measured series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.operators.stats import mae, r2
from gustframe.operators.timegrid import resample


def aligned(synthetic: DataFrame, measured: DataFrame, by: str, ts: str, seconds: int = 1800) -> DataFrame:
    """(by, ts, synthetic, real) on a common grid; an hour or half-hour that only one side has keeps its value."""
    both = synthetic.select(by, ts, "synthetic").join(measured.select(by, ts, "real"), [by, ts], "full_outer")
    return resample(both, by, ts, {"synthetic": "mean", "real": "mean"}, seconds)


def scores(df: DataFrame, by: str, capacity: DataFrame) -> DataFrame:
    """R2, MAE over capacity, bias and energies of rows that have both values."""
    both = df.na.drop(subset=["synthetic", "real"]).join(capacity, by)
    return both.groupBy(by).agg(
        r2("real", "synthetic").alias("r2"),
        mae("real", "synthetic", F.first("capacity")).alias("mae"),
        F.avg(F.col("synthetic") - F.col("real")).alias("bias"),
        F.sum("synthetic").alias("energy_synthetic"),
        F.sum("real").alias("energy_real"),
        F.count(F.lit(1)).alias("n"),
    )


def ageing_effect(aged: DataFrame, new: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, age_year, reduction in percent): yearly energy of an aged series against the new one."""
    both = aged.select(by, ts, "age_years", F.col("power").alias("a")).join(new.select(by, ts, F.col("power").alias("n")), [by, ts])
    sums = both.groupBy(by, F.floor("age_years").cast("int").alias("age_year")).agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    return sums.select(by, "age_year", F.try_divide((F.col("a") - F.col("n")) * 100, F.col("n")).alias("reduction"))
