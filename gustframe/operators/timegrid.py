"""Regular grids: resampling with an origin, with every bin emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.functions.times import micros
from gustframe.operators.relational import sent_if_small

RULES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "first": F.first, "last": F.last}


def resample(df: DataFrame, by: str, ts: str, rules: dict[str, str], seconds: int = 3600, origin: str = "start", fill: bool | str = True, partial: bool = False) -> DataFrame:
    """Bins of `seconds`, closed and labelled left, per series `by`: (by, ts, one column a rule).

    origin "start": bins count from the series' first stamp; "midnight": from a whole multiple of the bin since 1970, which is
    midnight for bins that divide a day. Bins without rows are emitted (fill): sums are 0 there, everything else null. fill "first": of
    a run of empty bins only the first is emitted, which is all that an as-of join has to meet.

    One exchange, on `by`: the window, the aggregate (by is a prefix of its keys) and the spine share its partitioning. With
    partial, a series' start is an aggregate of its own that the rows meet before anything is dealt out, so that bins are summed where
    the rows are and only bins travel, whatever share of the rows one series has; df is read twice (its keys and stamps alone
    the first time), which pays where it is a table and not the end of a long plan.
    """
    step = seconds * 1_000_000
    at = micros(ts)
    rows = df.filter(F.col(ts).isNotNull())
    if partial:
        starts = rows.groupBy(F.col(by).alias("__by")).agg(F.min(at).alias("__start"))
        begun = rows.join(sent_if_small(starts), F.col(by).eqNullSafe(F.col("__by")))
        start = F.col("__start")
    else:
        begun, start = rows, F.min(at).over(W.partitionBy(by))
    if origin != "start":
        start = F.floor(start / F.lit(step)) * step
    binned = begun.select(by, *rules, at.alias("__at"), start.cast("long").alias("__start"))
    binned = binned.withColumn("__bin", F.floor((F.col("__at") - F.col("__start")) / F.lit(step)).cast("long"))
    aggs = [RULES[r](c).alias(c) for c, r in rules.items()]
    found = binned.groupBy(by, "__start", "__bin").agg(*aggs)
    if fill:
        # Each bin emits itself and the empty ones before the next, so no second read and no join is needed.
        w = W.partitionBy(by).orderBy("__bin")
        gap = F.coalesce(F.lead("__bin").over(w), F.col("__bin") + 1)
        last = F.col("__next") - 1
        last = F.least(last, F.col("__bin") + 1) if fill == "first" else last
        found = found.withColumn("__next", gap).withColumn("__fill", F.explode(F.sequence(F.col("__bin"), last)))
        own = F.col("__fill") == F.col("__bin")
        empty = {c: F.lit(0.0) if r == "sum" else F.lit(None) for c, r in rules.items()}
        found = found.select(by, "__start", F.col("__fill").alias("__bin"), *[F.when(own, F.coalesce(F.col(c), F.lit(0.0)) if r == "sum" else F.col(c)).otherwise(empty[c]).alias(c) for c, r in rules.items()])
    return found.select(by, F.timestamp_micros(F.col("__start") + F.col("__bin") * step).alias(ts), *rules)


def spine(df: DataFrame, by: str, n: Column | str, index: str = "i") -> DataFrame:
    """by and every whole number from 0 to n of its row."""
    return df.select(by, F.explode(F.sequence(F.lit(0), F.col(n) if isinstance(n, str) else n)).alias(index))
