"""Operators over ordered series: ageing, recurrences, filling, curve post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.functions.draws import normal
from gustframe.functions.nulls import col, div
from gustframe.functions.times import age_years, commissioned, micros
from gustframe.operators.asof import CHUNK_SECONDS
from gustframe.operators.scan import affine_scan


def ageing(df: DataFrame, by: str, ts: str, since: Column | str, rate: float = 0.0063, name: str = "degradation") -> DataFrame:
    """The share of power that is left, equally spaced by row from (1-rate)^age at a series' first stamp to that at its last.

    Ages are whole days / 365.25. Ages before this filter: later slices don't change it.
    """
    w = W.partitionBy(by)
    base = F.lit(1 - rate)
    first, last = F.min(ts).over(w), F.max(ts).over(w)
    a, b = F.pow(base, age_years(first, since)), F.pow(base, age_years(last, since))
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count(F.lit(1)).over(w)
    return df.withColumns({"__a": a, "__b": b, "__i": i, "__n": n}).withColumn(name, F.col("__a") + (F.col("__b") - F.col("__a")) * F.coalesce(F.try_divide(F.col("__i"), F.col("__n") - 1), F.lit(0.0))).drop("__a", "__b", "__i", "__n")


def drawn_age(by: str, seed: int = 42, mean: float = 15.0, deviation: float = 5.0, least: float = 0.0) -> Column:
    """Years that a plant without a known date has stood, from N(mean, deviation), not below `least`: drawn by a hash of seed and
    key, so each series has its age on any cluster and in any order."""
    return F.greatest(F.lit(mean) + deviation * normal(seed, by), F.lit(float(least)))


def real_age(df: DataFrame, ages: DataFrame, by: str, seed: int = 42, name: str = "age") -> DataFrame:
    """df with `name`, an age picked for each series from ages (idx from 0 without gaps, age), by a hash of seed and key."""
    n = ages.agg(F.count(F.lit(1)).alias("__n"))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col(by)), F.greatest("__n", F.lit(1)))
    series = df.select(by).distinct().crossJoin(F.broadcast(n)).select(by, pick.alias("idx"))  # one row
    return df.join(series.join(ages.select("idx", F.col("age").alias(name)), "idx", "left").drop("idx"), by, "left")


def ageing_from(df: DataFrame, by: str, ts: str, years: Column | str, rate: float = 0.0063, name: str = "degradation") -> DataFrame:
    """ageing() where the age at the first stamp is known in years instead of a date: the commissioning date is that long before it, as
    a whole day, for the age at the last stamp. `commissioned` is that date."""
    w = W.partitionBy(by)
    first, last = F.min(ts).over(w), F.max(ts).over(w)
    date = commissioned(first, years)
    end = age_years(last, date.cast("timestamp"))
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count(F.lit(1)).over(w)
    base = F.lit(1 - rate)
    own = df.withColumns({"__a": F.pow(base, col(years)), "__b": F.pow(base, end), "__i": i, "__n": n, "commissioned": date})
    return own.withColumn(name, F.col("__a") + (F.col("__b") - F.col("__a")) * F.coalesce(F.try_divide(F.col("__i"), F.col("__n") - 1), F.lit(0.0))).drop("__a", "__b", "__i", "__n")


def _washed(rain: str, minutes: str, settled: list[Column], threshold: float, cleaning: float, step_minutes: float) -> tuple[Column, list[Column]]:
    """The step from one row's dust to the next as a * dust + b: a, and b for each plane."""
    rained = F.coalesce(F.col(rain) >= threshold, F.lit(False))
    a = F.when(rained, 1 - cleaning * F.coalesce(F.col(minutes), F.lit(0.0)) / step_minutes).otherwise(1.0).cast("double")
    return a, [F.when(rained, 0.0).otherwise(F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0))).cast("double") for s in settled]


def _wash(df: DataFrame, ts: str, rain: str, minutes: str, settled: Column | str, threshold: float, cleaning: float, step_minutes: float) -> DataFrame:
    """df with __a and __b, the step from one row's dust to the next as a * dust + b, and __chunk."""
    a, (b,) = _washed(rain, minutes, [col(settled)], threshold, cleaning, step_minutes)
    return df.withColumns({"__a": a, "__b": b, "__chunk": F.floor(micros(ts) / F.lit(CHUNK_SECONDS * 1_000_000)).cast("long")})


def _chunks(steps: DataFrame, by: list[str], ts: str, start: float) -> DataFrame:
    """(by, __chunk, a, b, first): the steps of each chunk as one, and the dust at its end if the series begins with it.

    Steps are affine, so those of a chunk are one such step; a series of any length is spread over the tasks by its chunks."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts), F.col("__a").alias("a"), F.col("__b").alias("b"))))
    held = steps.groupBy(*by, "__chunk").agg(rows.alias("x"))
    both = F.aggregate("x", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda m, x: F.struct((x["a"] * m["a"]).alias("a"), (x["a"] * m["b"] + x["b"]).alias("b")))
    # The first row of a series has the start value, whatever falls or settles there.
    first = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.lit(float(start)), lambda w, x: x["a"] * w + x["b"])
    return held.select(*by, "__chunk", both.alias("m"), first.alias("first")).select(*by, "__chunk", "m.a", "m.b", "first")


def final_dust(df: DataFrame, by: str, ts: str, rain: str, minutes: str, settled: Column | str, start: float, threshold: float, cleaning: float, step_minutes: float) -> DataFrame:
    """(by, dust): dust left at the end of each series: rain of at least threshold washes some off, otherwise it settles. The first
    row of a series has `start`. A task folds one chunk of a series, then one series' chunks (52 a year)."""
    chunks = _chunks(_wash(df, ts, rain, minutes, settled, threshold, cleaning, step_minutes), [by], ts, start)
    line = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__chunk", "a", "b", "first"))).alias("x"))
    rest = F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0)))
    return line.select(by, F.aggregate(rest, F.col("x")[0]["first"], lambda w, x: x["a"] * w + x["b"]).alias("dust"))


def dust(df: DataFrame, by: list[str], ts: str, rain: str, minutes: str, settled: str, start: Column | float, threshold: float, cleaning: float, step_minutes: float) -> DataFrame:
    """df with `dust` at every row, as in final_dust(). A series is one station and tilt. start: a number, or a column of `by`, such
    as drawn_dust()."""
    return dusts(df, by, ts, rain, minutes, {"dust": (F.col(settled), start)}, threshold, cleaning, step_minutes)


def dusts(df: DataFrame, by: list[str], ts: str, rain: str, minutes: str, planes: dict[str, tuple[Column, Column | float]], threshold: float, cleaning: float, step_minutes: float) -> DataFrame:
    """dust() of several planes under one rain, in one scan: df with a column for each name of planes, from (settled, start)."""
    a, bs = _washed(rain, minutes, [settled for settled, _ in planes.values()], threshold, cleaning, step_minutes)
    inputs = {"a": a} | {f"b{i}": b for i, b in enumerate(bs)}
    return affine_scan(df, by, ts, inputs, lambda _, row: tuple(row[i] for i in inputs), {name: start for name, (_, start) in planes.items()}, chunk=CHUNK_SECONDS)


def drawn_dust(*by: Column | str, seed: int = 42, mean: float = 4.0, deviation: float = 1.0, least: float = 0.0) -> Column:
    """The dust that a series begins with, from N(mean, deviation), not below `least`: drawn by a hash of seed and keys."""
    return F.greatest(F.lit(mean) + deviation * normal(seed, *by), F.lit(float(least)))


def inertia(df: DataFrame, by: str, ts: str, power: str, speed: str, step_seconds: float, tau: float, alpha: float, cut_in: float, least_tau: float, name: str = "smoothed") -> DataFrame:
    """Falling power decays: a drop keeps the former value times exp(-dt / tau_eff), tau_eff = max(least_tau, tau (1 + alpha (cut_in - v))).

    A rise begins anew with its power. Nothing precedes the first rise, so drops before it give 0, and the first row shows its power."""
    eff = F.greatest(F.lit(float(least_tau)), tau * (1 + alpha * (cut_in - F.col(speed))))
    decay = F.coalesce(F.exp(F.try_divide(F.lit(-float(step_seconds)), eff)), F.lit(1.0))

    def step(before: Column, row: Column) -> tuple[Column, Column]:
        fell = F.coalesce(row["p"] < before["p"], F.lit(False))
        return F.when(fell, row["decay"]).otherwise(0.0), F.when(fell, 0.0).otherwise(row["p"])

    return affine_scan(df, [by], ts, {"p": F.col(power).cast("double"), "decay": decay}, step, {name: 0.0}, shown_first="p")


def forward_fill(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def reindex(df: DataFrame, by: str, index: str, last: Column | str, fill: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows for every index from 0 to `last`, an aggregate over each series; values missing there are `fill`."""
    columns = columns or [c for c in df.columns if c not in (by, index)]
    n = F.max(last) if isinstance(last, str) else last
    every = df.groupBy(by).agg(n.alias("__n")).select(by, F.explode(F.sequence(F.lit(0), F.col("__n").cast("int"))).alias(index))
    out = every.join(df.select(by, index, *columns), [by, index], "left")
    return out if fill is None else out.withColumns({c: F.coalesce(c, F.lit(float(fill))) for c in columns})


def duplicate_names(df: DataFrame, name: str, order: str, out: str = "unique") -> DataFrame:
    """The second row with a name gets _2, the third _3."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))


def nonzero_bounds(df: DataFrame, by: str, index: str, value: str) -> DataFrame:
    hit = F.when(F.col(value) > 0, F.col(index))
    return df.groupBy(by).agg(F.min(hit).alias("first"), F.max(hit).alias("last"))


def fell(power: str, by: str, ts: str) -> Column:
    """Less than in the row before; false in a series' first row."""
    return F.coalesce(F.col(power) < F.lag(power).over(W.partitionBy(by).orderBy(ts)), F.lit(False))


def sampling_step(ts: str, by: str) -> Column:
    """Seconds between a series' first two rows, on every row."""
    w = W.partitionBy(by).orderBy(ts).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (micros(F.nth_value(ts, 2).over(w)) - micros(F.first(ts).over(w))) / 1e6


def post_process_curves(curves: DataFrame, specs: DataFrame, turbine: str = "turbine", index: str = "ws_c", power: str = "power_w", cut_out: str = "cut_out", default_cut_out: float = 25.0) -> DataFrame:
    """Catalogue curves on one grid of hundredths of m/s: filled forward to cut-out, 0 above it and below the first power. (turbine, ws_c, power_w, cut_in)."""
    out_c = F.rint(F.coalesce(F.col(cut_out), F.lit(default_cut_out)) * 100).cast("int")
    bounds = curves.groupBy(turbine).agg(F.min(F.when(F.col(power) > 0, F.col(index))).alias("__first"), F.max(index).alias("__top"))
    known = bounds.join(specs.select(turbine, out_c.alias("__out")), turbine, "left").withColumn("__out", F.coalesce("__out", F.lit(int(default_cut_out * 100))))
    longest = known.agg(F.max("__out").alias("__n"))
    every = known.crossJoin(F.broadcast(longest)).select(turbine, "__first", "__out", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias(index))
    joined = forward_fill(every.join(curves.select(turbine, index, power), [turbine, index], "left"), turbine, index, [power])
    value = F.when((F.col(index) > F.col("__out")) | F.col("__first").isNull() | (F.col(index) < F.col("__first")), 0.0).otherwise(F.col(power))
    return joined.select(turbine, index, value.alias(power), (F.col("__first") / 100).alias("cut_in"))


def load_factor_corrected(df: DataFrame, by: str, aged: str, new: str, name: str = "wclf") -> DataFrame:
    """Load factor corrected for weather, in percent: aged * mean(new) / new; null where new is 0."""
    return df.withColumn(name, div(F.col(aged) * F.avg(new).over(W.partitionBy(by)), F.col(new)) * 100)


#: Parts that distinct keys are ranked in.
RANK_PARTS = 64


def running_seed(df: DataFrame, key: str, seed: int, name: str = "seed") -> DataFrame:
    """A seed for each key, counting up in sorted order. Distinct keys are ranked in parts between sampled keys; what comes before a
    part is a sum over as many rows as there are parts."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    drawn = [r[0] for r in keys.orderBy(F.xxhash64(F.lit(seed), key), key).limit(RANK_PARTS * 16).orderBy(key).collect()]
    cuts = sorted(set(drawn[16::16]))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    parted = keys.withColumn("__part", part)
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(W.partitionBy("__part").orderBy(key))
    numbered = parted.join(F.broadcast(before), "__part").select(key, (rank + F.col("__before") + (seed - 1)).alias(name))  # RANK_PARTS rows
    return df.join(numbered, key)
