"""Scores, distributions and fits, each as one or two aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.functions.nulls import col, div


def r2(actual: Column | str, predicted: Column | str) -> Column:
    """1 - residual over total squares; below 0 for models worse than the mean. An aggregate."""
    y, p = col(actual), col(predicted)
    total = F.sum(y * y) - F.count(y) * F.pow(F.avg(y), F.lit(2.0))
    return 1 - div(F.sum((y - p) * (y - p)), total)


def mae(actual: Column | str, predicted: Column | str, capacity: Column | float = 1.0) -> Column:
    c = capacity if isinstance(capacity, Column) else F.lit(float(capacity))
    return div(F.avg(F.abs(col(actual) - col(predicted))), c)


def polyfit(df: DataFrame, x: str, y: str, degree: int = 3) -> list[float]:
    """Coefficients of the least-squares polynomial, highest power first. One aggregate of moments; the small system is solved here."""
    a, b = F.col(x), F.col(y)
    row = df.agg(F.avg(a).alias("m"), F.stddev_pop(a).alias("s")).first()
    m, s = row["m"], row["s"] or 1.0
    z = (a - m) / s  # centred, so that high moments keep their digits
    moments = [F.sum(F.pow(z, F.lit(float(k)))).alias(f"x{k}") for k in range(2 * degree + 1)]
    cross = [F.sum(F.pow(z, F.lit(float(k))) * b).alias(f"y{k}") for k in range(degree + 1)]
    got = df.filter(a.isNotNull() & b.isNotNull()).agg(*moments, *cross).first()
    system = np.array([[got[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    scaled = np.linalg.solve(system, np.array([got[f"y{i}"] for i in range(degree + 1)]))
    return list((np.poly1d(scaled[::-1])(np.poly1d([1 / s, -m / s]))).coeffs)


def moments(df: DataFrame, x: str, y: str, degree: int = 3) -> DataFrame:
    """Sums of x^k and x^k y that a fit needs, one row each."""
    a, b = F.col(x), F.col(y)
    names = [f"sx{k}" for k in range(2 * degree + 1)] + [f"sxy{k}" for k in range(degree + 1)]
    values = [F.sum(F.pow(a, F.lit(float(k)))) for k in range(2 * degree + 1)] + [F.sum(F.pow(a, F.lit(float(k))) * b) for k in range(degree + 1)]
    return df.agg(*[v.alias(n) for v, n in zip(values, names, strict=True)])


#: Values of a group that are ranked as they are; brackets narrow larger ones down, by so much on either side of a quantile.
RANKED, MARGIN, ACCURACY = 100_000, 0.005, 2_000


def quantiles(df: DataFrame, by: list[str], column: str, at: list[float], ranked: int = RANKED) -> DataFrame:
    """(by, n, q: array) of exact quantiles with linear interpolation, in memory that doesn't grow with the groups.

    Sketches bracket each quantile, wide enough for their error; values below a bracket are counted, those inside are ranked. Where
    more than `ranked` values are inside, they are bracketed again: each round leaves about a hundredth. Null keys are a group; a group
    without a number has n 0 and no q. Null and NaN aren't numbers."""
    x, names, by = F.col(column).cast("double"), by, [f"__g{j}" for j in range(len(by))]
    given = df.select(*[F.col(c).alias(g) for c, g in zip(names, by, strict=True)], F.when(~F.isnan(x), x).alias("x"))
    every = given.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows, whole = given.filter("x is not null"), every.filter("n > 0")
    none = every.filter("n = 0").select(*by, "n", F.lit(None).cast("array<double>").alias("q"))
    ranks = [F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("rank")) for i, q in enumerate(at)]
    brackets = whole.select(*by, "n", "lo", "hi", F.inline(F.array(*ranks))).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n"))

    def meet(b: DataFrame) -> DataFrame:
        """The rows of each group with those of b; null meets null."""
        if not by:
            return rows.crossJoin(F.broadcast(b))  # a row for each quantile
        other = b.withColumnsRenamed({g: f"{g}_" for g in by})
        same = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in by]
        return rows.join(other, same).drop(*[f"{g}_" for g in by])

    def within(b: DataFrame) -> DataFrame:
        """The values inside each bracket: (by, i, x and the bracket)."""
        return meet(b).filter(F.col("x").between(F.col("lo"), F.col("hi")))

    keys = [*by, "i"]
    while (brackets.agg(F.max("inside")).first()[0] or 0) > ranked:
        place = (F.first("rank") - F.first("below")) / F.first("inside")
        cuts = F.percentile_approx("x", [k / 1000 for k in range(1001)], ACCURACY * 5)
        inner = within(brackets).groupBy(*keys).agg(cuts.alias("c"), place.alias("p"), *[F.first(c).alias(c) for c in ("n", "rank", "below", "inside", "lo", "hi")])
        room = MARGIN + 2 / F.col("inside")
        left = F.greatest(F.floor((F.col("p") - room) * 1000), F.lit(0)).cast("int")
        right = F.least(F.ceil((F.col("p") + room) * 1000), F.lit(1000)).cast("int")
        # The sketch's ends are no values' ends, so the bracket's own stay there.
        narrow = inner.select(*by, "i", "n", "rank", "below", F.col("inside").alias("was"), F.when(left > 0, F.col("c")[left]).otherwise(F.col("lo")).alias("lo"), F.when(right < 1000, F.col("c")[right]).otherwise(F.col("hi")).alias("hi"))
        met = meet(narrow)
        again = met.groupBy(*keys).agg(F.count_if(F.col("x") < F.col("lo")).alias("below"), F.count_if(F.col("x").between(F.col("lo"), F.col("hi"))).alias("inside"), *[F.first(c).alias(c) for c in ("n", "rank", "lo", "hi", "was")])
        if not again.filter("inside < was").limit(1).count():
            break  # one value over and over: nothing to narrow
        brackets = again.drop("was")
    # Equal values count once, with the places they take.
    seen = within(brackets).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("k"), F.first("rank").alias("rank"), F.first("below").alias("below"), F.first("n").alias("n"))
    end = F.first("below").over(W.partitionBy(*keys)) + F.sum("k").over(W.partitionBy(*keys).orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    placed = seen.withColumn("end", end)

    def at_place(r: Column) -> Column:
        return F.min(F.when(F.col("end") > r, F.col("x")))

    floor, ceil = F.floor("rank"), F.ceil("rank")
    found = placed.groupBy(*keys).agg(at_place(floor).alias("a"), at_place(ceil).alias("b"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    out = found.groupBy(*by).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("q"))
    return (out.unionByName(none) if by else out).withColumnsRenamed(dict(zip(by, names, strict=True)))


def trim(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows strictly between two quantiles (linear interpolation)."""
    q = quantiles(df, [], column, [low, high]).select(F.col("q").alias("__q"))  # one row
    return df.crossJoin(F.broadcast(q)).filter((F.col(column) > F.col("__q")[0]) & (F.col(column) < F.col("__q")[1])).drop("__q")


def histogram(df: DataFrame, column: str, bins: int = 50, norm: str = "count", low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, left, value) for every bin from 0; the last bin holds the maximum. norm: count, density, probability or percent."""
    x = F.col(column)
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.count(x).alias("__n"))
    lo = F.lit(float(low)) if low is not None else F.col("__lo")
    hi = F.lit(float(high)) if high is not None else F.col("__hi")
    width = (F.col("__b") - F.col("__a")) / F.lit(float(bins))
    given = df.select(x.alias("__x")).crossJoin(F.broadcast(ends.withColumns({"__a": lo, "__b": hi})))
    inside = given.filter((F.col("__x") >= F.col("__a")) & (F.col("__x") <= F.col("__b")))
    place = F.least(F.floor(div(F.col("__x") - F.col("__a"), width)).cast("int"), F.lit(bins - 1))
    counts = inside.groupBy(F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = ends.withColumns({"__a": lo, "__b": hi}).select("__a", "__b", "__n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    c = F.coalesce("c", F.lit(0)).cast("double")
    total = F.sum(c).over(_all())
    value = {"count": c, "density": div(c, total * width), "probability": div(c, total), "percent": div(c * 100, total)}[norm]
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("__a") + F.col("bin") * width).alias("left"), value.alias("value"))


def histogram_by_width(df: DataFrame, column: str, width: float, norm: str = "count") -> DataFrame:
    """(bin, left, value): bins of one width that begin at its multiples, from the first to the last that has a value, those between
    without one too. Counted before anything is dealt out. norm as in histogram()."""
    x = F.col(column).cast("double")
    counts = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(F.floor(x / F.lit(float(width))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.sum("c").cast("double").alias("n"))  # one row
    every = ends.filter("a is not null").select("n", F.explode(F.sequence("a", "b")).alias("bin"))
    c = F.coalesce("c", F.lit(0)).cast("double")
    value = {"count": c, "density": div(c, F.col("n") * float(width)), "probability": div(c, F.col("n")), "percent": div(c * 100, F.col("n"))}[norm]
    return every.join(counts, "bin", "left").select("bin", (F.col("bin") * F.lit(float(width))).alias("left"), value.alias("value"))


def _all():
    from pyspark.sql import Window as W

    return W.partitionBy()  # over the bins of one histogram


def kl_divergence(df: DataFrame, p: str, q: str, bins: int = 50, epsilon: float = 1e-10) -> DataFrame:
    """One row: sum of p ln(p / q) over densities on the common range. Both histograms come from one pass over the rows."""
    long = df.select(F.explode(F.array(F.struct(F.lit("p").alias("k"), F.col(p).alias("x")), F.struct(F.lit("q").alias("k"), F.col(q).alias("x")))).alias("s")).select("s.k", "s.x").filter("x is not null")
    ends = long.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / F.lit(float(bins))
    place = F.least(F.floor(div(F.col("x") - F.col("a"), width)).cast("int"), F.lit(bins - 1))
    counts = long.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).alias("bin"), width.alias("w")).agg(F.count_if(F.col("k") == "p").alias("np"), F.count_if(F.col("k") == "q").alias("nq"))
    total = counts.agg(F.sum("np").alias("tp"), F.sum("nq").alias("tq"))
    # Bins without either have equal densities of epsilon and add nothing.
    dp, dq = (div(F.col(n), F.col(t) * F.col("w")) + epsilon for n, t in (("np", "tp"), ("nq", "tq")))
    return counts.crossJoin(F.broadcast(total)).agg(F.sum(dp * F.ln(dp / dq)).alias("kl"))


def box_stats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = quantiles(df, by, column, [0.25, 0.5, 0.75])
    q = q.select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.select(*by, column).join(q, by).groupBy(*by, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"))


def relative_frequency(df: DataFrame, key: Column, name: str = "bin") -> DataFrame:
    """Percent of rows for each key; the total is a second, tiny aggregate."""
    counts = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", (F.col("n") * 100.0 / F.col("t")).alias("percent"))


def energy_totals(df: DataFrame, by: str, columns: list[str], scale: float = 1e6) -> DataFrame:
    """Sums for each key and, with a null key, for all."""
    return df.rollup(by).agg(*[(F.sum(c) / scale).alias(c) for c in columns])


def standardise(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation per series; deviation 0 counts as 1."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by)

    def scaled(c: str) -> Column:
        s = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(s == 0, 1.0).otherwise(s)

    return df.withColumns({c: scaled(c) for c in columns})
