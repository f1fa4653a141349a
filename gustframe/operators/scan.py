"""Recurrences along a series as one scan: each row's value is a times the value before it plus b.

Such steps are associative: two of them, one after the other, are one such step. A series is cut into chunks of a week; in a chunk, which is
one row that holds an array, steps are put together by doubling, all in built-in expressions. What the chunks before leave is found
the same way on one row for each chunk, and handed to each. So a series of any length is spread over the tasks. Chunks are put together
once: both uses of them are the same exchange, which Spark runs once, however the rows lay before. Only rows travel, no steps; recurrences
that share their a go together, so the rows travel once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.operators.asof import CHUNK_SECONDS, chunk_of

#: Distances of the doubling: enough for two to the 24th rows in a chunk.
_STRIDES = [2**k for k in range(24)]


def _step(a: Column, *bs: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), *[b.cast("double").alias(f"b{i}") for i, b in enumerate(bs)])


def _then(first: Column, next_one: Column, n: int) -> Column:
    return _step(next_one["a"] * first["a"], *[next_one["a"] * first[f"b{i}"] + next_one[f"b{i}"] for i in range(n)])


def _same(n: int) -> Column:
    return _step(F.lit(1.0), *[F.lit(0.0)] * n)


def composed(steps: Column, n: int = 1) -> Column:
    """For an array of steps (a, b0 to b of n - 1), the array of what the first, the first two, the first three come to."""
    strides = F.filter(F.array(*map(F.lit, _STRIDES)), lambda d: d < F.size(steps))
    return F.aggregate(strides, steps, lambda m, d: F.zip_with(m, F.concat(F.array_repeat(_same(n), d), F.slice(m, F.lit(1), F.size(m) - d)), lambda now, before: _then(before, now, n)))


def affine_scan(df: DataFrame, by: list[str], ts: str, inputs: dict[str, Column], step: Callable[[Column, Column], tuple[Column, ...]], start: dict[str, Column | float], shown_first: str | None = None, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """df with a column for each name of start, in order of ts: its start (a number, or a column of `by`) in a series' first row, then
    a * the value before + its b.

    step(before, row) gives a and a b for each name from the inputs of the row before and of the row. shown_first: the input that the
    first row shows instead, while the recurrence goes on from start. Rows of one time come in the order of their inputs, then of all columns.
    """
    own, keys, n = df.columns, [f"__k{i}" for i in range(len(by))], len(start)
    rows = df.select(
        *[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)],
        chunk_of(df, ts, chunk).alias("__chunk"),
        F.struct(F.col(ts).alias("t"), *[c.alias(i) for i, c in inputs.items()], F.struct(*own).alias("row")).alias("x"),
    )
    held = rows.groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def steps_of(x: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(2), F.size(x)), lambda i: _step(*step(F.element_at(x, i - 1), F.element_at(x, i))))
        return F.when(F.size(x) > 1, F.concat(F.array(_same(n)), inner)).otherwise(F.array(_same(n)))

    # Both sides take the chunk's one array and find their steps themselves: of several columns Spark would prune one side's, and run
    # both. A struct of keys meets null keys too, and what is dealt out by it needs no other exchange for the join.
    dealt = held.select(F.struct(*keys, "__chunk").alias("__key"), "x").repartition("__key")

    def ends(at: int) -> Column:
        return F.struct(*[F.element_at("x", at)[i].alias(i) for i in inputs])

    line = W.partitionBy(*keys).orderBy("__chunk")
    total = F.aggregate(steps_of(F.col("x")), _same(n), lambda m, s: _then(m, s, n))
    sums = dealt.select(*[F.col(f"__key.{k}").alias(k) for k in (*keys, "__chunk")], ends(1).alias("head"), ends(-1).alias("last"), total.alias("m"))
    sums = sums.withColumn("p", F.lag(F.struct("last", "m")).over(line))
    # A chunk's first value from the first value of the chunk before; the series' first chunk begins with start, whatever was before.
    begin = F.when(F.col("p").isNull(), _step(F.lit(0.0), *[s if isinstance(s, Column) else F.lit(s) for s in start.values()]))
    begin = begin.otherwise(_then(F.col("p.m"), _step(*step(F.col("p.last"), F.col("head"))), n))
    named = sums.select("*", *[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)])
    steps = named.select(*keys, F.struct("__chunk", begin.alias("m")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    values = F.arrays_zip(F.transform("s", lambda s: s["__chunk"]).alias("c"), composed(F.transform("s", lambda s: s["m"]), n).alias("m"))
    begins = steps.select(*keys, F.posexplode(values).alias("at", "v"))
    begins = begins.select(F.struct(*keys, F.col("v.c").alias("__chunk")).alias("__begun"), F.col("v.m").alias("__w"), (F.col("at") == 0).alias("__new"))
    met = dealt.join(begins, F.col("__key") == F.col("__begun"))
    each = met.select("__w", "__new", F.posexplode(F.arrays_zip(F.col("x"), composed(steps_of(F.col("x")), n).alias("m"))).alias("at", "v"))
    out = []
    for i, name in enumerate(start):
        value = F.col("v.m.a") * F.col(f"__w.b{i}") + F.col(f"v.m.b{i}")
        if shown_first:
            value = F.when(F.col("__new") & (F.col("at") == 0), F.col(f"v.x.{shown_first}").cast("double")).otherwise(value)
        out.append(value.alias(name))
    return each.select(*[F.col(f"v.x.row.`{c}`").alias(c) for c in own], *out)
