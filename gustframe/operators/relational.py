"""Joins, sets, division, conflict policies and the like, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_all(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Several variables' rows side by side, on shared keys."""
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, how: str = "inner") -> DataFrame:
    """Columns of the right side that collide get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), keys, how)


def aligned(left: DataFrame, right: DataFrame, key: list[str], column: str) -> DataFrame:
    """left with a column of right, null where keys don't meet."""
    return left.drop(column).join(right.select(*key, column), key, "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """The first match of each key in a dimension; rows without one go, as a lookup that finds nothing fails."""
    w = W.partitionBy(key).orderBy(order or columns[0])
    first = dim.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, *columns)
    return df.join(first, key)


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which condition isn't true; unknown ones stay."""
    return df.filter(~condition | condition.isNull())


def valid_interval(df: DataFrame, first: str, last: str, begin: Column, end: Column) -> DataFrame:
    """Rows whose interval covers [begin, end]; a missing bound doesn't exclude."""
    return df.filter((F.col(last).isNull() | (F.col(last) >= end)) & (F.col(first).isNull() | (F.col(first) <= begin)))


def divide(df: DataFrame, by: str, item: str, required: list[str]) -> DataFrame:
    """The values of `by` whose items are exactly the required set."""
    known = F.col(item).isin(*required)
    return df.groupBy(by).agg(F.count_distinct(item).alias("n"), F.bool_and(F.coalesce(known, F.lit(False))).alias("only")).filter((F.col("n") == len(set(required))) & F.col("only")).select(by)


def pair_counts(df: DataFrame, by: str, item: str) -> DataFrame:
    """(a, b, n): in how many groups two items occur together; on the diagonal, in how many an item is the only one.

    Distinct items of one group are collected, so a group costs its items squared once, not its rows."""
    sets = df.filter(F.col(item).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b"), F.size("s").alias("k")).filter("a <> b or k = 1")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of each pair, 0 where there is none. The values are given, so no extra job looks for them."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool, order: Column | str | None = None) -> DataFrame:
    """old and new rows together, one a key.

    update: new rows replace old ones, else they are ignored where the key exists. Of several new rows with one key the first by
    `order` counts (all columns by default)."""
    rank = W.partitionBy(*keys).orderBy(*([order] if order is not None else [c for c in new.columns if c not in keys]))
    once = new.withColumn("__n", F.row_number().over(rank)).filter("__n = 1").drop("__n")
    if update:
        return once.unionByName(old.join(once.select(*keys), keys, "left_anti"))
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))


def upsert_windowed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The same with update, in one exchange: both sides together, the newest of each key."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.desc("__src"), *[c for c in new.columns if c not in keys])
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__src")


def second_match(df: DataFrame, candidates: DataFrame, key: str, score: str) -> DataFrame:
    """The n-th row of df with a key gets the n-th best candidate with it, so that none is taken twice."""
    order = [c for c in df.columns if c != key]
    left = df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    right = candidates.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(score, *[c for c in candidates.columns if c not in (key, score)])))
    return left.join(right, [key, "__n"], "left").drop("__n")


#: Rows that a side may have to be sent to every executor.
BROADCAST_ROWS = 100_000


def sent_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than `most` rows; else Spark joins it as it would any table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every row of a grid of parameters (planes, turbines), which is small by its nature."""
    return df.crossJoin(sent_if_small(grid))


def path_matrix(df: DataFrame, by: str, variable: str, path: str, order: str, variables: list[str]) -> DataFrame:
    """(by, paths): for each variable the last path, missing ones left out."""
    last = df.groupBy(by).pivot(variable, variables).agg(F.max_by(path, order))
    return last.select(by, F.array_compact(F.array(*[F.col(f"`{v}`") for v in variables])).alias("paths"))


def sizes_of_sizes(df: DataFrame, by: str) -> DataFrame:
    """How many groups have how many rows."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def drop_matching(df: DataFrame, *parts: str) -> DataFrame:
    """Without the columns whose names hold one of the parts."""
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
