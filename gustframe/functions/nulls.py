"""Missing values and float semantics: NaN never travels, division never raises, ties round as floats do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str | float) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), b if isinstance(b, Column) else F.col(b) if isinstance(b, str) else F.lit(float(b)))


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes null once, at ingest, so that aggregates skip it."""
    own = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in own})


def sentinels_to_null(df: DataFrame, columns: list[str], values: tuple[float, ...] = (-999.0, -9999.0)) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c in columns})


def least_n(*cs: Column | str) -> Column:
    """The least, null if any is null."""
    return _strict(F.least, cs)


def greatest_n(*cs: Column | str) -> Column:
    return _strict(F.greatest, cs)


def _strict(f, cs) -> Column:
    cols = [col(c) for c in cs]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), f(*cols))


def clip(c: Column | str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Between low and high; null stays null."""
    out = col(c)
    if low is not None:
        out = greatest_n(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = least_n(out, high if isinstance(high, Column) else F.lit(float(high)))
    return out


def zero_below(c: Column | str, threshold: float = 0.01, absolute: bool = False) -> Column:
    x = col(c)
    return F.when((F.abs(x) if absolute else x) < threshold, F.lit(0.0)).otherwise(x)


def round_even(c: Column | str, decimals: int = 2) -> Column:
    """Half to even after scaling, as floats are rounded by array libraries."""
    scale = 10.0**decimals
    return F.rint(col(c) * scale) / F.lit(scale)


def bin_even(c: Column | str, width: float) -> Column:
    """The multiple of width that is nearest; halves go to the even one."""
    return F.rint(col(c) / F.lit(float(width))) * F.lit(float(width))


def mapped(c: Column | str, names: dict, default: str = "Other") -> Column:
    """names[c], the default for other values; null for null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.when(col(c).isNotNull(), F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(default)))


def any_null(*cs: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])


def all_below(threshold: float, *cs: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c) < threshold, F.lit(False)) for c in cs])


def row_sum(*cs: str) -> Column:
    """Sum over columns, nulls skipped."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cs])


def row_mean(*cs: str) -> Column:
    """Mean over the columns that aren't null."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cs])
    return F.try_divide(row_sum(*cs), n)
