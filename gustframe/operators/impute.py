"""Nearest-neighbour imputation per series."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions.times import cyclic, micros
from gustframe.operators.lineage import cut
from gustframe.operators.relational import sent_if_small

#: Cells of a distance block: incomplete rows times candidates.
BLOCK = 4_000_000


def knn_fill(x: np.ndarray, k: int = 5) -> np.ndarray:
    """Missing values of x (NaN) as means of the k nearest rows that have them.

    Distance: root of the mean squared difference over features that both rows have, times the number of features. A feature for
    which no row at a finite distance has a value gets its mean. Columns without any value stay empty.
    """
    out, seen = x.copy(), ~np.isnan(x)
    filled, n, d = np.where(seen, x, 0.0), *x.shape
    means = np.where(seen.any(0), filled.sum(0) / np.maximum(seen.sum(0), 1), np.nan)
    holes = np.flatnonzero(~seen.all(1))
    ones, squares = seen.astype(float), filled**2
    for at in range(0, len(holes), max(1, BLOCK // max(1, n))):
        rows = holes[at : at + max(1, BLOCK // max(1, n))]
        shared = ones[rows] @ ones.T
        with np.errstate(all="ignore"):
            dist = (squares[rows] @ ones.T - 2 * filled[rows] @ filled.T + ones[rows] @ squares.T) * d / shared
        dist = np.where(shared > 0, np.maximum(dist, 0), np.inf)
        for c in range(d):
            need = np.flatnonzero(~seen[rows, c])
            donors = np.flatnonzero(seen[:, c])
            if not len(need) or not len(donors):
                continue
            own = dist[np.ix_(need, donors)]
            m = min(k, len(donors))
            near = np.argsort(own, axis=1, kind="stable")[:, :m]
            value, far = x[donors[near], c], np.take_along_axis(own, near, 1)
            good = np.isfinite(far)
            mean = np.where(good, value, 0).sum(1) / np.maximum(good.sum(1), 1)
            out[rows[need], c] = np.where(good.any(1), mean, means[c])
    return out


def impute(df: DataFrame, by: str, ts: str, columns: list[str], k: int = 5, zero: float = 0.01, scaled: dict[str, float] | None = None) -> DataFrame:
    """df with missing values of `columns` filled, series by series.

    Columns and four cyclic features of the hour and the month are standardised (population deviation, 1 if 0), the holes filled,
    and the scale undone; values within `zero` of 0 become 0. scaled: factors applied before and undone after, for small quantities.
    One group is one series, which a task holds; only rows with holes are compared with others, in blocks of bounded size.
    """
    scaled = scaled or {}
    time = cyclic(ts)
    given = df.withColumns({f"__{n}": c for n, c in time.items()})
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema.fields])
    extra, names = [f"__{n}" for n in time], df.columns

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        x = np.column_stack([table[c].cast(pa.float64()).to_numpy() for c in [*columns, *extra]])
        factor = np.array([scaled.get(c, 1.0) for c in [*columns, *extra]])
        x = x * factor
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore")  # columns without any value
            mean, dev = np.nanmean(x, 0), np.nanstd(x, 0)
        dev = np.where((dev == 0) | np.isnan(dev), 1.0, dev)
        y = knn_fill((x - mean) / dev, k) * dev + mean
        y = np.where(np.abs(y) < zero, 0.0, y) / factor
        made = {c: pa.array(y[:, i], mask=np.isnan(y[:, i])) for i, c in enumerate(columns)}
        return pa.table([made.get(c, table[c]) for c in names], names=names)

    return given.groupBy(by).applyInArrow(fill, schema)


#: Rows of a series that are compared in one task: donors, and rows with holes.
DONORS, HOLES = 8_192, 2_048


def _best(x: np.ndarray, at: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, donor of y, distance) of the k nearest donors with a value for a feature; y is sorted by time, ties keep that order."""
    if not len(x) or not len(y):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    total, shared = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        apart = x[:, f, None] - y[None, :, f]
        both = ~np.isnan(apart)
        total += np.where(both, apart * apart, 0.0)
        shared += both
    with np.errstate(all="ignore"):
        # Rounded, so that equal distances are ties however they were summed.
        dist = np.where(shared > 0, np.round(total * x.shape[1] / shared, 9), np.inf)
    m = min(k, len(y))
    near = np.isfinite(dist) & (dist <= np.partition(dist, m - 1, axis=1)[:, m - 1 : m])
    r, j = np.nonzero(near)
    order = np.lexsort((at[j], j, dist[r, j], r))
    r, j = r[order], j[order]
    return r, j, dist[r, j]


def impute_in_blocks(df: DataFrame, by: str, ts: str, columns: list[str], k: int = 5, zero: float = 0.01, scaled: dict[str, float] | None = None, donors: int = DONORS, holes: int = HOLES) -> DataFrame:
    """impute() for series of any length: no task holds more than a block of a series.

    A series' rows are dealt into blocks of about `donors` rows, those with holes into blocks of about `holes`; each pair of blocks gives the k
    best donors of each hole in it, and of those of all blocks the k best count. Distances are rounded to nine decimals; of equal ones
    the earlier row counts, then the smaller value. df is read once; it and the best donors are kept as files meanwhile.
    """
    scaled = scaled or {}
    time = cyclic(ts)
    features = [*columns, *[f"__{n}" for n in time]]
    factor = {c: F.lit(float(scaled.get(c, 1.0))) for c in features}
    rows = df.withColumns({f"__{n}": c for n, c in time.items()}).withColumn("__id", F.monotonically_increasing_id())
    rows = cut(rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}), "series")
    values = {c: F.col(c) * factor[c] for c in features}
    open_row = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    stats = rows.groupBy(F.col(by).alias("__by")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(donors)).alias("__d"),
        F.greatest(F.ceil(F.sum(open_row) / F.lit(holes)), F.lit(1)).alias("__h"),
        F.array(*[F.avg(v) for v in values.values()]).alias("__m"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0)) for v in values.values()]).alias("__s"),
    )
    stats = sent_if_small(cut(stats, "stats"))
    same = F.col(by).eqNullSafe(F.col("__by"))
    unit = F.array(*[F.coalesce((v - F.col("__m")[i]) / F.col("__s")[i], F.lit(float("nan"))) for i, v in enumerate(values.values())])
    known = rows.join(stats, same).select("__by", "__id", micros(ts).alias("__t"), unit.alias("__z"), "__d", "__h", (open_row == 1).alias("__open"))
    # Null series have a block key too.
    place = F.xxhash64(F.lit(1), "__id")
    key = F.xxhash64(F.col("__by").isNull(), "__by")
    given = known.select(key.alias("s"), F.pmod(place, F.col("__d")).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__h") - 1)).alias("h"), F.col("__t").alias("t"), F.col("__z").alias("y"))
    asked = known.filter("__open").select(key.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__d") - 1)).alias("d"), F.pmod(place, F.col("__h")).alias("h"), F.col("__id").alias("id"), F.col("__z").alias("x"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("t")
        ids, t = left["id"].to_numpy(), right["t"].to_pylist()
        t = np.array([-(2**63) if v is None else v for v in t], np.int64)
        x, y = (np.array(side[c].to_pylist(), float).reshape(side.num_rows, len(features)) for side, c in ((left, "x"), (right, "y")))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for c in range(len(columns)):
            need, have = np.flatnonzero(np.isnan(x[:, c])), np.flatnonzero(~np.isnan(y[:, c]))
            step = max(1, BLOCK // max(1, len(have)))
            for at in range(0, len(need), step):
                part = need[at : at + step]
                r, j, dist = _best(x[part], y[have, c], y[have], k)
                for held, new in zip(out, (ids[part[r]], np.full(len(r), c), dist, t[have[j]], y[have[j], c]), strict=True):
                    held.append(new)
        whole = [np.concatenate(held) if held else np.empty(0) for held in out]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(w, k) for w, k in zip(whole, kinds, strict=True)], names=["__id", "c", "dist", "t", "z"])

    near = asked.groupBy("s", "d", "h").cogroup(given.groupBy("s", "d", "h")).applyInArrow(compare, "__id long, c int, dist double, t long, z double")
    order = W.partitionBy("__id", "c").orderBy("dist", "t", "z")
    best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    filled = best.groupBy("__id", "c").agg(F.avg("z").alias("z")).groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("c", "z"))).alias("__fill"))
    done = rows.join(stats, same).join(filled, "__id", "left")

    def whole(i: int, c: str):
        # Without a donor a hole gets its feature's mean, which is 0 here.
        own = F.coalesce(values[c], F.coalesce(F.col("__fill")[i], F.lit(0.0)) * F.col("__s")[i] + F.col("__m")[i])
        return F.when(F.abs(own) < zero, 0.0).otherwise(own) / factor[c]

    return done.select(*[whole(columns.index(c), c).alias(c) if c in columns else F.col(c) for c in df.columns])
