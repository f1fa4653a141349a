"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly into buckets by a seeded hash of the record, as many buckets as it takes for one to fit
in a task's memory. Pass two permutes each bucket by Fisher-Yates, seeded by the bucket, and writes it at its place in the one
long random order, which the shards cut into runs whose lengths differ by one at most.

The order depends on the seed, the rows and bucket_bytes alone: not on files, partitions, settings or machines, so a task that runs
again gives the same rows the same slots. Rows that are equal in all columns share a hash; where they overfill a bucket, one of them
and their number are kept, and the copies are made again and scattered by their numbers.

Null texts have size 1. Repeated rows keep their number. Empty tables give no rows. Columns of the input pass through, of any type and
name; those named like the results are replaced. A row larger than a bucket is a bucket's only burden, whole.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What one bucket may hold, in bytes; a task holds it about three times. A table has a bucket for each that its rows fill.
BUCKET_BYTES = 32 << 20
#: A bucket that holds so many times bucket_bytes has equal rows to blame, and copies that are made in one go.
OVERFULL, COPIES = 4, 4096


def _plain(df: DataFrame, c: str) -> Column:
    """The column, in a form that can be hashed and measured."""
    kind = df.schema[c].dataType
    return df[c] if isinstance(kind, (T.AtomicType, T.NullType)) else F.to_json(F.struct(df[c]))


def _bytes(df: DataFrame, names: list[str]) -> Column:
    """About what a row takes: its texts and binaries, and 16 bytes a column."""
    long = [c for c in names if not isinstance(df.schema[c].dataType, (T.AtomicType, T.NullType)) or isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(_plain(df, c)), F.lit(0)) for c in long), F.lit(16 * len(names))).cast("long")


def _scattered(df: DataFrame, names: list[str], seed: int, bucket_bytes: int) -> tuple[DataFrame, dict[int, int], int]:
    """(row: all columns as one, h, h2: 128 bits of its hash, bucket), the rows of each bucket, and how many buckets there are."""
    own = [_plain(df, c) for c in names]
    packed = df.select(F.struct(*[df[c] for c in names]).alias("row"), F.xxhash64(F.lit(seed), *own).alias("h"), F.xxhash64(F.lit(f"{seed}+"), *own).alias("h2"), _bytes(df, names).alias("b"))
    total = int(packed.agg(F.sum("b")).first()[0] or 0)
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod("h", F.lit(buckets)).cast("int")

    def counted(frame: DataFrame) -> list:
        return frame.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect()  # one row a bucket

    found = counted(packed)
    if max((r["b"] for r in found), default=0) > OVERFULL * bucket_bytes and buckets > 1:
        equal = packed.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).filter((F.col("n") > 1) & (F.col("b") > bucket_bytes)).select("h", "h2", "n")
        equal = F.broadcast(equal)  # fewer rows than there are buckets
        one = packed.join(equal, ["h", "h2"]).groupBy("h", "h2").agg(F.first("row").alias("row"), F.first("n").alias("n"), F.first("b").alias("b"))
        lots = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("lot"))
        each = lots.repartition(F.col("h"), F.col("lot")).select("*", F.explode(F.sequence(F.col("lot") * COPIES, F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1)).alias("copy"))
        copies = each.select("row", F.xxhash64(F.lit(seed), "h", "h2", "copy").alias("h"), F.col("copy").alias("h2"), "b")
        packed = packed.join(equal, ["h", "h2"], "left_anti").select("row", "h", "h2", "b").unionByName(copies)
        found = counted(packed)
    return packed.select("row", "h", "h2", bucket.alias("bucket")), {r["bucket"]: r["n"] for r in found}, buckets


def external_shuffle(df: DataFrame, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df's columns with `shard` (0 to shards-1) and `slot` (0, 1, ... in each shard): a uniform random order cut into runs.

    Law "rows": the shards' row counts differ by one at most. bucket_bytes bounds what a task holds in pass two.
    """
    names = [c for c in df.columns if c not in (shard, slot)]
    scattered, counts, buckets = _scattered(df, names, seed, bucket_bytes)
    starts, n = {}, 0
    for b in range(buckets):
        starts[b], n = n, n + counts.get(b, 0)
    # Shard s holds the places from bounds[s] to bounds[s + 1].
    bounds = [n * s // shards for s in range(shards + 1)]
    source = scattered.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "h", "h2")
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(shard, T.IntegerType(), False), T.StructField(slot, T.LongType(), False)])

    def permute(bucket: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = pa.concat_arrays(held)
        out, dice, order = to_arrow_schema(schema), random.Random(f"{seed}:{bucket}"), list(range(len(rows)))
        for i in range(len(order) - 1, 0, -1):  # Fisher-Yates
            j = dice.randrange(i + 1)
            order[i], order[j] = order[j], order[i]
        for at in range(0, len(order), 1024):
            part = rows.take(pa.array(order[at : at + 1024]))
            places = range(starts[bucket] + at, starts[bucket] + at + len(part))
            into = [bisect_right(bounds, p) - 1 for p in places]
            cols = [*part.flatten(), pa.array(into, pa.int32()), pa.array([p - bounds[s] for p, s in zip(places, into, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        bucket = None
        for batch in batches:
            of = batch.column(3).to_pylist()
            at = 0
            while at < len(of):
                end = bisect_right(of, of[at], at)  # sorted
                if bucket is not None and of[at] != bucket:
                    yield from permute(bucket, held)
                    held = []
                bucket = of[at]
                held.append(batch.column(0).slice(at, end - at))
                at = end
        if held:
            yield from permute(bucket, held)

    return source.mapInArrow(run, schema)


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write shuffled rows as Parquet, a folder for each shard, in order of slot within each file."""
    df.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
