"""Helpers that the text operators have in common: the shared folder, bounded Arrow batches and one memory of word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of one slice that a Python task holds at a time, in bytes; a single longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
#: Up to so many rows of a small table are sent to every executor.
SENT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own
    (tests); on a cluster that is an error, because executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gustframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gustframe-")
        spark.conf.set("gustframe.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    The files survive the loss of any executor and are read by several later plans without recomputing df. discard() deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sent_if_small(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, by: str, order: list[Column], rank: str = "rank", total: str = "total") -> tuple[DataFrame, DataFrame]:
    """(df with `rank`, 0, 1, ... in each group in the given order, and `total`, the rows of the group; the written table behind it).

    Rows are cut into ranges of group and order, so that a group of any size is spread over the tasks; what stands before a range is
    a sum over ranges. A null group is a group. df is read twice and should be a table. Rows that `order` does not tell apart may
    take each other's place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, F.col(by).asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), before.alias("__before"), F.sum("__n").over(group).alias(total))
    inside = placed.withColumn(rank, F.row_number().over(W.partitionBy(by, "__part").orderBy(*order)) - 1)
    both = inside.join(sent_if_small(starts), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    return both.withColumn(rank, F.col(rank) + F.col("__before")).drop("__by", "__at", "__part", "__before"), placed


def most_counted(counts: DataFrame, most: int) -> pa.Table:
    """The rows of counts (..., n) with the largest n, at most `most` of them: those above the eighth of a binary power up to which
    they are few enough. Only a histogram of some hundred rows and the chosen rows reach the driver."""
    kept = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "counts")
    left, cut = most, 0
    for r in kept.groupBy("step").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():
        left -= r["k"]
        if left < 0:
            cut = r["step"] + 1
            break
    found = kept.filter(F.col("step") >= cut).drop("step").toArrow()
    discard(kept)
    return found


class Frequent:
    """A mergeable summary of 64-bit keys: at most `most` of them with counts, among them every key whose share is above 1 / most.
    Where more keys are met, the count of the first that has no place is taken from all alike, so counts are lower bounds."""

    #: Keys that wait until they are merged.
    DUE = 1 << 18

    def __init__(self, most: int) -> None:
        self.most, self.keys, self.counts = most, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.due: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.due.append(keys)
        self.size += len(keys)
        if self.size > self.DUE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.due:
            own, n = np.unique(np.concatenate(self.due), return_counts=True)
            every, at = np.unique(np.concatenate([self.keys, own]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate([self.counts, n]))
            if len(every) > self.most:
                total -= np.partition(total, len(total) - self.most - 1)[len(total) - self.most - 1]
            self.keys, self.counts = every[total > 0], total[total > 0]
            self.due, self.size = [], 0
        return self.keys, self.counts


class WordHash(dict):
    """word -> 64-bit hash, the same in every process. The one memory of words that a Python worker keeps."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 1 << 16:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


@lru_cache(1)
def word_hashes() -> WordHash:
    return WordHash()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `most` bytes of `column`."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, at = batch.num_rows, 0
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if i > at and held + size > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        yield batch.slice(at, n - at)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: where the session has Spark's default, hand them to Python BATCH_BYTES at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[list], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """mapInArrow over `keep` and `text`: make() is called once a task and gives the function from a slice's values of `text` to new columns."""
    clash = {f.name for f in fields}
    keep = [c for c in keep if c not in clash]
    small_batches(df.sparkSession)
    name = "__text"
    while name in keep:
        name += "_"
    source = df.select(*keep, df[text].alias(name))
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, f = to_arrow_schema(schema), make()
        for part in slices(batches, name):
            new = f(part.column(part.schema.get_field_index(name)).to_pylist())
            cols = [part.column(part.schema.get_field_index(c)) for c in keep] + new
            yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, out, strict=True)], schema=out)

    return source.mapInArrow(run, schema)
