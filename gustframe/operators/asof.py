"""As-of joins without a pair explosion: one union, dealt out by series and week, and one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions.times import micros

#: Length of a chunk of a series: a week.
CHUNK_SECONDS = 7 * 86_400
#: Chunks that rows after the end of the right side are spread over.
TAIL = 64


def chunk_of(df: DataFrame, ts: str, seconds: int) -> Column:
    """The chunk of a stamp; numbers count as seconds."""
    kind = df.schema[ts].dataType
    at = F.col(ts) / F.lit(seconds) if isinstance(kind, T.NumericType) else micros(ts) / F.lit(seconds * 1_000_000)
    return F.floor(at).cast("long")


def asof_backward(left: DataFrame, right: DataFrame, by: str, ts: str, payload: list[str], prefer: str | None = None, clip: bool = False, chunk: int | None = CHUNK_SECONDS) -> DataFrame:
    """Each left row with the payload of the last right row of its series at or before its time.

    Nulls in the matched row stay null. Of right rows with one time, the one with the largest `prefer` counts (the latest
    forecast); without it, the largest payload. Left rows before the first right row have nulls, as have those without a time; all left
    rows are kept, or, with clip, those from the first to the last right row, as clip_to_range() leaves them, in the same pass.

    Rows are dealt out by series and chunk of `chunk` seconds, so that a series of any length is spread over the tasks. What a chunk
    begins with, the last right row of the chunks before, is found on one row for each chunk and joins the pass as a row of its
    own; rows after the right side's end are spread over TAIL chunks that begin with its last row. left is read once, right's keys,
    stamps and payload twice more. With chunk None a series is one window and both are read once: for series of bounded length, such
    as hourly ones, at the end of a long plan.
    """
    own = left.columns
    tie = F.col(prefer) if prefer else F.lit(None).cast("long")
    pack = F.struct(*[F.col(c) for c in payload])
    row_type = left.select(F.struct(*own).alias("r")).schema["r"].dataType
    pack_type = right.select(pack.alias("p")).schema["p"].dataType
    tie_type = right.schema[prefer].dataType if prefer else T.LongType()
    known = right.filter(F.col(ts).isNotNull())
    l_rows = left.select(F.col(by).alias("__by"), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.struct(*own).alias("__row"), F.lit(None).cast(pack_type).alias("__pack"))
    r_rows = known.select(F.col(by).alias("__by"), F.col(ts).alias("__ts"), F.lit(0).alias("__side"), tie.alias("__tie"), F.lit(None).cast(row_type).alias("__row"), pack.alias("__pack"))
    keys, more = ["__by"], F.lit(False)
    if chunk:
        keys = ["__by", "__chunk"]
        right_chunk = chunk_of(right, ts, chunk)
        # One row, so it may go to every task.
        end = F.broadcast(known.agg(F.max(right_chunk).alias("__end")))
        whole = chunk_of(left, ts, chunk)
        after = F.col("__end") + 1 + F.pmod(F.col("__chunk") - F.col("__end"), F.lit(TAIL))
        l_rows = left.select("*", whole.alias("__chunk")).crossJoin(end).withColumn("__chunk", F.when(F.col("__chunk") > F.col("__end"), after).otherwise(F.col("__chunk")))
        l_rows = l_rows.select(F.col(by).alias("__by"), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.struct(*own).alias("__row"), F.lit(None).cast(pack_type).alias("__pack"), "__chunk", F.lit(False).alias("__more"))
        r_rows = r_rows.withColumns({"__chunk": chunk_of(r_rows, "__ts", chunk), "__more": F.lit(False)})
        begins = _begins(r_rows, end).select("__by", F.lit(None).cast(left.schema[ts].dataType).alias("__ts"), F.lit(-1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.lit(None).cast(row_type).alias("__row"), "__pack", "__chunk", "__more")
        r_rows = r_rows.unionByName(begins)
        more = F.max("__more").over(W.partitionBy(*keys))
    order = W.partitionBy(*keys).orderBy(F.col("__side") >= 0, "__ts", "__side", F.col("__tie").asc_nulls_first(), F.col("__pack").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = l_rows.unionByName(r_rows).withColumn("__found", F.last("__pack", ignorenulls=True).over(order))
    keep = F.col("__side") == 1
    if clip:
        stamp = F.when(F.col("__side") == 0, F.col("__ts"))
        both = both.withColumn("__kept", F.col("__found").isNotNull() & (more | F.coalesce(F.col("__ts") <= F.max(stamp).over(W.partitionBy(*keys)), F.lit(False))))
        keep = keep & F.col("__kept") & F.col("__ts").isNotNull()
    # The key comes from the column that the rows are dealt by, so that what follows by this key needs no exchange.
    columns = [F.col("__by").alias(c) if c == by else F.col(f"__row.`{c}`").alias(c) for c in own]
    return both.filter(keep).select(*columns, *[F.col(f"__found.{c}").alias(c) for c in payload])


def _begins(right: DataFrame, end: DataFrame) -> DataFrame:
    """(__by, __chunk, __pack: what the chunk begins with, __more: whether right rows come in a later chunk) for every chunk from a
    series' first right row to TAIL chunks after the end of all."""
    held = right.groupBy("__by", "__chunk").agg(F.max_by("__pack", F.struct("__ts", F.col("__tie"), "__pack")).alias("__pack"))
    w = W.partitionBy("__by").orderBy("__chunk")
    next_one = F.lead("__chunk").over(w)
    line = held.crossJoin(end).select("__by", "__pack", F.col("__chunk").alias("c"), next_one.alias("n"), F.lead("__chunk", 2).over(w).alias("m"), F.lag("__chunk").over(w).alias("p"), "__end")
    # Chunks up to the next right one begin with this one's last row; the first chunk of a series begins with nothing.
    to = F.coalesce("n", F.col("__end") + TAIL + 1)
    after = line.select("__by", "__pack", "n", "m", F.explode(F.sequence(F.col("c") + 1, to)).alias("__chunk"))
    later = (F.col("__chunk") < F.col("n")) | F.col("m").isNotNull()
    first = line.filter("p is null").select("__by", F.col("c").alias("__chunk"), F.lit(None).cast(line.schema["__pack"].dataType).alias("__pack"), F.col("n").isNotNull().alias("__more"))
    return after.select("__by", "__chunk", "__pack", F.coalesce(later, F.lit(False)).alias("__more")).unionByName(first)


def clip_to_range(left: DataFrame, right: DataFrame, by: str, ts: str) -> DataFrame:
    """Left rows from the first to the last stamp of their series on the right; series without one go."""
    span = right.groupBy(by).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    return left.join(span, by).filter(F.col(ts).between(F.col("__lo"), F.col("__hi"))).select(*left.columns)
