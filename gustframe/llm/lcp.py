"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases in levels. On each level, runs of one name become one name; deterministic coin tossing, repeated,
turns names into a few labels of which neighbours differ; a phrase begins at each local minimum of the labels and is named by a
hash of the names in it. Where a phrase begins depends on a few neighbours only, so equal stretches of two texts are parsed
alike except near their ends, wherever they stand. The hashes of the phrases on the upper levels are a text's signatures.

A fingerprint keeps, for each of BINS bins of the signatures' hash, eight bits of the least one, as hex; "00" is an empty bin.
The likeness of two fingerprints is the share of equal ones among the bins that either fills. Two empty texts are alike (1.0).

Null texts count as empty. Equal texts have equal fingerprints. Empty tables give no rows; a single document is its own next one.
Rows are ordered by doc_id (nulls first), then by a hash of the text, then by the text; repeated rows follow one another. The key may
be of any type that Spark orders as Python does: integers, strings, dates. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 128
#: Levels of phrases; signatures come from the last ones. A phrase of level k has about 3.4 ** k characters.
LEVELS = 4
SIGNED = (2, 3, 4)
#: Text of a range of rows that one task parses; the most ranges that the driver counts; and keys sampled for each.
RANGE_BYTES, MOST_RANGES, SAMPLED = 16 << 20, 1 << 16, 32
#: Characters parsed at a time; a longer text is parsed by itself, whole.
CHUNK = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which a name differs from the one before, plus that bit."""
    differ = x ^ before
    low = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(low - low.dtype.type(1))
    return (place << np.uint8(1)) | ((x & low) != 0)


def _level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names, and where each text begins in them. starts: where texts begin; none is empty."""
    n = len(names)
    first = np.zeros(n, bool)
    first[starts] = True
    # Runs of one name become one name, so that neighbours differ.
    head = first.copy()
    head[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(head)
    length = np.diff(at, append=n)
    x = names[at]
    if len(at) < n:
        many = length > 1
        x[many] = _mixed(x[many] + _A * length[many].astype(np.uint64))
        # A run's name may, by its hash, equal its neighbour's: then the two are told apart by the last bit.
        first = first[at]
        clash = np.flatnonzero((x[1:] == x[:-1]) & ~first[1:]) + 1
        x[clash] ^= np.uint64(1)
    begins = np.flatnonzero(first)
    label, before = x, np.empty_like(x)
    for _ in range(4):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[begins] = ~label[begins]  # a text's first name tosses against its opposite
        label = _toss(label, before)
    # label: at most 6 values; neighbours differ inside a text. A phrase begins at a text's first name and at local minima.
    n = len(label)
    cut = np.zeros(n, bool)
    if n > 2:
        cut[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    ends = np.append(begins[1:], n) - 1
    cut[ends] = False  # the last name is no minimum: its right neighbour is another text
    cut[begins] = True
    heads = np.flatnonzero(cut)
    place = np.arange(n, dtype=np.uint64) - np.repeat(heads, np.diff(heads, append=n)).astype(np.uint64)
    named = _mixed(np.add.reduceat(_mixed(x + _C * (place + np.uint64(1))), heads))
    return named, np.flatnonzero(first[heads])


def fingerprints(texts: list[str]) -> np.ndarray:
    """An array (texts, BINS) of bytes."""
    out = np.zeros((len(texts), BINS), np.uint8)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        _fill(out, at, texts[at:end])
        at = end
    return out


def _fill(out: np.ndarray, base: int, texts: list[str]) -> None:
    own = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(own):
        return
    sizes = np.array([len(texts[i]) for i in own])
    names = _mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _A)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rows, values = [], []
    for level in range(1, LEVELS + 1):
        names, starts = _level(names, starts)
        if level in SIGNED:
            rows.append(np.repeat(own, np.diff(starts, append=len(names))))
            values.append(_mixed(names + np.uint64(level)))
    row, value = np.concatenate(rows), np.concatenate(values)
    slot = (base + row) * BINS + (value % np.uint64(BINS)).astype(np.int64)
    # The least hash of each bin: sort by bin, then value, and take the first.
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    lead = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    out.reshape(-1)[slot[lead]] = (value[lead] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def _cuts(keys: DataFrame, ranges: int) -> list:
    """Keys that part the rows into about `ranges` ranges of equal counts, from a sample of SAMPLED keys a range by hash."""
    if ranges < 2:
        return []
    share = min(1.0, SAMPLED * ranges / max(1, keys.count()))
    drawn = keys.filter("k is not null").filter(F.pmod(F.xxhash64(F.lit(9), "k"), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = [r["k"] for r in drawn.orderBy("k").collect()]  # about SAMPLED * ranges of any table's keys
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _placed(rows: DataFrame, cuts: list) -> DataFrame:
    """rows with b, the number of cuts at or below k; nulls come first."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def placed(k: pd.Series) -> pd.Series:
        from bisect import bisect_right

        if k.dtype.kind in "iu":
            return pd.Series(np.searchsorted(np.array(sent.value), k.to_numpy(), "right").astype(np.int32))
        return pd.Series([0 if x is None or x != x else bisect_right(sent.value, x) for x in k], dtype=np.int32)

    # Integers with nulls would come as floats, which hold 53 bits.
    b = placed(F.coalesce("k", F.lit(cuts[0] - 1))) if cuts and isinstance(cuts[0], int) else placed("k") if cuts else F.lit(0)
    return rows.withColumn("b", b)


def _successors(df: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """(k, t, h, tail, b) in which each range b holds keys in order, then, as tail, the row that follows the range.

    Only sampled keys and the key of each range's first row pass the driver.
    """
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = df.select(F.col(key).alias("k"))
    cuts = _cuts(ids, ranges)
    firsts = {r["b"]: (None if r["hole"] else r["m"]) for r in _placed(ids, cuts).groupBy("b").agg(F.min("k").alias("m"), F.bool_or(F.col("k").isNull()).alias("hole")).collect()}
    filled = sorted(firsts)
    with_b = _placed(base, cuts).withColumn("h", F.xxhash64("t"))
    if not filled:
        return with_b.withColumn("tail", F.lit(False))
    # The first row of a range is the tail of the one before; that of the first range ends the last one.
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("m", df.schema[key].dataType), T.StructField("p", T.IntegerType())])
    table = df.sparkSession.createDataFrame([(b, firsts[b], before[b]) for b in filled], schema)  # a row a range
    # One row a range has to be copied: the least by (key, hash); all its equals hold the same text.
    heads = with_b.join(F.broadcast(table), "b").filter(F.col("k").eqNullSafe(F.col("m"))).groupBy("p").agg(F.min_by(F.struct("k", "t"), F.struct("h", "t")).alias("r"))
    tails = heads.select(F.col("r.k").alias("k"), F.col("r.t").alias("t"), F.col("p").alias("b"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("tail"))
    return with_b.withColumn("tail", F.lit(False)).unionByName(tails)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows laid out for fingerprint_with_next(): one task a range of about range_bytes, in order. A task streams its range, so
    beyond MOST_RANGES, where ranges grow with the table (1.5 GB at 100 TB), it takes longer but holds no more."""
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    ranges = min(MOST_RANGES, max(1, int(total) // range_bytes))
    rows = _successors(df, key, text, ranges)
    return rows.repartitionById(ranges, "b").sortWithinPartitions("b", "tail", F.col("k").asc_nulls_first(), "h", "t")


def fingerprint_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: key, n_chars, edited (the text whose last half is overwritten by the beginning of the next text), fingerprint,
    edited_fingerprint (hex), near_edited, near_next (likeness to the edited and to the next text's fingerprint)."""
    laid = with_next(df, key, text, range_bytes)
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("n_chars", T.LongType(), False)]
        + [T.StructField(n, T.StringType(), False) for n in ("edited", "fingerprint", "edited_fingerprint")]
        + [T.StructField(n, T.DoubleType(), False) for n in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)

        def made(rows: list[tuple], after: str) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            following = [*texts[1:], after]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following, strict=True)]
            marks = fingerprints([*texts, after])
            changed = fingerprints(edited)
            text_hex = [m.tobytes().hex() for m in marks[:-1]]
            cols = [[r[0] for r in rows], list(map(len, texts)), edited, text_hex, [m.tobytes().hex() for m in changed], likeness(marks[:-1], changed), likeness(marks[:-1], marks[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        held: list[tuple] = []  # rows of one range whose next text is still to come
        size, ranged = 0, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "t", "b", "tail")]
            for k, t, b, tail in zip(*cols, strict=True):
                if b != ranged:
                    held, size, ranged = [], 0, b  # the range before has ended with its tail
                if held and (tail or size > (2 << 20)):
                    yield made(held, t)
                    held, size = [], 0
                if not tail:
                    held.append((k, t))
                    size += len(t)

    return laid.mapInArrow(run, schema)
