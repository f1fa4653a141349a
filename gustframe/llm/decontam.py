"""Benchmark decontamination by spaced seeds.

A seed hashes some of the words in a short window, the same places each time, and ignores the others: two passages that differ in
an ignored word still meet. The masks are chosen so that whatever two words of thirteen are replaced, one of them sees only
words that stayed; items of five to twelve words have masks of their own, by the same rule for as many substitutions as they may hold.

The seeds of all items are a table, and those of the documents are joined with it. A bitmap of the items' seeds, of at most 2**27
bits whatever the benchmark's size, keeps most of the documents' seeds out of the join beforehand. Around each hit, document and
item are compared word by word on every diagonal on which they share a seed.

Items often share a line that many documents quote. A text with many items is compared in rows of some items each, dealt out over the
tasks. Where it only counts whether a text has an overlap (`clean`), each of its seeds is first followed to one item; only texts
that have no overlap with these are compared with the others, so that a quoted line costs a comparison a document, not one a pair.

An overlap is reported where thirteen words in a row (all words of a shorter item) agree in at least 80 % of places; for each document
and item the one with the most agreeing words, of these the first. Items of up to four words have to be met word for word.

Words are runs of letters and digits in lower case; whole texts are read, however long. Null texts have no words, items without words are
not looked for. Equal texts are compared once, and repeated rows are judged alike; repeated item ids are items of their own. Empty
tables have no overlaps. Other columns are kept, whatever their names; one that is named like the result is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.shared import discard, map_texts, slices, word_hashes, written

#: Words in which an overlap is judged, and the percentage of them that has to agree.
SPAN, AGREE = 13, 80
#: Places of a window that a seed reads. Any two substitutions in SPAN words leave one of them whole somewhere.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 8, 9))
#: Bits of the bitmap, as a power of two, at most; and how many it has for each seed below that.
MOST_BITS, BITS_A_SEED = 27, 64
#: Up to so many keys of texts (16 MB), or so many overlaps (about as much), are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_OVERLAPS = 1_000_000, 250_000
#: Items with their words that one row holds at most, about: a text that shares seeds with more is compared in several rows.
ITEMS_A_ROW = 64
_WORD = re.compile(r"[^\W_]+")
_MUL, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashed_words(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(word_hashes().__getitem__, found), np.uint64, len(found))


@lru_cache(SPAN)
def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words. Below SPAN: few masks that read as many words as possible, one of which is met whichever words are replaced."""
    if n >= SPAN:
        return MASKS
    cuts = n - math.ceil(n * AGREE / 100)
    for size in range(min(len(MASKS[0]), n - cuts) if cuts else n, 0, -1):
        shapes = [(0, *c) for c in combinations(range(1, n), size - 1)]
        # For each mask, the replacements that some place of it survives.
        survived = {m: {c for p in range(n - m[-1]) for c in combinations([i for i in range(n) if i - p not in m], cuts)} for m in shapes}
        left, chosen = set(combinations(range(n), cuts)), []
        while left and len(chosen) < 4:
            chosen.append(max(shapes, key=lambda m: len(left & survived[m])))
            left -= survived[chosen[-1]]
        if not left:
            return tuple(chosen)
    raise AssertionError("a mask of one word survives always")


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the places `mask` of every window that fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64(sum(o << (5 * i) for i, o in enumerate(mask)) & (2**64 - 1)))
    for o in mask:
        acc = (acc ^ words[o : o + n]) * _MUL
        acc ^= acc >> np.uint64(29)
    acc *= _M1
    return acc ^ (acc >> np.uint64(32))


def diagonals(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places in the document less places in the item, of all seeds that they share; ascending. Memory is linear in both."""
    met = np.zeros(len(words) + len(item), bool)
    for mask in masks_for(len(item)):
        here, there = seeds(words, mask), seeds(item, mask)
        order = np.argsort(here, kind="stable")
        here = here[order]
        low, high = np.searchsorted(here, there, "left"), np.searchsorted(here, there, "right")
        for p in np.flatnonzero(high > low):
            met[order[low[p] : high[p]] - p + len(item)] = True
    return np.flatnonzero(met) - len(item)


def overlap(words: np.ndarray, item: np.ndarray) -> dict | None:
    """The overlap with the most agreeing words, of these the first. Diagonals come in order of what they can hold, so that repeated words end it early."""
    span, best, perfect = min(SPAN, len(item)), None, False
    at = diagonals(words, item)
    held = np.minimum(len(words), at + len(item)) - np.maximum(0, at)
    for i in np.lexsort((at, -held)):
        a, b = max(0, int(at[i])), max(0, int(at[i])) + int(held[i])
        if b - a < span or best and (b - a < best["matched"] or perfect and b - a == best["matched"]):
            break
        same = words[a:b] == item[a - at[i] : b - at[i]]
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[span:] - total[:-span] >= math.ceil(span * AGREE / 100))
        if not len(good):
            continue
        covered = np.zeros(b - a + 1, np.int64)
        covered[good] += 1
        covered[good + span] -= 1  # good + span <= b - a
        inside = np.cumsum(covered)[:-1] > 0
        found = {"start": int(a + good[0]), "end": int(a + good[-1] + span), "words": int(inside.sum()), "matched": int((same & inside).sum()), "item_words": len(item)}
        if best is None or (found["matched"], -found["start"]) > (best["matched"], -best["start"]):
            best, perfect = found, found["matched"] == b - a
    return best


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, num: a number of its own, words: hashes) of items with words."""

    def make():
        def f(texts):
            found = [hashed_words(t).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, found)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))]

        return f

    given = benchmark.select(F.col(item_id).alias("item"), F.monotonically_increasing_id().alias("num"), F.col(item_text).alias("text")).filter("text is not null")
    return map_texts(given, "text", ["item", "num"], make, [T.StructField("words", T.ArrayType(T.LongType(), False))]).filter("size(words) > 0")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(h, num): the distinct seeds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words.values.to_numpy().view(np.uint64)
                h = np.unique(np.concatenate([seeds(own, m) for m in masks_for(len(own))])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), num))], names=["h", "num"])

    return items.select("num", "words").mapInArrow(run, "h long, num long")


def _bitmap(item_seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits as a power of two, bytes): one bit for each value that the first bits of a seed take."""
    n = item_seeds.count()
    power = min(MOST_BITS, max(15, math.ceil(math.log2(max(1, n) * BITS_A_SEED))))
    place = F.shiftrightunsigned("h", 64 - power) + 1
    parts = item_seeds.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 2**12 rows of 4 kB at most
    out = np.zeros((1 << power) // 8, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return power, out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(row: all columns as one, text, k1, k2: 128 bits of the text's hash)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(17), whole).alias("k2"))


def _verified(keyed: DataFrame, pairs: DataFrame, items: DataFrame, kind: T.DataType, any_one: bool) -> DataFrame:
    """(k1, k2, overlaps: those of one row of items), where there are any, of pairs (k1, k2, num). any_one: the first found in a row ends it."""
    keys = pairs.select("k1", "k2").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = keyed.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    rows = F.ceil(F.count(F.lit(1)).over(W.partitionBy("k1", "k2")) / ITEMS_A_ROW)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("num"), rows))
    against = dealt.join(items, "num").groupBy("k1", "k2", "part").agg(F.collect_list(F.struct("num", "item", "words")).alias("items"))
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("overlaps", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in slices([batch], "text"):
                rows = []
                for t, given in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    words, own, found = hashed_words(t), given.values, []
                    nums, ids, lists = own.field("num").to_pylist(), own.field("item").to_pylist(), own.field("words")
                    for i, (num, item) in enumerate(zip(nums, ids, strict=True)):
                        got = overlap(words, lists[i].values.to_numpy().view(np.uint64))
                        if got:
                            found.append({"num": num, "item_id": item, **got})
                            if any_one:
                                break
                    rows.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, out.field(2).type)], schema=out)

    every = texts.join(against, ["k1", "k2"]).repartition("k1", "k2", "part").select("k1", "k2", "text", "items")
    return every.mapInArrow(run, schema).filter("size(overlaps) > 0")


def _found(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, any_one: bool = False) -> DataFrame:
    """(k1, k2, overlaps) of the distinct texts that have any, written. any_one: (k1, k2) only, several rows for a text perhaps."""
    items = written(_items(benchmark, item_id, item_text), "items")
    lengths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n)})
    own = written(_item_seeds(items), "item_seeds")
    power, bits = _bitmap(own)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def f(texts):
            out = []
            for t in texts:
                words, found = hashed_words(t), [np.empty(0, np.uint64)]
                for m in masks:
                    h = seeds(words, m)
                    at = h >> np.uint64(64 - power)
                    found.append(h[(sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                out.append(np.unique(np.concatenate(found)).view(np.int64))
            ends = np.cumsum([0, *map(len, out)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))]

        return f

    keyed = _keyed(docs, text).select("k1", "k2", "text")
    hits = map_texts(keyed, "text", ["k1", "k2"], make, [T.StructField("hits", T.ArrayType(T.LongType(), False))]).select("k1", "k2", F.explode("hits").alias("h"))
    fields = [T.StructField("num", T.LongType()), T.StructField("item_id", benchmark.schema[item_id].dataType)]
    kind = T.ArrayType(T.StructType(fields + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "words", "matched", "item_words")]))
    if not any_one:
        pairs = written(hits.join(own, "h").select("k1", "k2", "num").distinct(), "pairs")
        every = F.sort_array(F.flatten(F.collect_list("overlaps")))  # in the items' order
        merged = _verified(keyed, pairs, items, kind, False).groupBy("k1", "k2").agg(every.alias("overlaps"))
        found = written(merged.withColumn("overlaps", F.transform("overlaps", lambda o: o.dropFields("num"))), "overlaps")
        discard(items, own, pairs)
        return found
    hits = written(hits.join(own, "h", "left_semi"), "hits")  # without those that the bitmap let through for nothing
    firsts = written(hits.join(own.groupBy("h").agg(F.min("num").alias("num")), "h").select("k1", "k2", "num").distinct(), "pairs")
    soon = written(_verified(keyed, firsts, items, kind, True).select("k1", "k2").distinct(), "overlaps")
    left = hits.join(soon, ["k1", "k2"], "left_anti").join(own, "h").select("k1", "k2", "num").distinct()
    pairs = written(left.join(firsts, ["k1", "k2", "num"], "left_anti"), "pairs")
    found = written(soon.union(_verified(keyed, pairs, items, kind, True).select("k1", "k2")), "overlaps")
    discard(items, own, hits, firsts, soon, pairs)
    return found


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "overlaps", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with `out`: array<struct<item_id, start, end, words, matched, item_words>>, start and end in words."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    found = _found(docs, benchmark, text, item_id, item_text)
    if (found.agg(F.sum(F.size("overlaps"))).first()[0] or 0) <= BROADCAST_OVERLAPS:
        found = F.broadcast(found)
    rows = _keyed(docs, text).drop("text").join(found, ["k1", "k2"], "left")
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], F.coalesce("overlaps", F.array().cast(found.schema["overlaps"].dataType)).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without an overlap, with docs' columns."""
    found = _found(docs, benchmark, text, item_id, item_text, any_one=True).distinct()
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    return _keyed(docs, text).drop("text").join(found, ["k1", "k2"], "left_anti").select("row.*")
