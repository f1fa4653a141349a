"""Near duplicates by circulant MinHash.

A document's set holds its distinct shingles of `words` words. Signatures need two permutations only: sigma shuffles the
shingles' hashes once, pi is applied to them shifted around the ring by 0, 1, 2, ... steps, and the least value for each shift is
one coordinate. Bands of `rows` coordinates that agree make candidates; every link is confirmed on the full sets.

The graph of links can have as many edges as pairs in a group, so they are not listed. Equal sets are one node. In each bucket all
nodes are held against the least one first. Nodes that are connected by then need no more; the rest, those that a first node did not
connect, is held against the nodes of other components that met the same first node, unless counts rule a link out: the sizes, or
how much each differs from the first node and how much of that no other node has. After that no pair of a bucket is both
unconnected and able to link, but untested.

Null and empty texts have empty sets, link with nothing and stay. Rows that share a doc_id are told apart by their texts. A row
without doc_id takes the component of documents with an equal set but names none; else its component is null and it isn't kept.
Repeated rows get equal results. Texts of any length are read whole. Columns besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.shared import discard, map_texts, word_hashes, written

#: Bands and their rows: two sets with a similarity of 0.8 share no band once in eight million times.
BANDS, ROWS = 40, 5
#: Up to so many ids are sent to every executor (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    """A-Z in lower case; runs without ASCII white space."""
    text = text or ""
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, of the whole sequence."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    acc = np.full(n, np.uint64(min(words, len(h))))
    for k in range(min(words, len(h))):
        acc = _mixed(acc * _M[0] + h[k : k + n])
    return np.unique(acc)


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of 32 bits."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: sigma has placed the shingles on a ring of 2**32; the least of pi for each of `size` shifts."""
    ring = (_mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, 16384 // size)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(ring), step):
        np.minimum(out, _pi(ring[None, at : at + step] + shifts).min(1), out=out)
    return out


def _digest(hashes: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sets(df: DataFrame, words: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(id, h: hash of the text, n, set: hash of the whole set, bands: array<long>) per row of df."""

    def make():
        salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

        def f(texts):
            n, whole, band = [], [], []
            for t in texts:
                h = shingle_hashes(t, words)
                n.append(len(h))
                whole.append(_digest(h))
                if not len(h):
                    continue
                sig = signature(h, bands * rows).reshape(bands, rows).astype(np.uint64)
                acc = salt.copy()
                for k in range(rows):
                    acc = _mixed(acc + sig[:, k] * _M[0])
                band.append(acc.view(np.int64))
            sizes = np.cumsum([0] + [bands * bool(k) for k in n])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(band) if band else [], pa.int64()))
            return [pa.array(n, pa.int64()), pa.array(whole, pa.binary()), lists]

        return f

    fields = [T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    return map_texts(df.select(F.col(doc_id).alias("id"), _text_hash(text).alias("h"), F.col(text).alias("text")), "text", ["id", "h"], make, fields)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _common(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, ...) with na, nb and `common`, the size of the intersection of the full sets. sets: (id, hashes)."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(*pairs.columns, F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    )


def _full_sets(df: DataFrame, nodes: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(id: node, hashes) for each of nodes (node, id, h), read again from the document that stands for it."""
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    wanted = df.select(F.col(doc_id).alias("id"), _text_hash(text).alias("h"), F.col(text).alias("text")).join(nodes, ["id", "h"])
    # Rows that repeat would repeat every pair.
    wanted = wanted.groupBy("node").agg(F.first("text").alias("text"))

    def make():
        def f(texts):
            sets = [shingle_hashes(t, words).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))]

        return f

    return map_texts(wanted.withColumnRenamed("node", "id"), "text", ["id"], make, [T.StructField("hashes", T.ArrayType(T.LongType(), False))])


def _alone(sets: DataFrame, met: DataFrame) -> DataFrame:
    """(node, alone): how many shingles of a node are in no other node of met, first nodes included. No link can rest on these."""
    ids = met.select(F.col("node").alias("id")).unionByName(met.select(F.col("pivot").alias("id"))).distinct()
    each = sets.join(ids, "id", "left_semi").select("id", F.explode("hashes").alias("h"))
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("node")).filter("k = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of `edges` (a, b) reaches. Alternates large and small stars until nothing changes."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        # Large star: the larger neighbours of each node go to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the least of them.
        large = written(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "small")
        changed = after.exceptAll(now).limit(1).count() or now.exceptAll(after).limit(1).count()
        discard(now, large)
        now = after
        if not changed:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).groupBy("id").agg(F.min("component").alias("component"))


def _groups(df: DataFrame, words: int, threshold_percent: int, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """Per row of df: id, h (hash of the text), n, component (the least id reached), stands (whether the row's set is the one that stands for its component)."""
    t = threshold_percent
    docs = written(_sets(df, words, bands, rows, doc_id, text), "sets")
    # Equal sets are one node; the document of the least id stands for it. Written, nodes keep their numbers.
    nodes = docs.filter("n > 0 and id is not null").groupBy("set").agg(F.min(F.struct("id", "h")).alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "doc.id", "doc.h", "n", "bands"), "nodes")
    banded = nodes.select("node", "n", "id", F.explode("bands").alias("bucket"))
    # The first node of a bucket is that of the least id: a text that comes before its copies is nearer to them than they to each other.
    first = banded.groupBy("bucket").agg(F.min_by("node", "id").alias("pivot"), F.count(F.lit(1)).alias("met")).filter("met > 1").select("bucket", "pivot")
    held = written(banded.join(first, "bucket").select("bucket", "node", "n", "pivot"), "buckets")
    stars = held.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    due = held.select("node").distinct().join(nodes.select("node", "id", "h"), "node")
    sets = written(_full_sets(df, due, words, doc_id, text), "full")
    linked = F.expr(f"100 * common >= {t} * (na + nb - common)")
    tested = written(_common(stars, sets, t), "stars")
    edges = tested.filter(linked).select("a", "b")
    comps = components(edges)
    # What a first node did not connect, against the others that met the same first node. apart: size of the symmetric difference to it.
    c = comps.select(F.col("id").alias("a"), F.col("component").alias("c"))
    pc = comps.select(F.col("id").alias("b"), F.col("component").alias("pc"))
    met = tested.join(c, "a", "left").join(pc, "b", "left").select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("na").alias("n"), (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("apart"), F.coalesce("c", "a").alias("c"), F.coalesce("pc", "b").alias("pc"))
    met = written(met, "members")
    stray = met.filter("c <> pc")
    held_by = met.join(stray.select("pivot").distinct(), "pivot", "left_semi")
    shared = written(held_by.join(_alone(sets, held_by), "node", "left").withColumn("shared", F.col("apart") - F.coalesce("alone", F.lit(0))).drop("alone"), "shared")
    x = shared.filter("c <> pc").select("pivot", F.col("node").alias("a"), F.col("n").alias("xn"), F.col("c").alias("xc"), F.col("apart").alias("xd"), F.col("shared").alias("xs"))
    y = shared.select("pivot", F.col("node").alias("b"), F.col("n").alias("yn"), F.col("c").alias("yc"), "pc", F.col("apart").alias("yd"), F.col("shared").alias("ys"))
    # Two nodes differ by what each differs from the first node, less twice what these differences share.
    least = F.greatest(F.abs(F.col("xd") - F.col("yd")), F.col("xd") + F.col("yd") - 2 * F.least("xs", "ys"))
    more = (
        x.join(y, "pivot")
        .filter((F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("pc")) | (F.col("a") < F.col("b"))))
        .filter((F.col("xn") * t <= F.col("yn") * 100) & (F.col("yn") * t <= F.col("xn") * 100))
        .filter((100 + t) * least <= (100 - t) * (F.col("xn") + F.col("yn")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    late = _common(more, sets, t).filter(linked).select("a", "b")
    final = components(edges.unionByName(late))
    # A component is named by its least id; of its sets, one that has this id stands for it.
    of = written(nodes.select("node", "set", "id").join(final.withColumnRenamed("id", "node"), "node", "left").select("node", "set", "id", F.coalesce("component", "node").alias("c")), "of")
    names = of.groupBy("c").agg(F.min(F.struct("id", "node")).alias("least"))
    named = written(of.join(names, "c").select("set", F.col("least.id").alias("component"), (F.col("node") == F.col("least.node")).alias("first")), "named")
    # Both sides are read from files, so that Spark can split a set that a large share of the rows has.
    found = docs.filter("n > 0").select("id", "h", "n", "set").join(named, "set", "left")
    found = found.select("id", "h", "n", F.coalesce("component", "id").alias("component"), F.coalesce(F.col("first") & (F.col("id") == F.col("component")), F.lit(False)).alias("stands"))
    empty = docs.filter("n = 0").select("id", "h", "n", F.col("id").alias("component"), F.lit(True).alias("stands"))
    discard(held, sets, tested, met, shared, nodes, of)
    return found.unionByName(empty)


def near_duplicates(df: DataFrame, words: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included), kept (doc_id is component_id).

    Documents link if 100 * |intersection| >= threshold_percent * |union|.
    """
    found = _groups(df, words, threshold_percent, doc_id, text, bands, rows)
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def deduplicated(df: DataFrame, words: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each group, the one with the least doc_id; all columns stay. Rows that repeat a doc_id and its text
    are one document; rows that repeat a doc_id alone are documents of their own. Documents without words stay, and rows without
    doc_id, which no other row can stand for."""
    found = written(_groups(df, words, threshold_percent, doc_id, text, BANDS, ROWS).filter("id is not null").select("id", "h", "stands"), "groups")
    gone = found.filter("not stands").select("id", "h").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    at = (df[doc_id] == gone["id"]) & (_text_hash(text) == gone["h"])
    left = df.join(gone, at, "left_anti")
    again = found.filter("stands").groupBy("id", "h").count().filter("count > 1").select("id", "h")
    if again.limit(1).count():
        at = (df[doc_id] == again["id"]) & (_text_hash(text) == again["h"])
        once = left.join(again, at, "left_semi").dropDuplicates([doc_id, text])
        left = left.join(again, at, "left_anti").unionByName(once)
    return left.select(*df.columns)
