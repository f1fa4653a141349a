"""N-gram Jaccard join by an R-tree over count vectors.

A document's set holds its distinct shingles of `words` words. Shingles are hashed into groups, and how many of a set fall into each
group is a point; of two sets no more can be common than the sum of the smaller counts, group by group. Groups come in two grains.

Fine groups (64 bits) branch at the root: summed minima over them reach what a link needs only if two points share one of their first
n - ceil(t * n) + 1 fine groups, in an order that is the same for all, groups that many documents fill last. A branch is named by
its least document, and a node goes once to each least document that it meets in a branch. Coarse groups (`GROUPS`) are the
coordinates inside a branch: points are packed in pages of `FAN` in order of size and of sums of coordinates, pages in boxes of `FAN`, up
to a top; pairs of boxes go down together while the summed minima of their upper corners leave a link possible. What is left of pairs of
points is verified on the full sets.

A group of copies is as many links as pairs, so they are not listed: equal sets are one node, each node is held against the least of
its branches' least ones first, and pairs in the tree that are connected by then go no further. Nothing is capped, and no link between components
stays untested. Of a branch whose documents are all just below the threshold many pairs have to be tested.

Null and empty texts have empty sets and link with nothing. Rows that share a doc_id are told apart by their texts. A row without doc_id
takes the component of an equal set but names none. Repeated rows get equal results. Texts are read whole, and no columns but doc_id
and text, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.minhash import _M, _common, _digest, _full_sets, _mixed, _text_hash, components
from gustframe.llm.shared import Frequent, discard, map_texts, most_counted, ranked, slices, small_batches, written

#: Coordinates of a point: groups of shingles, by their hash. Sets of more than LONG shingles have FINE ones besides, of which GROUPS are
#: sums; pairs of them are held against these before they are verified.
GROUPS, FINE, LONG = 128, 2048, 1500
#: Points of a page, and pages or boxes of a box.
FAN = 32
#: Shingles that a task's summary of frequent ones holds, and that are sent to every task with the size of their count (2.4 MB).
SUMMARY, FREQUENT = 1 << 17, 1 << 18


class _Words(dict):
    """word -> 64-bit hash, as shared.WordHash gives for its text."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def _known() -> _Words:
    return _Words()


def set_of(text: bytes | None, words: int) -> np.ndarray:
    """minhash.shingle_hashes() of a text's bytes: A-Z in lower case, cut at ASCII white space."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_known().__getitem__, found), np.uint64, len(found))
    n, size = max(1, len(h) - words + 1), min(words, len(h))
    acc = np.full(n, np.uint64(size))
    for k in range(size):
        acc = _mixed(acc * _M[0] + h[k : k + n])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def counts_of(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many fall into each group; 255 stands for that many and more, which bounds nothing."""
    return np.minimum(np.bincount((hashes % np.uint64(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts along the last axis."""
    least = np.minimum(a, b)
    out = least.sum(-1, dtype=np.int64)
    full = (least == 255).any(-1)
    out[full] = 2**40
    return out


def first_groups(hashes: np.ndarray, percent: int, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fine groups in which a set has to meet another to link with it: the rarest, then those of the least hash."""
    n = len(hashes)
    due = n - -(-percent * n // 100) + 1
    if due >= n or not len(known):
        return hashes[:due]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    kind = np.where(known[at] == hashes, size[at], np.uint8(0))
    return hashes[np.argsort(kind, kind="stable")[:due]] if kind.any() else hashes[:due]


def _frequent(df: DataFrame, words: int, text: str) -> Broadcast:
    """Shingles that many documents have, sorted, and the binary logarithm of how many do, for every task."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent(SUMMARY)
        for part in slices(batches, "t"):
            for t in part.column("t").to_pylist():
                seen.add(set_of(t, words))
        keys, counts = seen.merge()
        keys, counts = keys[counts > 1], counts[counts > 1]
        yield pa.RecordBatch.from_pydict({"k": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    each = df.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    best = most_counted(each.filter("n > 3"), FREQUENT)
    keys, n = best.column("k").to_numpy().view(np.uint64), best.column("n").to_numpy()
    order = np.argsort(keys)
    return df.sparkSession.sparkContext.broadcast((keys[order], np.log2(np.maximum(n[order], 1)).astype(np.uint8)))


def _points(df: DataFrame, words: int, percent: int, sent: Broadcast, doc_id: str, text: str) -> DataFrame:
    """(id, h: hash of the text, n, set: hash of the whole set, counts, fine: finer ones of long sets, first: groups of the root) per row of df."""

    def make() -> Callable[[list], list[pa.Array]]:
        known, size = sent.value

        def f(texts: list) -> list[pa.Array]:
            n, whole, counts, fine, first = [], [], [], [], []
            for t in texts:
                h = set_of(t, words)
                n.append(len(h))
                whole.append(_digest(h))
                counts.append(counts_of(h).tobytes() if len(h) else None)
                fine.append(counts_of(h, FINE).tobytes() if len(h) > LONG else None)
                first.append(first_groups(h, percent, known, size).view(np.int64) if len(h) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, first)])
            return [pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int64()))]

        return f

    fields = [T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType(), False))]
    return map_texts(df.select(F.col(doc_id).alias("id"), _text_hash(text).alias("h"), F.col(text).cast("binary").alias("text")), "text", ["id", "h"], make, fields)


def _corners(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _able(a_n: np.ndarray, b_n: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many common shingles are enough for sets of at least these sizes."""
    return common * (100 + percent) >= percent * (a_n + b_n)


def _held(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, na, nb) that the summed minima of counts (node, x) leave possible. Files say little about what counts take in
    memory, so nothing is broadcast."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = batch.slice(at, 1024)
                common = minima(_corners(x.column("xa")), _corners(x.column("xb")))
                ok = _able(x.column("na").to_numpy(), x.column("nb").to_numpy(), common, percent)
                yield x.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    counts = counts.hint("merge")
    both = pairs.join(counts.withColumnsRenamed({"node": "a", "x": "xa"}), "a").join(counts.withColumnsRenamed({"node": "b", "x": "xb"}), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(keep, "a long, b long, na long, nb long")


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int, name: str) -> DataFrame:
    """pairs (a, b) that sizes and the summed minima of the counts leave possible, of two long sets those of the finer counts too; written."""
    size = nodes.select("node", "n")
    near = pairs.join(size.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
    near = near.filter(f"na * {percent} <= nb * 100 and nb * {percent} <= na * 100")
    coarse = written(_held(near, nodes.select("node", F.col("counts").alias("x")), percent), "coarse")
    long = f"na > {LONG} and nb > {LONG}"
    fine = _held(coarse.filter(long), nodes.filter("fine is not null").select("node", F.col("fine").alias("x")), percent)
    out = written(coarse.filter(f"not ({long})").unionByName(fine).select("a", "b"), name)
    discard(coarse)
    return out


def _order(nodes: DataFrame) -> DataFrame:
    """nodes with `place`: slabs of like sizes, in each by sums over halves, quarters, eighths of the coordinates, as parts of the size."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                c, n = _corners(x.column("counts")), x.column("n").to_numpy()
                place = np.minimum((np.log(n) / np.log(1.1)).astype(np.int64), 255)
                for parts in (2, 4, 8, 16):
                    sums = c.reshape(len(n), parts, -1).sum(2, dtype=np.int64)[:, ::2]
                    for k in range(sums.shape[1]):
                        if parts < 16 or k < 2:
                            place = place * 16 + np.minimum(sums[:, k] * parts * 8 // n, 15)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(place)], names=[*x.schema.names, "place"])

    return nodes.mapInArrow(f, T.StructType([*nodes.schema.fields, T.StructField("place", T.LongType())]))


_BOX = "pivot long, no long, low long, high long, corner binary, c long"


def _pages(points: DataFrame) -> DataFrame:
    """(pivot, no, low, high: sizes, corner: upper, c: the component if all have one, nodes, ns, cs, counts) of points (pivot, rank, node, n, c, counts)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for pivot, no, held in zip(x.column("pivot").to_pylist(), x.column("no").to_pylist(), x.column("x").to_pylist(), strict=True):
                counts = np.frombuffer(b"".join(p["counts"] for p in held), np.uint8).reshape(len(held), -1)
                ns, cs = [p["n"] for p in held], [p["c"] for p in held]
                rows.append((pivot, no, min(ns), max(ns), counts.max(0).tobytes(), cs[0] if len(set(cs)) == 1 else None, [p["node"] for p in held], ns, cs, counts.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pivot", "no", "low", "high", "corner", "c", "nodes", "ns", "cs", "counts"])

    held = points.groupBy("pivot", F.expr(f"rank div {FAN}").alias("no")).agg(F.collect_list(F.struct("node", "n", "c", "counts")).alias("x"))  # FAN at most
    return held.mapInArrow(f, _BOX + ", nodes array<long>, ns array<long>, cs array<long>, counts binary")


def _boxes(below: DataFrame) -> DataFrame:
    """Boxes of FAN boxes each."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            corner = [np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1).max(0).tobytes() for own in x.column("corners").to_pylist()]
            at = x.schema.get_field_index("corners")
            yield pa.RecordBatch.from_arrays([pa.array(corner, pa.binary()) if i == at else c for i, c in enumerate(x.columns)], names=["corner" if n == "corners" else n for n in x.schema.names])

    one = F.when((F.min("c") == F.max("c")) & (F.count("c") == F.count(F.lit(1))), F.min("c"))
    held = below.groupBy("pivot", F.expr(f"no div {FAN}").alias("no")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("corner").alias("corners"), one.alias("c"))
    return held.mapInArrow(f, _BOX)


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(pivot, a, b) of pairs of boxes (pivot, a, b, corners ca and cb, least sizes na and nb) that may hold a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                common = minima(_corners(x.column("ca")), _corners(x.column("cb")))
                ok = _able(x.column("na").to_numpy(), x.column("nb").to_numpy(), common, percent)
                yield x.select(["pivot", "a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(keep, "pivot long, a long, b long")


def _met(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """Pairs of boxes of one pivot whose sizes allow a link and which are not of one component."""
    sizes = (F.col("a.low") * percent <= F.col("b.high") * 100) & (F.col("b.low") * percent <= F.col("a.high") * 100)
    same = F.coalesce(F.col("a.c") == F.col("b.c"), F.lit(False))
    return a.alias("a").join(b.hint("merge").alias("b"), (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.no") <= F.col("b.no")) & sizes & ~same)


def _tree_pairs(points: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b), nodes of one pivot and of different components whose counts leave a link possible; the written tables behind it.

    points: (pivot, node, n, c: component, counts, place)."""
    numbered, placed = ranked(points, "pivot", [F.col("place"), F.col("node")])
    levels = [written(_pages(numbered), "pages")]
    used = [placed, *levels]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) >= FAN:
        levels.append(written(_boxes(levels[-1]), "boxes"))
        used.append(levels[-1])
    said = [F.col("a.pivot").alias("pivot"), F.col("a.no").alias("a"), F.col("b.no").alias("b"), F.col("a.corner").alias("ca"), F.col("b.corner").alias("cb"), F.col("a.low").alias("na"), F.col("b.low").alias("nb")]
    pairs = _possible(_met(levels[-1], levels[-1], percent).select(*said), percent)
    for below in levels[-2::-1]:
        pairs = written(pairs, "box_pairs")
        used.append(pairs)
        own = below.select(F.col("pivot").alias("p"), F.expr(f"no div {FAN}").alias("up"), F.struct("no", "low", "high", "corner", "c").alias("x")).hint("merge")
        left = pairs.join(own.select(F.col("p").alias("pivot"), F.col("up").alias("a"), F.col("x").alias("xa")), ["pivot", "a"])
        both = left.join(own.select(F.col("p").alias("pivot"), F.col("up").alias("b"), F.col("x").alias("xb")), ["pivot", "b"])
        sizes = (F.col("xa.low") * percent <= F.col("xb.high") * 100) & (F.col("xb.low") * percent <= F.col("xa.high") * 100)
        both = both.filter((F.col("xa.no") <= F.col("xb.no")) & sizes & ~F.coalesce(F.col("xa.c") == F.col("xb.c"), F.lit(False)))
        pairs = _possible(both.select("pivot", F.col("xa.no").alias("a"), F.col("xb.no").alias("b"), F.col("xa.corner").alias("ca"), F.col("xb.corner").alias("cb"), F.col("xa.low").alias("na"), F.col("xb.low").alias("nb")), percent)
    page = levels[0].select("pivot", "no", F.struct("nodes", "ns", "cs", "counts").alias("x")).hint("merge")
    both = pairs.join(page.withColumnsRenamed({"no": "a", "x": "xa"}), ["pivot", "a"]).join(page.withColumnsRenamed({"no": "b", "x": "xb"}), ["pivot", "b"])

    def held(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(x["nodes"]), np.array(x["ns"]), np.array(x["cs"]), np.frombuffer(x["counts"], np.uint8).reshape(len(x["ns"]), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, a, b = batch.slice(at, 64), [], []
                for x, y in zip(part.column("xa").to_pylist(), part.column("xb").to_pylist(), strict=True):
                    (i, n, c, v), (j, m, d, w) = held(x), held(y)
                    common = minima(v[:, None, :], w[None, :, :])
                    ok = _able(n[:, None], m[None, :], common, percent) & (c[:, None] != d[None, :]) & (i[:, None] != j[None, :])
                    r, s = np.nonzero(ok)
                    a.append(np.minimum(i[r], j[s]))
                    b.append(np.maximum(i[r], j[s]))
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return both.select("xa", "xb").mapInArrow(compare, "a long, b long").distinct(), used


def jaccard_components(df: DataFrame, words: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included).

    Documents link if 100 * |intersection| >= threshold_percent * |union|.
    """
    t = threshold_percent
    docs = written(_points(df, words, t, _frequent(df, words, text), doc_id, text), "points")
    # Equal sets are one node; the document of the least id stands for it. Written, nodes keep their numbers.
    nodes = docs.filter("n > 0 and id is not null").groupBy("set").agg(F.min(F.struct("id", "h")).alias("doc"), *[F.first(c).alias(c) for c in ("n", "counts", "fine", "first")])
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "doc.id", "doc.h", "n", "counts", "fine", "first"), "nodes")
    branches = nodes.select("node", "id", F.explode("first").alias("branch"))
    least = branches.groupBy("branch").agg(F.min_by("node", "id").alias("pivot"), F.count(F.lit(1)).alias("met")).filter("met > 1").select("branch", "pivot")
    held = written(branches.join(least, "branch").filter("node <> pivot").select("node", "pivot").distinct(), "held")
    # First each node against one of its branches' least ones, that of the least id with which a link is possible.
    able = _bounded(held.select(F.col("node").alias("a"), F.col("pivot").alias("b")), nodes, t, "able")
    name = nodes.select(F.col("node").alias("b"), "id")
    stars = written(able.join(name, "b").groupBy("a").agg(F.min_by("b", "id").alias("b")), "stars")
    linked = F.expr(f"100 * common >= {t} * (na + nb - common)")
    edges = written(_verified(df, stars, nodes, words, doc_id, text, t).filter(linked).select("a", "b"), "linked")
    comps = written(components(edges), "components")
    # What that did not connect, by the tree of each branch's nodes, its least one among them.
    c = comps.select(F.col("id").alias("node"), F.col("component").alias("c"))
    pc = comps.select(F.col("id").alias("pivot"), F.col("component").alias("pc"))
    own = held.select("pivot").distinct().select(F.col("pivot").alias("node"), "pivot")
    met = held.unionByName(own).join(c, "node", "left").join(pc, "pivot", "left").select("node", "pivot", F.coalesce("c", "node").alias("c"), F.coalesce("pc", "pivot").alias("pc"))
    met = written(met, "met")
    stray = met.groupBy("pivot").agg(F.max((F.col("c") != F.col("pc")).cast("int")).alias("s")).filter("s = 1").select("pivot")
    inside = met.join(stray, "pivot", "left_semi").select("pivot", "node", "c").join(nodes.select("node", "n", "counts").hint("merge"), "node")
    points = written(_order(inside), "placed_points")
    near, used = _tree_pairs(points, t)
    near = written(near, "near")
    late = _bounded(near, nodes, t, "late")
    more = _verified(df, late, nodes, words, doc_id, text, t).filter(linked).select("a", "b")
    final = components(edges.unionByName(more))
    # A component is named by its least id.
    of = nodes.select("node", "set", "id").join(final.withColumnRenamed("id", "node"), "node", "left").select("set", "id", F.coalesce("component", "node").alias("c"))
    of = written(of, "of")
    named = written(of.join(of.groupBy("c").agg(F.min("id").alias("component")), "c").select("set", "component"), "named")
    # Both sides are read from files, so that Spark can split a set that a large share of the rows has.
    found = docs.filter("n > 0").select("id", "n", "set").join(named, "set", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    empty = docs.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    discard(nodes, held, able, stars, edges, comps, met, points, near, late, of, *used)
    return found.unionByName(empty).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _verified(df: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, doc_id: str, text: str, percent: int) -> DataFrame:
    """pairs (a, b) with na, nb and common, counted on the full sets of the documents that stand for them."""
    due = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id", "h"), "node")
    sets = written(_full_sets(df, due, words, doc_id, text), "full")
    out = written(_common(pairs, sets, percent), "verified")
    discard(sets)
    return out
