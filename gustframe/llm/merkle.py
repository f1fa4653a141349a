"""Merkle manifest of a dataset: one digest for all rows, and for each row the proof that it is among them.

The leaves of a source are ranked by their order. A node is labelled by the interval of leaf ranks that it covers, [lo, hi]: an
ancestor is a node whose interval contains another's, and what is left of a parent's interval without one's own holds the siblings.
While a source has more than one node, every `ARITY` consecutive ones (the last ones: fewer, even one) become their digest. What
remains is the source's subroot; subroots, ordered by source, give the root in the same way.

Levels are dealt with in buckets of `BUCKET_LEVELS`: a bucket's node covers ARITY ** BUCKET_LEVELS (729) nodes of the bucket below, which
are folded in one row, so a source of any size is spread over the tasks and needs one exchange for each bucket. On the way down each
bucket joins its parents' labels by containment and takes their path; leaves meet only the path of their own row of 729.

Nulls: a field that is null counts as "-", a null source is a source and comes first, rows without an order come first in their source.
Empty texts are values. Repeated rows are leaves of their own; of leaves with one place in the order that of the smaller digest comes
first. An empty table has no rows, so no root. Texts are read whole, by one hash. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.llm.shared import discard, ranked, written

#: Children of a node.
ARITY = 3
#: Levels that one row folds: 3 ** 6 nodes.
BUCKET_LEVELS = 6


def digest(*fields: Column) -> Column:
    """sha256 of the fields in a row, as lower-case hexadecimal digits."""
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def leaf(**fields: Column) -> Column:
    """The digest of a row: each field as its length in UTF-8 bytes, a colon and its value; null as "-"."""
    texts = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(own: Column | str, path: Column | str) -> Column:
    """The root that a leaf has by its path; another than the manifest's tells that the leaf or the path was changed."""
    return F.aggregate(path, F.col(own) if isinstance(own, str) else own, lambda h, step: digest(step["left"], h, step["right"]))


def proof(path: Column | str) -> Column:
    """The siblings of a path as one digest, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _said(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["h"]), "")


def _parents(nodes: Column) -> Column:
    """The level above: intervals and digests of every ARITY nodes."""

    def parent(k: Column) -> Column:
        return _let(F.slice(nodes, k * ARITY + 1, F.lit(ARITY)), lambda c: F.struct(F.element_at(c, 1)["lo"].alias("lo"), F.element_at(c, -1)["hi"].alias("hi"), F.sha2(_said(c).cast("binary"), 256).alias("h")))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(ARITY)).cast("int")), parent)


def _with_levels(nodes: Column, deep: Column, body: Callable[[list[Column]], Column]) -> Column:
    """body of a bucket's levels, from its nodes to its top; levels beyond `deep` repeat the one below."""

    def climb(levels: list[Column]) -> Column:
        if len(levels) > BUCKET_LEVELS:
            return body(levels)
        below = levels[-1]
        return _let(F.when(deep >= len(levels), _parents(below)).otherwise(below), lambda a: climb([*levels, a]))

    return _let(nodes, lambda a: climb([a]))


def _nodes() -> Column:
    return F.transform("held", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["h"].alias("h")))


def _top(deep: Column) -> Column:
    return _with_levels(_nodes(), deep, lambda levels: F.element_at(levels[-1], 1))


def _paths(deep: Column) -> Column:
    """For each node of a bucket its siblings, level by level up to the bucket's top."""

    def step(levels: list[Column], j: Column, k: int) -> Column:
        at = F.floor(j / F.lit(ARITY**k)).cast("int")
        run = F.floor(at / F.lit(ARITY)).cast("int") * ARITY + 1
        own, family = F.get(levels[k], at), F.slice(levels[k], run, F.lit(ARITY))
        # The parent's interval without one's own: what ends before it and what begins after it.
        return F.when(
            deep > k,
            _let(own, lambda o: F.struct(_said(F.filter(family, lambda x: x["hi"] < o["lo"])).alias("left"), _said(F.filter(family, lambda x: x["lo"] > o["hi"])).alias("right"))),
        )

    def all_of(levels: list[Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(levels[0]) - 1), lambda j: F.array_compact(F.array(*[step(levels, j, k) for k in range(BUCKET_LEVELS)])))

    return _with_levels(_nodes(), deep, all_of)


def _depth(total: Column) -> Column:
    """Levels above the leaves: the least d with ARITY ** d >= total."""
    powers = F.array(*[F.lit(ARITY**d).cast("long") for d in range(40) if ARITY**d < 2**63])
    return F.size(F.filter(powers, lambda p: p < total))


class _Tree:
    """Trees over ranked leaves (tree, rank, total, h, more): a written table for each bucket of levels, from below, and `tops`
    (tree, h), the node that remains of each."""

    def __init__(self, leaves: DataFrame, more: list[str]) -> None:
        most = leaves.agg(F.max("total")).first()[0] or 0
        deepest = next(d for d in range(41) if ARITY**d >= most)
        rows = leaves.select("tree", "total", F.col("rank").alias("at"), F.struct(F.col("rank").alias("lo"), F.col("rank").alias("hi"), "h", *more).alias("x"))
        self.buckets: list[DataFrame] = []
        for i in range(max(1, -(-deepest // BUCKET_LEVELS))):
            box = F.expr(f"at div {ARITY**BUCKET_LEVELS}")
            held = rows.groupBy("tree", "total", box.alias("box")).agg(F.array_sort(F.collect_list("x")).alias("held"))
            bucket = written(held.withColumn("deep", F.greatest(_depth(F.col("total")) - i * BUCKET_LEVELS, F.lit(0))), "levels")
            self.buckets.append(bucket)
            rows = bucket.select("tree", "total", F.col("box").alias("at"), _top(F.col("deep")).alias("x"))
        self.tops = rows.select("tree", F.col("x.h").alias("h"))

    def down(self, path: DataFrame, more: list[str]) -> DataFrame:
        """(tree, path, x: the struct of a leaf, more) for each leaf: what path (tree, path, more) has for its tree, below it the
        path inside the tree."""
        above = path.withColumn("box", F.lit(0).cast("long"))
        for bucket in reversed(self.buckets):
            a = above.select(F.col("tree").alias("__tree"), F.col("box").alias("__box"), F.col("path").alias("__path"), *more)
            joined = bucket.join(a, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("box") == F.col("__box")))
            each = joined.select("tree", "__path", *more, F.explode(F.arrays_zip(F.col("held").alias("x"), _paths(F.col("deep")).alias("own"))).alias("e"))
            each = each.select("tree", F.concat("e.own", "__path").alias("path"), F.col("e.x").alias("x"), *more)
            above = each.select("tree", F.expr(f"x.lo div {ARITY**BUCKET_LEVELS}").alias("box"), "path", *more) if bucket is not self.buckets[0] else each
        return above


def manifest(df: DataFrame, h: str = "leaf", by: str = "source", order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(order, by, h, keep, subroot, root, path) for each row of df, whose digest is in column h.

    path: the siblings (left, right: digests joined) on each level from the leaf to the root, for folded() and proof().
    """
    keep = keep or []
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = written(df.select(F.col(by).alias("tree"), F.col(order).alias("o"), F.col(h).alias("h"), *own), "leaves")
    numbered, placed = ranked(rows, "tree", [F.col("o").asc_nulls_first(), F.col("h")])
    more = ["o", *[f"k{i}" for i in range(len(keep))]]
    tree = _Tree(numbered, more)
    tops = written(tree.tops.withColumn("all", F.lit(0)), "tops")
    sources, ordered = ranked(tops, "all", [F.col("tree").asc_nulls_first()])
    upper = _Tree(sources.select(F.col("all").alias("tree"), "rank", "total", "h", F.col("tree").alias("source")), ["source"])
    root = upper.tops.select("tree", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"), F.col("h").alias("root"))
    roots = upper.down(root, ["root"]).select(F.col("x.source").alias("tree"), "path", "root", F.col("x.h").alias("subroot"))
    roots = written(roots, "roots")
    out = tree.down(roots, ["root", "subroot"])
    discard(rows, placed, tops, ordered, *upper.buckets)
    return out.select(F.col("x.o").alias(order), F.col("tree").alias(by), F.col("x.h").alias(h), *[F.col(f"x.k{i}").alias(c) for i, c in enumerate(keep)], "subroot", "root", "path")
