"""The Merkle manifest against a slow version, and what tampering does to it."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gustframe.llm import merkle, queries
from tests.llm.helpers import SF, documents, table


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(leaves):
    """The top and, for each leaf, the pairs of what stands left and right of it on each level."""
    paths, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for p, k in zip(paths, at, strict=True):
            run = now[k // 3 * 3 : k // 3 * 3 + 3]
            p.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        at, now = [k // 3 for k in at], [_h("".join(now[i : i + 3])) for i in range(0, len(now), 3)]
    return now[0], paths


def _slowly(rows):
    """(order, source, leaf) -> (order, source, leaf, subroot, root, path)."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: _tree([r[2] for r in by[s]]) for s in sources}
    root, upper = _tree([tops[s][0] for s in sources])
    return [(*r, tops[s][0], root, [*p, *upper[i]]) for i, s in enumerate(sources) for r, p in zip(by[s], tops[s][1], strict=True)]


def _key(r):
    return (r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0, r[2])


@pytest.mark.parametrize("sizes", [[1], [3, 1], [10, 1, 28], [2300, 5, 730, 1, 729]])
def test_like_slow_version(spark, sizes):
    names = [None, "b", "é", "z", "😀"]
    rows = [(100 * k + i, names[k], _h(f"{k}:{i}")) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5)
    got = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=_key) == sorted(_slowly(rows), key=_key)


def test_query_like_slow_version(spark):
    docs = table(spark, "documents").collect()

    def leaf(r, text):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    slow = {}
    new = {r["doc_id"]: leaf(r, r["text"].replace("\n", "") if r["text"] and not zlib.crc32(str(r["doc_id"]).encode()) % 2 else r["text"]) for r in docs}
    for doc_id, _, own, subroot, root, path in _slowly([(r["doc_id"], r["source"], leaf(r, r["text"])) for r in docs]):
        h = new[doc_id]
        for a, b in path:
            h = _h(a + h + b)
        slow[doc_id] = (own, subroot, root, _h("".join(a + b for a, b in path)), h, h == root)
    got = queries.op13_merkle(spark, SF).collect()
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got} == slow
    assert len(got) == len(docs) and 0 < sum(not r["verified"] for r in got) < len(docs)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(None, None, "x"), (None, None, "x"), (1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "", "z")]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "doc_id long, source string, leaf string, rank int, total int, path string")
    got = merkle.manifest(df, keep=["rank"])
    back = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in got.collect()]
    assert sorted(back, key=lambda r: (_key(r), r[5])) == sorted(_slowly(rows), key=lambda r: (_key(r), r[5]))
    assert all(r["rank"] == 1 for r in got.collect())
    assert merkle.manifest(df.limit(0)).collect() == []


def test_any_change_is_seen(spark):
    docs = documents(spark, ["a\nb", "", None, "c"]).withColumn("source", F.lit("s"))
    made = merkle.manifest(docs.select("doc_id", "source", "text", merkle.leaf(a=F.col("doc_id"), b=F.col("text")).alias("leaf")), keep=["text"])
    same = merkle.folded(merkle.leaf(a=F.col("doc_id"), b=F.col("text")), "path") == F.col("root")
    other = merkle.folded(merkle.leaf(a=F.col("doc_id"), b=F.coalesce(F.concat("text", F.lit(" ")), F.lit(""))), "path") == F.col("root")
    assert [(r[0], r[1]) for r in made.select(same, other).collect()] == [(True, False)] * 4
