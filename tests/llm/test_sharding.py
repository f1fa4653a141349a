"""The external shuffle's laws."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from gustframe.llm import sharding
from tests.llm.helpers import ODD, documents


def _lawful(rows, shards):
    by = Counter(r["shard"] for r in rows)
    assert max(by.values()) - min([by.get(s, 0) for s in range(shards)]) <= 1
    for s, n in by.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_laws_and_that_the_seed_decides(spark):
    df = documents(spark, [f"text {i} " + "x" * (i * 7 % 200) for i in range(1003)])
    one = sharding.external_shuffle(df, 8, seed=1, bucket_bytes=4096).collect()
    again = sharding.external_shuffle(df.repartition(7), 8, seed=1, bucket_bytes=4096).collect()
    other = sharding.external_shuffle(df, 8, seed=2, bucket_bytes=4096).collect()
    _lawful(one, 8)
    assert sorted(r["doc_id"] for r in one) == list(range(1003))
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in one}
    assert place == {r["doc_id"]: (r["shard"], r["slot"]) for r in again}
    assert place != {r["doc_id"]: (r["shard"], r["slot"]) for r in other}
    # Neighbours in the input are no neighbours in the output.
    line = [r["doc_id"] for r in sorted(one, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(abs(a - b) == 1 for a, b in zip(line, line[1:], strict=False)) < 20


def test_equal_rows_do_not_overfill_a_bucket(spark):
    df = spark.createDataFrame([(None, "copy " * 20)] * 600 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = sharding.external_shuffle(df, 4, bucket_bytes=2048)
    rows = got.collect()
    _lawful(rows, 4)
    assert len(rows) == 700
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 120


def test_like_a_shuffle_by_hand(spark):
    """The same order from hashes that Spark gives, with buckets and Fisher-Yates written out."""
    df = documents(spark, [f"text {i}" * (i % 9 + 1) for i in range(300)])
    hashed = df.select("doc_id", F.xxhash64(F.lit(5), *df.columns).alias("h"), F.xxhash64(F.lit("5+"), *df.columns).alias("h2")).collect()
    size = sum(16 * 3 + len(f"text {i}" * (i % 9 + 1)) + len("own") for i in range(300))
    buckets = -(-size // 2000)
    line = []
    for b in range(buckets):
        own = [r["doc_id"] for r in sorted((r for r in hashed if r["h"] % buckets == b), key=lambda r: (r["h"], r["h2"]))]
        dice = random.Random(f"5:{b}")
        for i in reversed(range(1, len(own))):
            j = dice.randrange(i + 1)
            own[i], own[j] = own[j], own[i]
        line += own
    got = sharding.external_shuffle(df, 4, seed=5, bucket_bytes=2000).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == line
    assert [(r["shard"], r["slot"]) for r in got] == [(i // 75, i % 75) for i in range(300)]


def test_the_order_does_not_depend_on_settings_files_or_copies(spark):
    df = spark.createDataFrame([(1, "copy " * 40)] * 300 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")

    def order(frame):
        return [r["doc_id"] for r in sharding.external_shuffle(frame, 3, bucket_bytes=1024).orderBy("shard", "slot").collect()]

    one = order(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert order(df.repartition(7)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_other_columns_of_any_type_and_name(spark):
    df = documents(spark, ["a", None, "b"]).selectExpr("*", "1 as shard", "2 as slot", "3 as row", "4 as h", "5 as bucket", "map('k', doc_id) as m", "array(doc_id) as l", "null as none", "6 as b")
    got = sharding.external_shuffle(df, 2, bucket_bytes=64)
    assert got.columns == [*(c for c in df.columns if c not in ("shard", "slot")), "shard", "slot"]
    assert sorted((r["doc_id"], r["m"]["k"], r["l"][0], r["row"]) for r in got.collect()) == [(i, i, i, 3) for i in range(3)]


def test_odd_rows_and_writing(spark, tmp_path):
    df = documents(spark, [*ODD, "t", "t"]).withColumn("slot_", F.lit(1))
    shuffled = sharding.external_shuffle(df, 3)
    _lawful(shuffled.collect(), 3)
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r["text"]) for r in back.collect()) == sorted(map(str, [*ODD, "t", "t"]))
    assert sharding.external_shuffle(df.limit(0)).count() == 0
