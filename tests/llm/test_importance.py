"""Importance resampling against a slow version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gustframe.llm import importance, queries
from tests.llm.helpers import ODD, SF, documents, prose, table

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    w = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def _slowly(rows, target, percent=5, least=20, seed=42):
    s, t, own = [0] * 10_000, [0] * 10_000, []
    for i, text in rows:
        w, f = _features(text)
        own.append((i, len(w), [_bucket(x) for x in f]))
        for b in own[-1][2]:
            s[b] += 1
    for text in target:
        for f in _features(text)[1]:
            t[_bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


def test_query_like_slow_version(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    slow = _slowly([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])
    assert sorted(map(tuple, queries.op11_resample(spark, SF).collect())) == slow


def test_odd_texts_and_other_columns(spark):
    dice = random.Random(1)
    texts = [*ODD, "A-b_c.d", "ÄÖ x" * 30, "w" * 70 + " " + "é" * 50 + " end", *[prose(dice, dice.randrange(60)) for _ in range(60)]]
    texts += texts[:5]
    df = documents(spark, texts).withColumns({"words": F.lit(1), "score": F.lit("s"), "weight": F.lit(0), "t": F.lit(0)})
    target = spark.createDataFrame([(prose(dice, 40), 1), (None, 2), ("", 3)], "text string, t int")
    got = sorted(map(tuple, importance.resample(df, target, percent=30, least_words=5).collect()))
    assert got == _slowly(list(enumerate(texts)), [r["text"] for r in target.collect()], 30, 5)


def test_where_the_head_ends_changes_nothing(spark, monkeypatch):
    dice = random.Random(2)
    df, target = documents(spark, [prose(dice, 50) for _ in range(40)]), documents(spark, [prose(dice, 30)])
    whole = sorted(map(tuple, importance.resample(df, target, 20).collect()))
    monkeypatch.setattr(importance, "HEAD_WORDS", 0)
    assert whole == sorted(map(tuple, importance.resample(df, target, 20).collect()))


def test_states_are_crcs():
    dice = random.Random(3)
    words = [bytes(dice.choice(b"abc\xc3\xa9") for _ in range(dice.choice([1, 3, 9, 63, 64, 65, 200]))) for _ in range(60)]
    head = importance.Head(sorted(set(words[:20])), [(0, 1), (0, 2), (1, 3)])
    states, of = importance.Hasher(head).states(words, np.array([0, 1, 40, 0, 2, 17, 0]))
    want, at = [[], [], []], 0
    for text, n in enumerate([0, 1, 40, 0, 2, 17, 0]):
        for k in (1, 2, 3):
            want[k - 1] += [(zlib.crc32(b" ".join(words[at + i : at + i + k])), text) for i in range(n - k + 1)]
        at += n
    assert list(zip(states.tolist(), of.tolist(), strict=True)) == sum(want, [])
    for n in (0, 1, 2):
        assert importance.Hasher(head).states(words[:n], np.array([n]))[0].tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(n - k + 1)]


def test_ties_go_to_the_smaller_id_and_null_ids_come_last(spark):
    text = "one two three four five six"
    rows = [(i, text) for i in range(3000)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), documents(spark, [text]), percent=50, least_words=3).collect()
    slow = _slowly(rows, [text], 50, 3)
    assert len({r[3] for r in slow}) < 3000
    assert sorted(map(tuple, got)) == slow
    odd = spark.createDataFrame([(i, text) for i in (5, 3, None, None, 3)], "doc_id long, text string")
    got = importance.resample(odd, odd, percent=100, least_words=3).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert sorted(r["score"] for r in got if r["doc_id"] is None)[0] == got[0]["weight"] + importance.gumbel(42, None)


def test_empty_tables(spark):
    df = documents(spark, ["a b c"])
    assert importance.resample(df.limit(0), df).collect() == []
    assert [r["rank"] for r in importance.resample(df, df.limit(0), percent=100, least_words=1).collect()] == [1]


def test_a_summary_keeps_what_is_frequent(spark):
    dice = random.Random(4)
    df = documents(spark, [prose(dice, 200) + " hot pair" * 40 for _ in range(30)]).coalesce(1)
    held = importance.head(df, summary=50).value
    assert b"hot" in held.words
    assert (held.keys != np.uint64(2**64 - 1)).sum() <= 50
    a, b = (held.words[w] >> 32 for w in (b"hot", b"pair"))
    assert (a - 1) * importance.HEAD_WORDS + b - 1 in held.keys.tolist()
