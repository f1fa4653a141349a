"""Locally consistent parsing: equal stretches, edited texts, order."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gustframe.llm import lcp
from tests.llm.helpers import ODD, documents, prose


@given(st.text(min_size=400, max_size=500), st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_equal_stretches_share_interior_phrases(middle, before, after):
    def names(text):
        x = lcp._mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + lcp._A)
        return lcp._level(x, np.array([0]))[0].tolist()

    alone, within = names(middle), names(before + middle + after)
    inner = alone[8:-8]
    assert any(within[i : i + len(inner)] == inner for i in range(len(within) - len(inner) + 1))


def test_texts_parsed_together_are_parsed_alike():
    dice = random.Random(10)
    texts = [prose(dice, dice.randrange(0, 300)) for _ in range(50)] + ["", "a", "aa", "a" * 700, "ab" * 300]
    together = lcp.fingerprints(texts)
    assert all((lcp.fingerprints([t])[0] == f).all() for t, f in zip(texts, together, strict=True))


def test_likeness_follows_what_is_shared():
    dice = random.Random(11)
    a = [prose(dice, 400) for _ in range(20)]
    shifted = [f"{prose(dice, 3)} {t}" for t in a]
    fa, fs = lcp.fingerprints(a), lcp.fingerprints(shifted)
    assert lcp.likeness(fa, fs).mean() > 0.85
    assert lcp.likeness(fa, np.roll(fa, 1, 0)).mean() < 0.2
    assert (lcp.likeness(fa, fa) == 1).all()


M = (1 << 64) - 1


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _slow_level(names):
    """Phrases of one text, a name at a time."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    plain = [x if n == 1 else _mixed((x + 0x9E3779B97F4A7C15 * n) & M) for x, n in runs]
    x = [v ^ 1 if i and v == plain[i - 1] and len(plain) < len(names) else v for i, v in enumerate(plain)]
    label, bits = x, 64
    for _ in range(4):
        tossed = []
        for i, v in enumerate(label):
            other = label[i - 1] if i else ~v & ((1 << bits) - 1)
            place = next(k for k in range(bits) if (v ^ other) >> k & 1)
            tossed.append(2 * place + (v >> place & 1))
        label, bits = tossed, 8
    cuts = [i for i in range(len(x)) if i == 0 or i < len(x) - 1 and label[i - 1] > label[i] < label[i + 1]]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
        out.append(_mixed(sum(_mixed((x[i] + 0x94D049BB133111EB * (i - a + 1)) & M) for i in range(a, b)) & M))
    return out


def _slow_print(text):
    bins = [0] * 128
    names, least = [_mixed((ord(c) + 0x9E3779B97F4A7C15) & M) for c in text], {}
    for level in range(1, 5):
        names = _slow_level(names) if names else []
        if level > 1:
            for v in names:
                v = _mixed((v + level) & M)
                least[v % 128] = min(least.get(v % 128, M), v)
    for b, v in least.items():
        bins[b] = (v >> 40) % 255 + 1
    return bytes(bins).hex()


def _slow_likeness(a, b):
    pairs = [(a[i : i + 2], b[i : i + 2]) for i in range(0, 256, 2)]
    used = [p for p in pairs if p != ("00", "00")]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def _check(spark, texts, **how):
    got = {r["doc_id"]: r for r in lcp.fingerprint_with_next(documents(spark, texts), **how).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(t or "" for t in texts):
        following = texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, other = map(_slow_print, (t, edited, following))
        r = got[i]
        assert r["edited"] == edited and r["n_chars"] == len(t)
        assert r["fingerprint"] == own and r["edited_fingerprint"] == changed
        assert r["near_edited"] == _slow_likeness(own, changed) and r["near_next"] == _slow_likeness(own, other)


def test_like_brute_force(spark):
    dice = random.Random(12)
    texts = [*[prose(dice, dice.randrange(1, 120)) for _ in range(50)], *ODD, "same", "same", "ab" * 300, "a" * 700]
    _check(spark, texts)
    _check(spark, texts, range_bytes=4000)  # many ranges
    _check(spark, ["only one"])


def test_texts_longer_than_what_is_parsed_at_a_time(spark, monkeypatch):
    dice = random.Random(13)
    monkeypatch.setattr(lcp, "CHUNK", 1000)
    texts = [prose(dice, n) for n in (10, 900, 5, 5, 400, 1)]
    marks = lcp.fingerprints(texts)
    assert [m.tobytes().hex() for m in marks] == list(map(_slow_print, texts))


def test_keys_of_other_types_and_order(spark):
    texts = [prose(random.Random(i), 30) for i in range(40)]
    keys = sorted(f"k{i * 7919 % 1000}é" for i in range(40))
    df = spark.createDataFrame(list(zip(keys, texts, range(40), strict=True)), "doc_id string, text string, k int").repartition(5)
    got = {r["doc_id"]: r["near_next"] for r in lcp.fingerprint_with_next(df, range_bytes=500).collect()}
    assert got == {k: _slow_likeness(_slow_print(t), _slow_print(texts[(i + 1) % 40])) for i, (k, t) in enumerate(zip(keys, texts, strict=True))}


def test_repeated_keys_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (1, "b"), (None, None), (2**60 + 1, "x"), (2**60, "y")], "doc_id long, text string").selectExpr("*", "1 as k", "2 as b", "3 as fingerprint", "4 as tail")
    for size in (1, 1 << 20):
        assert lcp.fingerprint_with_next(df, range_bytes=size).count() == 7
    assert lcp.fingerprint_with_next(df.limit(0)).count() == 0
