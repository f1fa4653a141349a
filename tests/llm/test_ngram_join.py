"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gustframe.llm import ngram_join
from gustframe.llm.minhash import shingle_hashes
from tests.llm.helpers import ODD, WORDS, documents, prose
from tests.llm.test_minhash import _group, _slowly


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _expected(texts, words):
    return [(i, n, c) for i, n, c, _ in _slowly(texts, words)]


def test_like_all_pairs(spark):
    dice = random.Random(15)
    texts = [*_group(dice, 40, 90, 3), *_group(dice, 25, 60, 5), *_group(dice, 12, 200, 2), *[prose(dice, 40) for _ in range(20)], *ODD, "a b", "A  b", "a b c", "same", "same"]
    # Documents that share a passage but do not link.
    shared = prose(dice, 60)
    texts += [f"{prose(dice, 30)} {shared} {prose(dice, 30)}" for _ in range(30)]
    dice.shuffle(texts)
    for words in (4, 5):
        assert _rows(ngram_join.jaccard_components(documents(spark, texts), words=words)) == _expected(texts, words)


def _stars(dice):
    """Copies far from the least one, whose branches they share, but near each other."""
    base = prose(dice, 120).split()
    far = list(base)
    for p in range(0, 120, 24):
        far[p] = "other"
    texts = [" ".join(base)]
    for k in range(90):
        own = list(far)
        own[7 + k] = f"w{k}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("fan", [2, 4, 32])
def test_what_the_least_one_does_not_hold_together(spark, monkeypatch, fan):
    monkeypatch.setattr(ngram_join, "FAN", fan)
    texts = _stars(random.Random(16))
    assert _rows(ngram_join.jaccard_components(documents(spark, texts), words=4)) == _expected(texts, 4)


def test_chains_just_around_the_threshold(spark):
    """Each text is a step of two or three words from the one before, so that only neighbours link."""
    dice = random.Random(17)
    texts, own = [], prose(dice, 100).split()
    for k in range(120):
        for _ in range(dice.choice([1, 2, 3])):
            own[dice.randrange(100)] = f"n{k}"
        texts.append(" ".join(own))
    dice.shuffle(texts)
    assert _rows(ngram_join.jaccard_components(documents(spark, texts))) == _expected(texts, 5)


def test_odd_rows(spark):
    text = prose(random.Random(18), 30)
    df = spark.createDataFrame([(3, text, 1), (3, text, 1), (None, text, 2), (None, "alone here", 3), (7, text, 4), (8, None, 5)], "doc_id long, text string, node long")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (7, 3), (8, 8)]
    assert ngram_join.jaccard_components(df.limit(0)).collect() == []


@given(st.text(st.sampled_from("ab AÉé\t\n\x0b\x1c\x85\u3000😀"), max_size=40), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_sets_of_bytes_are_sets_of_texts(text, words):
    assert ngram_join.set_of(text.encode(), words).tolist() == shingle_hashes(text, words).tolist()


def test_long_sets_and_finer_counts(spark):
    dice = random.Random(19)
    base = [f"w{dice.randrange(10**6)}" for _ in range(6000)]
    texts = []
    for k in range(12):
        own = list(base) if k < 6 else base[:2500] + [f"x{k}{dice.randrange(10**6)}" for _ in range(2500)]
        for _ in range(k % 6 * 30):
            own[dice.randrange(len(own))] = f"y{k}"
        texts.append(" ".join(own))
    assert _rows(ngram_join.jaccard_components(documents(spark, texts))) == _expected(texts, 5)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.lists(st.integers(0, 40), min_size=1, max_size=40), st.integers(50, 99))
@settings(max_examples=300, deadline=None)
def test_bounds_never_lose_a_link(a, b, percent):
    x, y = (np.unique(shingle_hashes(" ".join(WORDS[i] for i in own), 1)) for own in (a, b))
    common = len(np.intersect1d(x, y))
    known = np.sort(np.concatenate([x[::2], y[::3]]))
    known, size = np.unique(known), np.arange(len(np.unique(known))).astype(np.uint8) % 7
    if 100 * common >= percent * (len(x) + len(y) - common):
        firsts = [set(ngram_join.first_groups(h, percent, known, size).tolist()) for h in (x, y)]
        assert firsts[0] & firsts[1]
        least = np.minimum(ngram_join.counts_of(x), ngram_join.counts_of(y)).sum()
        assert ngram_join._able(np.int64(len(x)), np.int64(len(y)), np.int64(least), percent)
