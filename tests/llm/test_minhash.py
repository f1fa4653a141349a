"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gustframe.llm import minhash
from tests.llm.helpers import ODD, WORDS, documents, prose


def _shingles(text, words):
    w = minhash.words_of(text)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def _slowly(texts, words):
    sets, comp = [_shingles(t, words) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


def _group(dice, size, words, most):
    """Copies of one text with up to `most` words replaced, each from the text or from a copy before it."""
    out = [prose(dice, words).split()]
    for _ in range(size - 1):
        own = list(dice.choice(out))
        for _ in range(dice.randrange(most + 1)):
            own[dice.randrange(len(own))] = dice.choice(WORDS)
        out.append(own)
    return [" ".join(x) for x in out]


def test_like_all_pairs(spark):
    dice = random.Random(5)
    texts = [*_group(dice, 40, 90, 3), *_group(dice, 25, 60, 5), *_group(dice, 12, 200, 2), *[prose(dice, 40) for _ in range(20)], *ODD, "a b", "A  b", "a b c", "same", "same"]
    dice.shuffle(texts)
    for words in (4, 5):
        got = sorted(map(tuple, minhash.near_duplicates(documents(spark, texts), words=words).collect()))
        assert got == _slowly(texts, words)


def test_a_star_that_its_first_node_does_not_hold_together(spark):
    """Copies far from the least one, whose buckets they share, but near each other."""
    dice = random.Random(6)
    base = prose(dice, 120).split()
    far = list(base)
    for p in range(0, 120, 24):
        far[p] = "other"
    texts = [" ".join(base)]
    for k in range(30):
        own = list(far)
        own[7 + 3 * k] = f"w{k}"
        texts.append(" ".join(own))
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, texts), words=4).collect()))
    assert got == _slowly(texts, 4)


def test_signature_is_the_least_of_shifted_places():
    h = minhash.shingle_hashes(prose(random.Random(7), 50), 4)
    ring = (minhash._mixed(h.copy()) >> np.uint64(32)).astype(np.uint32)
    slow = [min(int(minhash._pi(np.array([(int(x) + k) % 2**32], np.uint32))[0]) for x in ring) for k in range(20)]
    assert minhash.signature(h, 20).tolist() == slow


@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
@settings(max_examples=5, deadline=None)
def test_components_like_union(spark, edges):
    best = {x: x for e in edges for x in e}
    for _ in best:
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges or [(1, 1)], "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in best.items())


def test_rows_without_id_and_repeated_ids(spark):
    text = prose(random.Random(8), 30)
    df = spark.createDataFrame([(3, text, 1), (3, text, 1), (None, text, 2), (None, "alone here", 3), (7, text, 4)], "doc_id long, text string, n long")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, False), (-1, 3, False), (3, 3, True), (3, 3, True), (7, 3, False)]
    kept = minhash.deduplicated(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(-1, text), (-1, "alone here"), (3, text)])
    assert minhash.deduplicated(df.limit(0)).columns == df.columns


def test_one_id_with_two_texts_are_two_documents(spark):
    dice = random.Random(9)
    x, y = prose(dice, 40), prose(dice, 40)
    near = " ".join(["other", *x.split()[1:]])
    df = spark.createDataFrame([(1, x), (5, x), (5, y), (6, near)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.deduplicated(df).collect())) == [(1, x), (5, y)]
    near_only = spark.createDataFrame([(1, x), (5, near), (5, y)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.deduplicated(near_only).collect())) == [(1, x), (5, y)]


def test_other_columns_may_have_the_names_used_inside(spark):
    text = prose(random.Random(10), 30)
    df = spark.createDataFrame([(1, text, 1, 2, 3, b"", 5), (2, text, 1, 2, 3, b"", 5)], "doc_id long, text string, id int, h int, n int, set binary, component int")
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_long_and_repeated_words(spark):
    texts = ["word " * 20000, "word " * 30000, "a b " * 5000, " ".join(map(str, range(30000))), " ".join(map(str, range(29990)))]
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, texts), words=4).collect()))
    assert got == _slowly(texts, 4)
