"""Spaced seeds against a comparison of all windows."""

from __future__ import annotations

import itertools
import math
import random
import re

from gustframe.llm import decontam
from tests.llm.helpers import ODD, documents, prose


def _slowly(text, item):
    """Whether 13 words in a row of item (all words of a shorter one) stand in text with at least 80 percent in place."""
    a, b = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (text, item))
    span = min(13, len(b))
    return bool(b) and any(100 * sum(x == y for x, y in zip(a[i : i + span], b[j : j + span], strict=True)) >= 80 * span for i, j in itertools.product(range(len(a) - span + 1), range(len(b) - span + 1)))


def _found(marked):
    return {r["doc_id"]: sorted(o["item_id"] for o in r["overlaps"]) for r in marked.collect()}


def test_masks_survive_all_substitutions_that_may_be():
    for n in range(1, 14):
        for hit in itertools.combinations(range(n), n - math.ceil(n * 0.8)):
            assert any(not {o + s for o in m} & set(hit) for m in decontam.masks_for(n) for s in range(n - m[-1])), (n, hit)
    assert decontam.masks_for(99) == decontam.MASKS


def test_like_brute_force(spark):
    dice = random.Random(3)
    items = [prose(dice, n) for n in (30, 20, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2)]
    texts = []
    for k in range(150):
        item = items[k % len(items)].split()
        at = dice.randrange(max(1, len(item) - 13))
        piece = item[at : at + 20]
        for p in dice.sample(range(len(piece)), min(len(piece), k // len(items) % 4)):
            piece[p] = "zzz"
        texts.append(prose(dice, dice.randrange(0, 40)) + " " + " ".join(piece) + " " + prose(dice, 5))
    texts += texts[:5]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {i: [j for j, item in enumerate(items) if _slowly(t, item)] for i, t in enumerate(texts)}
    assert _found(decontam.mark(documents(spark, texts), benchmark)) == want
    assert any(want.values()) and not all(want.values())
    kept = {r["doc_id"] for r in decontam.clean(documents(spark, texts), benchmark).collect()}
    assert kept == {i for i, found in want.items() if not found}


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    dice = random.Random(4)
    items = [prose(dice, 20) for _ in range(12)]
    docs = documents(spark, [f"{prose(dice, 9)} {t} {prose(dice, 9)}" for t in items])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_OVERLAPS", 0)
    assert _found(decontam.mark(docs, benchmark)) == {i: [i] for i in range(12)}
    assert decontam.clean(docs, benchmark).count() == 0


def test_a_line_that_many_items_share(spark, monkeypatch):
    """Texts that quote it are compared once where any overlap will do, and with all items in rows of a few otherwise."""
    dice = random.Random(9)
    line = prose(dice, 15)
    items = [f"{line} q{i}a q{i}b q{i}c q{i}d" for i in range(300)]
    texts = [f"{prose(dice, 9)} d{i} {line} e{i}" for i in range(200)] + [f"{prose(dice, 20)} f{i}" for i in range(50)]
    texts += [" ".join(line.split()[:10]) + f" g{i} h{i} i{i} j{i} k{i}" for i in range(3)]  # a part of the line only
    docs, benchmark = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    made = []

    def counted(df, name, write=decontam.written):
        back = write(df, name)
        made.append((name, back.count()))
        return back

    monkeypatch.setattr(decontam, "written", counted)
    kept = {r["doc_id"] for r in decontam.clean(docs, benchmark).collect()}
    assert kept == set(range(200, 253)) == {i for i, t in enumerate(texts) if not _slowly(t, items[0])}
    assert sum(n for name, n in made if name == "pairs") < 200 * 5 + 3 * len(items) + 1
    monkeypatch.setattr(decontam, "ITEMS_A_ROW", 7)
    marked = _found(decontam.mark(docs.filter("doc_id < 5 or doc_id >= 250"), benchmark))
    assert {k: len(v) for k, v in marked.items() if v} == dict.fromkeys(range(5), 300)


def test_odd_rows_and_names(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as row", "2 as k1", "3 as overlaps", "4 as items")
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g"), (4, "x"), (4, "x")], "item_id long, text string")
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1
    assert decontam.clean(docs, benchmark.limit(0)).count() == len(ODD)
    marked = decontam.mark(docs, benchmark)
    assert marked.columns == [*(c for c in docs.columns if c != "overlaps"), "overlaps"]
    assert {k: v for k, v in _found(marked).items() if v} == {ODD.index("x"): [4, 4]}
    assert decontam.mark(docs.limit(0), benchmark).count() == 0


def test_repeated_words_take_linear_memory_and_end_early():
    many = decontam.hashed_words("word " * 20000)
    got = decontam.overlap(many, decontam.hashed_words("word " * 2000))
    assert (got["start"], got["end"], got["matched"]) == (0, 2000, 2000)
    long = decontam.hashed_words(" ".join(map(str, range(100000))) + " the passage that was asked for in the benchmark by someone long ago today")
    got = decontam.overlap(long, decontam.hashed_words("the passage that was asked for in the benchmark by someone long ago today"))
    assert (got["start"], got["matched"]) == (100000, 14)
