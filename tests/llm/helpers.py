"""Small tables for the text operators."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "no") for b in ("ra", "si", "to", "ve") for c in ("n", "l", "", "m")]

ODD = [None, "", " ", "\n\n", "x", "é ü 😀  a", "İstanbul ퟿", "a" * 5000]


def prose(dice: random.Random, n: int) -> str:
    return " ".join(dice.choice(WORDS) for _ in range(n))


def documents(spark, texts, **extra):
    """doc_id, text and a column whose name operators use inside; rows in order of texts."""
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + "".join(extra) if extra else "doc_id long, text string, ids string")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
