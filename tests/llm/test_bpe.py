"""Byte-level BPE against tiktoken and by round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gustframe.llm import bpe, queries
from tests.llm.helpers import ODD, SF, documents, prose, table

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_like_tiktoken(other):
    dice, coder = random.Random(1), bpe.encoder(PATH, P.PATTERN, bpe.CHUNKS)
    alphabets = ["ab", "abc  \n", "aeiou'stre ", "0123 .-", "éüß漢字😀   ", "".join(map(chr, range(1, 256)))]
    for _ in range(1500):
        letters = dice.choice(alphabets)
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(60)))
        assert coder.encode(text).tolist() == other.encode_ordinary(text), repr(text)


def test_long_runs_stay_linear(other):
    coder = bpe.encoder(PATH, P.PATTERN, bpe.CHUNKS)
    for text in ("a" * 20_000, "ab" * 10_000, " " * 5_000, prose(random.Random(2), 5_000)):
        assert coder.encode(text).tolist() == other.encode_ordinary(text)


def test_query_like_tiktoken(spark, other):
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF).collect()}
    for d in table(spark, "documents").collect():
        ids = other.encode_ordinary(d["text"] or "")
        row = got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_odd_rows_and_clashing_columns(spark, other):
    df = documents(spark, [*ODD, "twice", "twice"])
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [other.encode_ordinary(t or "") for t in [*ODD, "twice", "twice"]]
    assert [bytes(r["decoded"]).decode() for r in got] == [t or "" for t in [*ODD, "twice", "twice"]]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_forgotten_pairs(other, monkeypatch):
    """Pairs are forgotten at a bound, which changes no result, also while a piece is being split."""
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    words, dice = bpe.Vocabulary(PATH), random.Random(3)
    for _ in range(400):
        text = "".join(dice.choice("abceinorstß") for _ in range(dice.randrange(1, 30)))
        assert words.split(text.encode()) == other.encode_ordinary(text)
        assert sum(map(len, words.known)) == words.pairs <= 3
