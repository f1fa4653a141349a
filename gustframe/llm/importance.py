"""Importance resampling: draw the documents of a corpus that look like a target, by hashed n-gram counts.

A text's features are its runs of one to three words, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo `BUCKETS`.
A bucket's gain is the logarithm of its share in the target over its share in the corpus, a document's weight the sum over its
features. A Gumbel number drawn by seed and doc_id is added, and the documents of the highest scores are drawn: sampling without
replacement in proportion to exp(weight / 1000).

Head and tail: the words that the corpus has most often are sent to every task with the CRC state after each, the pairs of them that
it has most often with their state too, so that most features need no hashing. Every other feature takes its CRC directly, by
carrying the state of what comes before it through the next word's bytes. Both feed the same exact totals: where the head ends decides
who does the work, not a single count. Pairs are counted in summaries that keep, in each task, every pair with a share above
1 / `SUMMARY`; words are counted exactly.

Nulls and empty texts have no words, no features and weight 0. A null doc_id draws with an empty id and stands behind others of its
score. Repeated rows are rows of their own. Texts are read whole. Empty tables: no corpus gives no rows, an empty target makes gains
that favour what the corpus has least. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.shared import Frequent, discard, most_counted, ranked, slices, small_batches, written

BUCKETS = 10_000
#: Head words and their longest, in bytes: at most 4 MB are sent.
HEAD_WORDS, HEAD_BYTES = 1 << 16, 64
#: Places of the table of head pairs: 12 bytes each.
PAIR_PLACES = 1 << 18
#: Pairs that a task's summary holds, and distinct words that it holds before it hands them on.
SUMMARY, HELD_WORDS = 1 << 17, 1 << 16
#: Words outside the head that a task remembers.
REMEMBERED = 1 << 18
#: Bytes of text whose features are found at once.
SLICE = 1 << 20
#: Words of up to so many bytes are carried through tables, longer ones byte by byte.
TABLE_BYTES = 64
#: A-Z in lower case; what is neither 0-9, a-z nor beyond ASCII separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _tables() -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC becomes when n zero bytes follow. CRC-32 is linear: the state after b is the state before
    carried through len(b) zeros, xor the CRC of b."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((TABLE_BYTES + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, TABLE_BYTES + 1):
        out[n] = one[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


class Head:
    """Frequent words and frequent pairs of their numbers, the most frequent last (key: first * HEAD_WORDS + second)."""

    def __init__(self, words: list[bytes], pairs: list[tuple[int, int]]) -> None:
        self.words = {w: zlib.crc32(w) | (i + 1) << 32 for i, w in enumerate(words)}
        self.keys = np.full(PAIR_PLACES, np.uint64(2**64 - 1))
        self.states = np.zeros(PAIR_PLACES, np.uint32)
        # The most frequent pair of a place stays there; the others belong to the tail.
        keys = np.array([a * HEAD_WORDS + b for a, b in pairs], np.uint64)
        for at, key, (a, b) in zip(_place(keys).tolist(), keys, pairs, strict=True):
            self.keys[at], self.states[at] = key, zlib.crc32(b" " + words[b], zlib.crc32(words[a]))


def _place(keys: np.ndarray) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(64 - PAIR_PLACES.bit_length() + 1)).astype(np.int64)


class _Tail(dict):
    """word -> CRC state and number in the head (0: none); remembers a bounded number of words outside the head."""

    def __init__(self, head: dict[bytes, int]) -> None:
        super().__init__(head)
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.head) + REMEMBERED:
            self.clear()
            self.update(self.head)
        self[word] = found = zlib.crc32(word)
        return found


class Hasher:
    """CRC states of a text's words, pairs and triples."""

    def __init__(self, head: Head) -> None:
        self.head, self.known, self.tables = head, _Tail(head.words), _tables().reshape(-1)
        self.space = np.uint32(zlib.crc32(b" "))

    def _carried(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        base, t = lengths.astype(np.int64) * 1024, self.tables
        return t[base + (states & 255)] ^ t[base + 256 + (states >> 8 & 255)] ^ t[base + 512 + (states >> 16 & 255)] ^ t[base + 768 + (states >> 24)]

    def _then(self, states: np.ndarray, words: list[bytes], crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The states after a space and the next words."""
        spaced = self._carried(states, np.ones(len(states), np.int64)) ^ self.space
        out = self._carried(spaced, np.minimum(lengths, TABLE_BYTES)) ^ crc
        for i in np.flatnonzero(lengths > TABLE_BYTES).tolist():
            out[i] = zlib.crc32(words[i], int(spaced[i]))
        return out

    def states(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, text) of all features of texts that have so many of the words each: of words, of pairs, of triples. text: which one."""
        found = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        crc, number = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(len(sizes)), sizes)
        a, b = number[:-1], number[1:]
        both = (a > 0) & (b > 0)
        key = ((a - 1) * HEAD_WORDS + b - 1).astype(np.uint64)
        place = _place(key)
        known = both & (self.head.keys[place] == key)
        pairs = self.head.states[place]
        tail = np.flatnonzero(~known)
        long = bool((lengths > TABLE_BYTES).any())
        pairs[tail] = self._then(crc[tail], [words[i + 1] for i in tail.tolist()] if long else [], crc[tail + 1], lengths[tail + 1])
        # Pairs and triples that reach into the next text are none.
        two, three = of[:-1] == of[1:], of[:-2] == of[2:]
        triples = self._then(pairs[:-1], words[2:] if long else [], crc[2:], lengths[2:])
        return np.concatenate([crc, pairs[two], triples[three]]), np.concatenate([of, of[:-1][two], of[:-2][three]])

    def buckets(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of all features of some texts, given by their words."""
        sizes = np.array([len(w) for w in texts], np.int64)
        states, of = self.states([w for own in texts for w in own], sizes)
        return (states % np.uint32(BUCKETS)).astype(np.int64), of


def _texts(df: DataFrame, text: str, *more) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(*more, F.col(text).cast("binary").alias("t"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of about a megabyte of text, and the words of each text."""
    for part in slices(batches, "t", SLICE):
        yield part, [words_of(t) for t in part.column("t").to_pylist()]


def _counted(texts: DataFrame, summary: int) -> DataFrame:
    """(w: a word, or null, k: the CRCs of a pair, or null, n) in one pass: words are counted exactly, pairs in summaries."""

    def rows(words: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in words], pa.binary()), "k": pa.nulls(len(words), pa.int64()), "n": pa.array([n for _, n in words], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Tail({}), Frequent(summary)
        held: Counter = Counter()
        for _, texts in _parts(batches):
            words = [w for own in texts for w in own]
            held.update(words)
            of = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
            crc = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            seen.add((crc[:-1] << np.uint64(32) | crc[1:])[of[:-1] == of[1:]])
            if len(held) > HELD_WORDS:
                yield rows([(w, n) for w, n in held.items() if len(w) <= HEAD_BYTES])
                held = Counter()
        yield rows([(w, n) for w, n in held.items() if len(w) <= HEAD_BYTES])
        keys, counts = seen.merge()
        keys, counts = keys[counts > 1], counts[counts > 1]
        yield pa.RecordBatch.from_pydict({"w": pa.nulls(len(keys), pa.binary()), "k": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    return texts.mapInArrow(count, "w binary, k long, n long").groupBy("w", "k").agg(F.sum("n").alias("n"))


def head(texts: DataFrame, text: str = "text", summary: int = SUMMARY) -> Broadcast:
    """The frequent words and pairs of texts, as every task gets them. A task's summary of pairs holds at most `summary`."""
    each = written(_counted(_texts(texts, text), summary), "counted")
    words = sorted(most_counted(each.filter("w is not null").select("w", "n"), HEAD_WORDS).column("w").to_pylist())
    pairs = most_counted(each.filter("k is not null").select("k", "n"), PAIR_PLACES // 4).sort_by("n")
    discard(each)
    number = {zlib.crc32(w): i for i, w in enumerate(words)}
    known = [(number.get(k >> 32), number.get(k & 0xFFFFFFFF)) for k in pairs.column("k").to_numpy().view(np.uint64).tolist()]
    return texts.sparkSession.sparkContext.broadcast(Head(words, [(a, b) for a, b in known if a is not None and b is not None]))


def totals(texts: DataFrame, sent: Broadcast, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        hasher, total = Hasher(sent.value), np.zeros(BUCKETS, np.int64)
        for _, texts in _parts(batches):
            total += np.bincount(hasher.buckets(texts)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"b": pa.array(np.arange(BUCKETS)), "n": pa.array(total)})

    out = [0] * BUCKETS
    for r in _texts(texts, text).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["b"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    s, t = sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + BUCKETS) / ((x + 1) * (t + BUCKETS)))) for x, y in zip(corpus, target, strict=True)], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, sent: Broadcast, seed: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, words, n_features, weight, score) for each row of df."""

    def run(batches):
        hasher = Hasher(sent.value)
        for part, texts in _parts(batches):
            ids, n = part.column("doc_id").to_pylist(), np.array([len(own) for own in texts], np.int64)
            bucket, of = hasher.buckets(texts)
            # Sums of whole numbers below 2**53 are exact.
            w = np.bincount(of, gain[bucket], len(n)).astype(np.int64)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            score = w + np.array([gumbel(seed, i) for i in ids], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "words": n, "n_features": features, "weight": w, "score": score})

    return _texts(df, text, F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, words long, n_features long, weight long, score long")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of df; rank 1, 2, 3... for the documents drawn, else null.

    Of the documents with at least least_words words, percent % are drawn, those of the highest score; ties go to the smaller doc_id.
    """
    sent = head(df, text)
    gain = gains(totals(df, sent, text), totals(target, sent, text))
    all_rows = written(scored(df, gain, sent, seed, doc_id, text), "scored")
    able = F.col("words") >= least_words
    n, bound = all_rows.filter(able).agg(F.count(F.lit(1)), F.percentile_approx("score", 1 - min(percent + 1, 100) / 100, 10_000)).first()
    due = percent * n // 100
    # The bound is near; only if enough rows are not below it may the rest go unranked.
    if bound is None or all_rows.filter(able & (F.col("score") >= bound)).count() < due:
        bound = -(2**63)
    near = able & (F.col("score") >= bound)
    line, placed = ranked(all_rows.filter(near).withColumn("all", F.lit(0)), "all", [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")])
    rank = F.when(F.col("rank") < due, F.col("rank") + 1).cast("long")
    drawn = line.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    rest = all_rows.filter(~near).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    out = drawn.unionByName(rest)
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)
