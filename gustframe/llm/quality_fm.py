"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Besides a weight for each feature, the machine has a weight for each pair of features, the product of two short vectors. The sum
over all pairs is half the squared sum of the vectors less the sum of their squares, so a text is scored in linear time.

Features: the distinct words of the whole text, hashed to 2**14 buckets, each with the same small value so that their squares sum to one;
statistics of the text's structure (case, symbols, digits, repetition, lengths); and its length as metadata. Labels, language,
source and doc_id are no inputs of a score.

Fitted on at most MAX_FIT labelled documents outside the held-out fold, those with the least hashes of doc_id. Texts are read whole, however
long. Null and empty texts have statistics of zero and are scored like others. Rows are scored one by one, repeated rows alike; without
labels every score is 0.5. Other columns are kept, whatever their names; one that is named like the score is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.shared import map_texts

WORDS = 1 << 14
FACTORS = 6
#: Labelled documents that the machine is fitted on, at most; their ids are broadcast.
MAX_FIT = 12_000
EPOCHS = 24
#: A document whose score is at least this is good.
THRESHOLD = 0.7
STATS = 18
_WORD = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """word -> bucket, the same in every process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 1 << 16:
            self.clear()
        self[word] = i = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 7) % WORDS
        return i


_BUCKETS = Buckets()
_KINDS = np.zeros(256, np.int64)
for _c in range(256):
    _KINDS[_c] = 1 if 97 <= _c < 123 else 2 if 65 <= _c < 91 else 3 if 48 <= _c < 58 else 4 if _c in b" \t" else 5 if _c in b"\r\n" else 6 if _c in b".,;:'\"?-" else 7 if _c < 128 else 0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of distinct words, statistics)."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=8) / max(1, len(raw))
    tokens = text.split()
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip()]
    lower = text.lower()
    words = _WORD.findall(lower)
    distinct = set(words)
    pairs = len(set(zip(tokens, tokens[1:], strict=False))) / max(1, len(tokens) - 1) if len(tokens) > 1 else 1.0
    lengths = np.fromiter(map(len, tokens), np.float64, len(tokens)) if tokens else np.zeros(1)
    marks = np.bincount(raw, minlength=128)[[33, 35, 36, 37, 38, 42, 60, 64, 123, 124, 126]] / n
    stats = np.array(
        [
            *kinds[1:8],
            len(distinct) / max(1, len(words)),
            pairs,
            len(set(lines)) / max(1, len(lines)),
            lengths.mean() / 10,
            lengths.std() / 10,
            min(1.0, marks.sum()),
            min(1.0, marks.max()),
            sum(map(len, words)) / max(1, len(text)),
            len(lines) / n,
            np.log1p(len(text)) / 10,
            float(not tokens),
        ]
    )
    buckets = np.unique(np.fromiter(map(_BUCKETS.__getitem__, distinct), np.int64, len(distinct)))
    return buckets, stats


class Machine:
    def __init__(self, seed: int = 7):
        dice = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(WORDS + STATS)
        self.v = dice.normal(0, 0.01, (WORDS + STATS, FACTORS))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def rows(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, values and where each text begins; every text has its STATS statistics first."""
        idx, val, starts, at = [], [], [], 0
        for buckets, stats in found:
            idx += [np.arange(WORDS, WORDS + STATS), buckets]
            val += [np.clip((stats - self.mean) / self.scale, -4, 4), np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets))))]
            starts.append(at)
            at += STATS + len(buckets)
        return np.concatenate(idx), np.concatenate(val), np.array(starts)

    def margins(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear time: half of (sum of v x) squared less the sum of (v x) squared. Also v x and its sums."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.bias + np.add.reduceat(self.w[idx] * val, starts) + pairs, vx, sums

    def score(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.margins(*self.rows([features(t) for t in texts]))[0]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    def fit(self, found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float = 0.03, decay_words: float = 2e-3, decay: float = 1e-5) -> None:
        """Adam on the logistic loss over mini-batches, in an order that depends on the seed alone."""
        stats = np.array([s for _, s in found])
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        base = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(base / (1 - base)))
        dice = np.random.default_rng(11)
        shrink = np.concatenate((np.full(WORDS, decay_words), np.full(STATS, decay)))
        theta = np.column_stack([self.w, self.v])
        m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
        mb = sb = 0.0
        for epoch in range(EPOCHS):
            step = rate * (1 - epoch / EPOCHS)
            order = dice.permutation(len(found))
            for at in range(0, len(order), 256):
                own = order[at : at + 256]
                idx, val, starts = self.rows([found[i] for i in own])
                self.w, self.v = theta[:, 0], theta[:, 1:]
                margin, vx, sums = self.margins(idx, val, starts)
                g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[own]) / len(own)
                row = np.repeat(np.arange(len(own)), np.diff(starts, append=len(idx)))
                each = np.column_stack([val, val[:, None] * (sums[row] - vx)]) * g[row][:, None]
                grad = np.stack([np.bincount(idx, each[:, k], len(theta)) for k in range(each.shape[1])], 1) + shrink[:, None] * theta
                t += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.99 * s + 0.01 * grad**2
                theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
                gb = g.sum()
                mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
                self.bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
        self.w, self.v = theta[:, 0].copy(), theta[:, 1:].copy()


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4: 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Machine | None:
    """A fitted machine, or None without labels. Labels of the held-out fold aren't read."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id") != 2))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(MAX_FIT)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    def make():
        def f(texts):
            found = [features(t) for t in texts]
            return [pa.array([b.tolist() for b, _ in found], pa.list_(pa.int32())), pa.array([s.tolist() for _, s in found], pa.list_(pa.float64()))]

        return f

    fields = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    got = map_texts(sample, "text", ["id", "y"], make, fields).orderBy("id").limit(MAX_FIT).toArrow()
    if not got.num_rows:
        return None
    found = [(np.array(b, np.int64), np.array(s)) for b, s in zip(got["buckets"].to_pylist(), got["stats"].to_pylist(), strict=True)]
    machine = Machine()
    machine.fit(found, got["y"].to_numpy().astype(np.float64))
    return machine


def score(docs: DataFrame, machine: Machine | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with `out`: how likely the text is good, from 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    if machine is None:
        return docs.select(*keep, F.lit(0.5).alias(out))
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return map_texts(docs, text, keep, lambda: lambda texts: [pa.array(held.value.score(texts))], [T.StructField(out, T.DoubleType(), False)])
