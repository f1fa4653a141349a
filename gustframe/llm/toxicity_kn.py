"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, letter by letter, one of toxic and one of ordinary documents: the likelihood of a letter after the five
before it backs off to that after four, and so on down to the letter alone. Discounted counts of the longest grams back off to
continuation counts (in how many contexts a gram was seen), and what discounting takes is given to the lower order in shares
that both classes have in common, so that an expression too rare to judge counts for neither. Letters rather than words,
because expressions are inflected: a rare form of a common stem is judged by its stem.

A text is compared by its log likelihoods under the two models, normalised by length: over all words, over its most toxic window,
over its most toxic words, and as shares of words that the toxic model likes much better. A logistic curve through these,
fitted on labelled documents that gave no counts, turns them into a probability.

Counts come from all labelled documents outside the held-out fold and one calibration fold, by one distributed count, and likelihoods
are joined and added up in written tables. Every gram that was counted is in the model, which stays in these tables and grows with
the labelled texts. Only its head is sent to the scorers: the most frequent grams, HEAD_GRAMS at most whatever the size, each marked if
rarer grams end with it. A word whose grams the head decides is scored at once; the other words are sent through joins with the tables,
and their ratios back to the documents that hold them. Where the head ends changes who does the work, not the scores.

Texts are read whole, however long. Null and empty texts get the curve's value at no evidence. Rows are scored one by one, repeated
rows alike. Without usable labels of both classes every score is the share of toxic labels (0 if there are none). Other columns are
kept, whatever their names; one that is named like the score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.shared import discard, map_texts, slices, written

#: Letters of the longest gram, and what stands before and after a word. A gram of n letters is a string of n characters.
ORDER, BEFORE, AFTER = 6, " ", "."
DISCOUNT = 0.75
#: The lower order's share is at least this.
LEAST_SHARE = 0.4
#: Labelled documents of the calibration fold that the curve is fitted on, at most.
MAX_CURVE = 20_000
#: Words of a window; log likelihood ratios above which a word counts as liked by the toxic model.
WINDOW, LIKED = 12, (2.0, 3.0)
#: Labels up to this number are sent to every executor (16 MB); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: A document whose score is at least this is toxic.
THRESHOLD = 0.3
#: Words whose ratio a worker remembers.
CACHE_WORDS = 1 << 16
#: Grams that are sent to every scorer, at most (13 bytes each).
HEAD_GRAMS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[str]:
    """For every letter of a word, and for its end: the ORDER letters that end there."""
    whole = BEFORE * (ORDER - 1) + word + AFTER
    return [whole[i : i + ORDER] for i in range(len(word) + 1)]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _more(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Keys of grams with one more letter before them. A key is a 64-bit hash of the whole letters, begun with 0 after the last one."""
    h = (h ^ letters) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_keys(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every letter of every word, and for the end of each: keys of the 1, 2, ... ORDER letters that end there, and the word's index."""
    pad = BEFORE * (ORDER - 1)
    s = _letters("".join(f"{pad}{w}{AFTER}" for w in words))
    of = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    ends = np.arange(len(of)) + (ORDER - 1) * (of + 1)
    keys, h = [], np.zeros(len(of), np.uint64)
    for k in range(ORDER):
        h = _more(h, s[ends - k])
        keys.append(h)
    return keys, of


def _with_grams(words: DataFrame) -> DataFrame:
    """A row for each gram of each row's word: the columns of words and `key`."""
    schema = T.StructType([*words.schema.fields, T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "word", 1 << 17):
                found = [grams(w) for w in part.column(part.schema.get_field_index("word")).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*part.take(of).columns, pa.array([k for f in found for k in f], pa.string())], names=[*part.schema.names, "key"])

    return words.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4: 2 is held out, 3 calibrates, 0 and 1 are counted."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame, label: str, folds: list[int], doc_id: str, text: str) -> DataFrame:
    """(id, text, y) of labelled documents in some folds."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & fold("id").isin(*folds))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, "id")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(key, r0, r1) over rows (y, text): how often each longest gram occurs in each class. Each slice's words are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 16 << 20):
            words = (Counter(), Counter())
            for y, t in zip(part.column(part.schema.get_field_index("y")).to_pylist(), part.column(part.schema.get_field_index("text")).to_pylist(), strict=True):
                words[y].update(words_of(t))
            for y in (0, 1):
                n = np.fromiter(words[y].values(), np.int64, len(words[y]))
                own = [n, np.zeros_like(n)]
                yield pa.RecordBatch.from_arrays([pa.array(list(words[y]), pa.string()), pa.array(own[y]), pa.array(own[1 - y])], names=["word", "r0", "r1"])

    sums = [F.sum(c).alias(c) for c in ("r0", "r1")]
    words = rows.select("y", "text").mapInArrow(run, "word string, r0 long, r1 long").groupBy("word").agg(*sums)
    return _with_grams(words).groupBy("key").agg(*sums)


def keys_of(grams: list[str], n: int) -> np.ndarray:
    """The keys, as in gram_keys(), of grams of n letters."""
    letters = _letters("".join(grams)).reshape(-1, n) if grams else np.empty((0, n), np.uint64)
    key = np.zeros(len(letters), np.uint64)
    for k in range(n):
        key = _more(key, letters[:, n - 1 - k])
    return key


class Head:
    """The most frequent grams: by order, sorted keys, the log likelihood ratio of the last letter, and whether rarer grams end with it."""

    def __init__(self, rows: dict[int, tuple[list[str], np.ndarray, np.ndarray]], open_root: bool):
        """rows: by order, (grams, ratios, whether there is more). open_root: whether a letter is missing."""
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, (grams_, ratio, more) in rows.items():
            key = keys_of(grams_, n)
            order = np.argsort(key)
            self.tables[n] = (key[order], ratio[order].astype(np.float32), more[order])
        self.open_root = open_root
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of_grams(self, keys: list[np.ndarray]) -> np.ndarray:
        """A gram that isn't in its order's table has the ratio of the one without its first letter: the classes share the back-off.

        NaN where the head can't say."""
        size = len(keys[0])
        out, todo, longest = np.zeros(size), np.arange(size), max(self.tables)
        for n in range(longest, 0, -1):
            own, ratio, more = self.tables[n]
            if len(own) and len(todo):
                key = keys[n - 1][todo]
                at = np.minimum(np.searchsorted(own, key), len(own) - 1)
                hit = own[at] == key
                found = ratio[at[hit]].astype(np.float64)
                if n < longest:
                    found[more[at[hit]]] = np.nan
                out[todo[hit]] = found
                todo = todo[~hit]
        if self.open_root:
            out[todo] = np.nan
        return out

    def of_words(self, words: list[list[str]]) -> list[np.ndarray]:
        """The log likelihood ratio of each word of each text; NaN where the head can't say."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for own in words for w in own if w not in self.known})
        for at in range(0, len(new), 1 << 13):
            part = new[at : at + (1 << 13)]
            keys, of = gram_keys(part)
            self.known.update(zip(part, np.bincount(of, self.of_grams(keys), len(part)).tolist(), strict=True))
        return [np.fromiter(map(self.known.__getitem__, own), np.float64, len(own)) for own in words]


def evidence_of(r: np.ndarray) -> list[float]:
    """EVIDENCE of a text whose words have the ratios r."""
    n = len(r)
    if not n:
        return [0.0] * len(EVIDENCE)
    total = np.concatenate(([0.0], np.cumsum(r)))
    k = min(WINDOW, n)
    top = np.partition(r, n - 3)[n - 3 :] if n > 3 else r
    return [total[-1] / n, (total[k:] - total[:-k]).max() / WINDOW, top.sum() / 3, *(np.sqrt((r > least).mean()) for least in LIKED)]


class Model:
    """head: what scorers get. tables: by order, the written likelihoods of all grams. curve: from EVIDENCE to a score."""

    def __init__(self, head: Head, tables: dict[int, DataFrame]):
        self.head, self.tables, self.curve = head, tables, np.zeros(1 + len(EVIDENCE))
        self.sent = tables[1].sparkSession.sparkContext.broadcast(head)


#: Whole text, most toxic window, three most toxic words, shares of words liked by the toxic model.
EVIDENCE = ("whole", "window", "top", "liked", "liked_much")


def _tables(counts: DataFrame) -> dict[int, DataFrame]:
    """By order, (key, r0, r1, c0, c1): how often grams occur, and counts: occurrences for the longest grams and for those at a word's beginning, else continuation counts."""
    out: dict[int, DataFrame] = {}
    table = counts.select("key", "r0", "r1", F.col("r0").alias("c0"), F.col("r1").alias("c1"))
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            sums = table.groupBy(F.substring("key", 2, n).alias("key")).agg(*[F.sum(f"r{c}").alias(f"r{c}") for c in (0, 1)], *[F.count_if(F.col(f"r{c}") > 0).alias(f"t{c}") for c in (0, 1)])
            # A gram at a word's beginning has one context only.
            begins = F.substring("key", 1, 1) == BEFORE
            table = sums.select("key", "r0", "r1", *[F.when(begins, F.col(f"r{c}")).otherwise(F.col(f"t{c}")).alias(f"c{c}") for c in (0, 1)])
        table = out[n] = written(table, f"counts{n}")
    return out


def _likelihoods(counts: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """By order, (key, r0, r1, low0, low1, ratio) from _tables(): the likelihood of a gram's last letter in each class, and the log of toxic over
    ordinary. Counts of the larger class are scaled down to the smaller one's size before they are discounted."""
    out: dict[int, DataFrame] = {}
    sums = reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("n"), F.count(F.lit(1)).alias("size"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")) for n, df in counts.items()])
    totals = {r["n"]: (r["size"], r["c0"], r["c1"]) for r in sums.collect()}
    for n in sorted(counts):
        size, *whole = totals[n]
        scaled = [F.col(f"c{c}") * F.lit(min(whole) / max(whole[c], 1)) for c in (0, 1)]
        # The letters after a history are no more than the alphabet has. They are added up in order, to give the same sum each time.
        rows = counts[n].select(F.substring("key", 1, n - 1).alias("history"), F.struct("key", "r0", "r1", *[F.greatest(s - DISCOUNT, F.lit(0.0)).alias(f"k{c}") for c, s in enumerate(scaled)], *[s.alias(f"s{c}") for c, s in enumerate(scaled)]).alias("x"))
        after = rows.groupBy("history").agg(F.array_sort(F.collect_list("x")).alias("x"))
        mass = [F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["k0"]), F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["k1"])]
        total = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["s0"] + x["s1"])
        after = after.select(F.inline("x"), *[m.alias(f"mass{c}") for c, m in enumerate(mass)], F.size("x").alias("letters"), total.alias("total"))
        share = F.least(F.greatest(F.lit(DISCOUNT) * F.col("letters") / F.greatest("total", F.lit(1e-9)), F.lit(LEAST_SHARE)), F.lit(1.0))
        # Histories that one class doesn't know leave their letters to the lower order.
        after = after.withColumn("share", F.when((F.col("mass0") > 0) & (F.col("mass1") > 0), share).otherwise(F.lit(1.0)))
        if n > 1:
            lower = out[n - 1].select(F.col("key").alias("tail"), F.col("low0").alias("b0"), F.col("low1").alias("b1"))
            after = after.withColumn("tail", F.substring("key", 2, n - 1)).join(lower, "tail")
        else:
            after = after.withColumns({f"b{c}": F.lit(1.0 / max(1, size)) for c in (0, 1)})
        low = [(F.lit(1.0) - F.col("share")) * F.col(f"k{c}") / F.greatest(f"mass{c}", F.lit(1e-9)) + F.col("share") * F.col(f"b{c}") for c in (0, 1)]
        after = after.select("key", "r0", "r1", *[x.alias(f"low{c}") for c, x in enumerate(low)])
        out[n] = written(after.withColumn("ratio", F.log(F.col("low1") / F.col("low0"))), f"grams{n}")
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly regularised."""
    scale = np.maximum(x.std(0), 1e-6)
    a = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate((beta[:1], beta[1:] / scale))


def _head(tables: dict[int, DataFrame], most: int) -> Head:
    """The grams that occur at least 2**j times in both classes together, with the least j by which they are no more than `most`."""
    power = F.length(F.bin(F.col("r0") + F.col("r1"))) - 1
    levels = None
    for df in tables.values():
        one = df.groupBy(power.alias("j")).count()
        levels = one if levels is None else levels.unionByName(one)
    counted = dict(levels.groupBy("j").agg(F.sum("count")).collect())  # a row for each power of two
    least, held = max(counted, default=0) + 1, 0
    while least > 0 and held + counted.get(least - 1, 0) <= most:
        least -= 1
        held += counted.get(least, 0)
    frequent = F.col("r0") + F.col("r1") >= 1 << least
    whole = not any(counted.get(j) for j in range(least))  # then no gram is rarer
    rows, open_root = {}, False
    for n in sorted(tables):
        own = tables[n].filter(frequent).select("key", "ratio")
        if n + 1 in tables and not whole:
            # A gram occurs at least as often as those that end with it, so rarer ones hang below the head.
            rarer = tables[n + 1].filter(~frequent).select(F.substring("key", 2, n).alias("key")).distinct().withColumn("more", F.lit(True))
            own = own.join(rarer, "key", "left")
        else:
            own = own.withColumn("more", F.lit(False))
        got = own.select("key", "ratio", F.coalesce("more", F.lit(False)).alias("more")).toArrow()
        rows[n] = (got["key"].to_pylist(), got["ratio"].to_numpy(), got["more"].to_numpy().astype(bool))
        if n == 1 and not whole:
            open_root = bool(tables[1].filter(~frequent).limit(1).count())
    return Head(rows, open_root)


def ratios(words: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """(word, ratio) of distinct words by joins with the whole model: each distinct gram is looked up once, from the longest downwards."""
    places = written(_with_grams(words.select("word")), "places")
    asked, steps = places.select("key").distinct(), []
    for n in range(max(tables), 0, -1):
        found = written(asked.join(tables[n].select("key", "ratio"), "key", "left"), f"asked{n}")
        steps.append((n, found))
        asked = found.filter("ratio is null").select(F.substring("key", 2, n - 1).alias("key")).distinct()
    answer = None
    for n, found in reversed(steps):
        if answer is None:
            answer = found.select("key", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
        else:
            lower = answer.select(F.col("key").alias("tail"), F.col("ratio").alias("low"))
            answer = found.withColumn("tail", F.substring("key", 2, n - 1)).join(lower, "tail", "left").select("key", F.coalesce("ratio", "low").alias("ratio"))
    return places.join(answer, "key").groupBy("word").agg(F.sum("ratio").alias("ratio"))


def evidence(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """(row: a struct of docs' columns in keep, evidence: EVIDENCE of each text as an array)."""
    sent, head = model.sent, model.head

    def make():
        def f(texts):
            words = [words_of(t) for t in texts]
            said = sent.value.of_words(words)
            open_ = [np.flatnonzero(np.isnan(r)) for r in said]
            whole = [None if len(o) else evidence_of(r) for r, o in zip(said, open_, strict=True)]
            rest = [[{"place": int(p), "word": w[p]} for p in o] if len(o) else None for w, o in zip(words, open_, strict=True)]
            part = [r.tobytes() if len(o) else None for r, o in zip(said, open_, strict=True)]
            return [pa.array(whole, pa.list_(pa.float64())), pa.array(part, pa.binary()), pa.array(rest, pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string())])))]

        return f

    many = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
    fields = [T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("part", T.BinaryType()), T.StructField("rest", many)]
    packed = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("n"))
    first = map_texts(packed, "text", ["row", "n"], make, fields)
    if not head.open_root and not any(t[2].any() for t in head.tables.values()):
        return first.select("row", "evidence")  # the head is the whole model
    first = written(first, "first")
    due = first.filter("rest is not null")
    each = due.select("n", F.inline("rest"))
    found = written(ratios(each.select("word").distinct(), model.tables), "words")
    # A word that many documents hold is one key of many rows; both sides are read from files, so that Spark can split it.
    told = each.join(found, "word").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("place", "ratio"))).alias("told"))
    source = due.select("row", "n", "part").join(told, "n").select("row", "part", "told")
    schema = T.StructType([source.schema["row"], fields[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                r = np.frombuffer(part, np.float64).copy()
                r[x.values.field("place").to_numpy()] = x.values.field("ratio").to_numpy()
                out.append(evidence_of(r))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["row", "evidence"])

    return first.filter("rest is null").select("row", "evidence").unionByName(source.mapInArrow(run, schema))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", head_grams: int = HEAD_GRAMS) -> Model | float:
    """The model, or the share of toxic labels if one class or the calibration has no documents. Labels of the held-out fold aren't read."""
    counts = written(gram_counts(_labelled(docs, labels, label, [0, 1], doc_id, text)), "counts")
    r0, r1 = counts.agg(F.sum("r0"), F.sum("r1")).first()
    if not r0 or not r1:
        return float(bool(r1))
    counted = _tables(counts)
    tables = _likelihoods(counted)
    model = Model(_head(tables, head_grams), tables)
    discard(counts, *counted.values())
    # The calibration sample: the least hashes of labelled documents of fold 3.
    known = labels.filter(F.col(doc_id).isNotNull() & fold(doc_id).isin(3)).select(doc_id, label).orderBy(F.xxhash64(F.lit(8), doc_id), label).limit(MAX_CURVE)
    sample = _labelled(docs, known, label, [3], doc_id, text)
    seen = evidence(sample, model, "text", ["id", "y"]).select("row.*", "evidence").orderBy("id", "evidence").toArrow()
    y = seen["y"].to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.0
    model.curve = _fit(np.array(seen["evidence"].to_pylist()), y)
    return model


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with `out`: how likely the text is toxic, from 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias(out))
    curve = model.curve.tolist()
    margin = F.aggregate(F.zip_with("evidence", F.array(*map(F.lit, curve[1:])), lambda a, b: a * b), F.lit(curve[0]), lambda a, b: a + b)
    margin = F.least(F.greatest(margin, F.lit(-40.0)), F.lit(40.0))
    return evidence(docs, model, text, keep).select("row.*", (1 / (1 + F.exp(-margin))).alias(out))
