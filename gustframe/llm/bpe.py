"""Byte-level BPE by backtracking over longest matches.

A piece of text is tokenised from left to right: take the longest vocabulary entry that starts here, and keep it if it can
stand next to the token before it, that is, if merging by rank could never have joined across their border. Whether two
tokens are compatible depends on those two alone and is memoised. A dead end steps back over one token; a position that
failed is never tried again, so the work is linear in the piece. The result is exactly what merging by rank gives.

Bytes are mapped to the characters U+0000-U+00FF (Latin-1) so that the Aho-Corasick automaton, which works on strings, sees bytes.

Null and empty texts have no ids; repeated rows are encoded alike; a text of any length is one row; other columns pass through, and
one that is named like the result is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.llm.shared import map_texts

#: Chunks, and half as many pieces of them, whose ids a worker remembers in each of two halves, the recent and the older one.
CACHE_PIECES = 1 << 18
#: Pairs whose compatibility a worker remembers.
CACHE_PAIRS = 1 << 19
#: White space, by Unicode's property of that name.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs without white space and the one blank before them, or white space. Splitting these one by one gives the same pieces as
#: splitting the whole text, for patterns whose pieces hold white space only as one leading blank or as a run of their own.
CHUNKS = f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Longer pieces are not remembered.
CACHE_CHARS = 64


class Remembered(dict):
    """text -> made(text), filled on demand. Beyond `most` texts the dict becomes the older half, from which those in use come back."""

    def __init__(self, made: Callable[[str], bytes], most: int):
        super().__init__()
        self.made, self.most, self.older = made, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.pop(key, None)
        if found is None:
            found = self.made(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Vocabulary:
    """Ranks of a tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        missing = [b for b in range(256) if chr(b) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.rank = ranks
        self.longest = ahocorasick.Automaton()
        for token, r in ranks.items():
            self.longest.add_word(token, (len(token) - 1, r))
        self.longest.make_automaton()
        self.prefixes: dict[int, tuple[int, ...]] = {}  # a token and those it begins with, longest first
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        self.merged: dict[tuple[int, int], int] = {}
        self.known: list[dict[int, bool]] = [{} for _ in range(max(ranks.values()) + 1)]  # by left, then right: whether the two can be neighbours
        self.pairs = 0
        self.size = {r: len(t) for t, r in ranks.items()}
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            prefixes = [k for k in range(len(token) - 1, 0, -1) if token[:k] in ranks]
            self.prefixes[r] = (r, *(ranks[token[:k]] for k in prefixes))
            for k in prefixes:
                left, right = ranks[token[:k]], ranks.get(token[k:])
                if right is not None and left < r and right < r and self._stay_apart(left, right):
                    self.halves[r] = (left, right)
                    self.merged[left, right] = r
                    break

    def _stay_apart(self, left: int, right: int) -> bool:
        """True if merging by rank leaves this border open: undo merges next to it, latest first, and look for an earlier merge across."""
        before = float("inf")  # a merge across the border counts only if it comes before what has been undone
        a, b = left, right
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            inner = [(r, side) for r, side in ((a, 0), (b, 1)) if r in self.halves]
            if not inner:
                return True
            # Of equal merges the left one comes first, so the right one is undone first.
            r, side = max(inner)
            before = r + side
            if side:
                b = self.halves[b][0]
            else:
                a = self.halves[a][1]

    def _remember(self, left: int, right: int) -> bool:
        if self.pairs >= CACHE_PAIRS:
            for row in self.known:
                row.clear()
            self.pairs = 0
        self.pairs += 1
        apart = self.known[left][right] = self._stay_apart(left, right)
        return apart

    def split(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        s = piece.decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        size, known, ids, row = self.size, self.known, [], None  # row: what may follow the last token
        # The longest match each time: for about half of the pieces no step has to be taken back.
        for _, (_, r) in self.longest.iter_long(s):
            if row is not None and not row.get(r):
                break
            ids.append(r)
            row = known[r]
        else:
            return ids
        n = len(s)
        first: list[int] = [0] * n
        for end, (back, r) in self.longest.iter(s):  # ends ascend, so the longest comes last
            first[end - back] = r
        dead, prefixes = bytearray(n + 1), self.prefixes
        at = sum(map(size.__getitem__, ids))
        options = prefixes[first[at]]
        while at < n:
            for r in options:
                end = at + size[r]
                if not dead[end]:
                    if row is None:
                        break
                    apart = row.get(r)
                    if apart is None:
                        apart = self._remember(ids[-1], r)
                    if apart:
                        break
            else:
                dead[at] = 1
                r = ids.pop()
                at -= size[r]
                row, options = known[ids[-1]] if ids else None, prefixes[r][1:]
                continue
            ids.append(r)
            at, row = end, known[r]
            if at < n:
                options = prefixes[first[at]]
        return ids


class Encoder:
    """Ids of whole texts, as int32 in bytes."""

    def __init__(self, words: Vocabulary, pattern: str, chunks: str | None):
        self.pieces = regex.compile(pattern).findall
        self.chunks = re.compile(chunks).findall if chunks else None
        self.of_pieces = Remembered(lambda piece: array("i", words.split(piece.encode("utf-8", "surrogatepass"))).tobytes(), CACHE_PIECES // 2)
        self.of_chunks = Remembered(self.of_chunk, CACHE_PIECES)

    def of_chunk(self, chunk: str) -> bytes:
        found = self.pieces(chunk)
        return self.of_pieces.made(chunk) if found == [chunk] else b"".join(map(self.of_pieces.__getitem__, found))

    def encode(self, text: str | None) -> np.ndarray:
        parts = map(self.of_chunks.__getitem__, self.chunks(text or "")) if self.chunks else map(self.of_pieces.__getitem__, self.pieces(text or ""))
        return np.frombuffer(b"".join(parts), np.int32)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str, pattern: str, chunks: str | None) -> Encoder:
    return Encoder(vocabulary(path), pattern, chunks)


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, chunks: str | None = CHUNKS) -> DataFrame:
    """Add `out`, array<int>: the ids of the whole text, each match of `pattern` encoded separately, without special tokens.

    ranks: a tiktoken file that every executor can open. keep: the columns to return besides; all of df's by default.
    chunks: see CHUNKS; None for patterns that don't allow it. Null texts count as empty: no ids.
    """

    def make():
        coder = encoder(ranks, pattern, chunks)
        return lambda texts: [_lists([coder.encode(t) for t in texts], pa.int32())]

    return map_texts(df, text, df.columns if keep is None else keep, make, [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add `out`, binary: the bytes that the ids stand for. Null ids count as none."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*[c for c in kept if c != ids], F.col(ids).alias("__ids"))
    names = source.columns[:-1]
    again = ids in kept
    schema = T.StructType([source.schema[c] for c in names] + ([T.StructField(ids, T.ArrayType(T.IntegerType()))] if again else []) + [T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, of = to_arrow_schema(schema), token_bytes(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(len(names))
                texts = pa.array([b"".join(map(of.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists], pa.binary())
                cols = [*part.columns[: len(names)], *([lists] if again else []), texts]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, to, strict=True)], schema=to)

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, ranks: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Per row of encoded texts: n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the bytes decoded again."""
    keep = [c for c in df.columns if c != ids] if keep is None else keep
    back = decode(df, ranks, ids, "__decoded", [*keep, ids])
    return back.select(
        *keep,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("__decoded", 256).alias("decoded_sha256"),
    )
