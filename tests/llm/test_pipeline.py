"""The pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

import base64
import random
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gustframe.llm import bpe, decontam, minhash, secrets_ledger, toxicity_kn
from tests.llm import test_decontam, test_minhash
from tests.llm.helpers import SF, prose, table


def test_stages_keep_columns_and_their_promises(spark):
    docs = table(spark, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        if name == "near_duplicates":
            assert after.count() == minhash.near_duplicates(kept).filter("kept").count()
            assert minhash.near_duplicates(after).filter("not kept").count() == 0
        if name == "decontaminate":
            assert decontam.clean(after, table(spark, "benchmark")).count() == after.count()
        kept = after
    coder = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, bpe.CHUNKS)
    out = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == {r["doc_id"]: coder.encode(r["text"]).tolist() for r in kept.collect()}


def test_stages_keep_the_values_of_columns_with_names_used_inside(spark):
    names = ["secret_spans", "__score", "score", "row", "overlaps", "ids", "spans", "blob", "stands", "h", "id", "component", "key", "n", "words", "seen", "found", "Score_"]
    docs = table(spark, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) if i % 2 else F.array(F.col("doc_id"), F.lit(i)) for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes
        rows = after.select("doc_id", *names).collect()
        assert rows and all(r[c] == (f"{c}{r['doc_id']}" if i % 2 else [r["doc_id"], i]) for r in rows for i, c in enumerate(names))


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _masked(text):
    """Secrets replaced by marks, with the re module."""
    spans = []
    for rank, rule in enumerate(secrets_ledger.MASK_RULES):
        spans += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m[rule.value]) >= rule.least]
    out, at = "", 0
    for start, _, kind, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[secret:{kind}]"
        at = max(at, end)
    return out + text[at:] if spans else text


def test_like_brute_force_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, copies, leaks, secrets and columns whose names operators use inside, through all stages."""
    dice = random.Random(20)
    item = prose(dice, 20)
    base = prose(dice, 60)
    near = " ".join(["other", *base.split()[1:]])
    texts = [base, near, base, None, "", " ", f"{prose(dice, 9)} {item} {prose(dice, 5)}", "my token=abcdefghijklmnop here " + prose(dice, 20), "a b", "a b", *[prose(dice, 25) + (" vile nasty" if i % 2 else " kind calm") for i in range(60)]]
    rows = [(i, t, None if i % 3 else "en", None, len(t or ""), 1, 2, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, "another text of the same id", "en", "s", 27, 1, 2, 3, "x"), (None, prose(dice, 30), None, None, None, 1, 2, 3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, overlaps int, secret_spans int, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(10, 70)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity_kn.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = {(r["doc_id"], r["text"]): r["score"] for r in toxicity_kn.score(docs.select("doc_id", "text"), model).collect()}
    left = [r for r in rows if scores[r[0], r[1]] < toxicity_kn.THRESHOLD]
    assert 0 < len(left) < len(rows)
    # Rows that repeat an id and a text are one; of each group the least id stays; rows without an id stay.
    once = sorted({(r[0], r[1]) for r in left if r[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    group = test_minhash._slowly([t for _, t in once], 5)
    stays = [once[c] for i, _, c, _ in group if i == c] + [(None, r[1]) for r in left if r[0] is None]
    clean = [(i, t) for i, t in stays if not test_decontam._slowly(t or "", item)]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = sorted((-1 if i is None else i, coder.encode_ordinary(_masked(t) or "")) for i, t in clean)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert corpus_pipeline.mask_secrets(spark, docs, "").filter(F.col("doc_id") == 7).count() == 4
