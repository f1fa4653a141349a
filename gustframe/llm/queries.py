"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.llm import bpe, chat, decontam, importance, lcp, license_scan, merkle, minhash, ngram_join, oracles, quality_fm, secrets_ledger, sharding, toxicity_kn
from gustframe.llm.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]), ranks)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", F.inline("overlaps"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of a document that is a licence notice, with its family."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the output. One more conversation says control strings of other templates."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on sets of four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, threshold_percent=80)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; each is a path with one version. Half of the paths comes first, what the other half adds is scanned against the ledger."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets_ledger.Ledger(f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    for part in (0, 1):
        secrets_ledger.advance(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), ledger, str(part))
    found = secrets_ledger.findings(docs, ledger.read(spark))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secrets_ledger.BASE_RULES))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets_ledger.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        secrets_ledger.joined_spans(spans).alias("spans"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the held-out fold's labels are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_fm.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_fm.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", (quality_fm.fold() == 2).alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the held-out fold's labels are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_kn.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity_kn.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (toxicity_kn.fold() == 2).alias("held_out"), "score", (F.col("score") >= toxicity_kn.THRESHOLD).cast("int").alias("predicted"))


def op9_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    made = lcp.fingerprint_with_next(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into eight shards whose row counts differ by one at most."""
    shuffled = sharding.external_shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, seed=10)
    return shuffled.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the benchmark's texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _table(spark, sf_dir, "benchmark").select("text"), percent=5, least_words=20, seed=42)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their sets of five-word shingles."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=5, threshold_percent=80)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each proved against the root; in half of the rows new lines are deleted first, which shows where there were any."""
    docs = _table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", merkle.leaf(**fields).alias("leaf"), merkle.leaf(**(fields | {"text": altered})).alias("now"))
    made = merkle.manifest(rows, "leaf", "source", "doc_id", keep=["now"])
    out = made.select("doc_id", "leaf", "subroot", "root", merkle.proof("path").alias("proof_sha256"), merkle.folded("now", "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_decontam": op2_decontam,
        "op3_chat": op3_chat,
        "op4_licenses": op4_licenses,
        "op5_minhash": op5_minhash,
        "op6_secrets": op6_secrets,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_lcp": op9_lcp,
        "op10_sharding": op10_sharding,
        "op11_resample": op11_resample,
        "op12_ngram_join": op12_ngram_join,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": oracles.CHAT, "op5_minhash": oracles.NEAR, "op6_secrets": oracles.SECRETS, "op11_resample": oracles.RESAMPLE, "op12_ngram_join": oracles.JOIN, "op13_merkle": oracles.MERKLE}
