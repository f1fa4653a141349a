"""A corpus for language-model training: five stages over documents, each written as Parquet and read by the next.

toxicity: documents that the toxicity models reject go. near_duplicates: one document of each group of near duplicates (shingles of
five words, similarity 0.8) stays. decontaminate: documents that overlap with a benchmark item go. secrets: secrets are replaced by
marks of their kind, n_chars follows. tokens: ids of every text that is left.

The stages return the columns of documents with their values, whatever their names and types, the last one doc_id, n_tokens and ids. Null texts stay, as empty ones; empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.llm import bpe, decontam, minhash, secrets_ledger, toxicity_kn
from gustframe.llm.shared import discard, shared_dir, written


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has, so that a column of docs never makes way for a working one."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_kn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "score")
    return toxicity_kn.score(docs, model, out=score).filter(F.col(score) < toxicity_kn.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, words=5, threshold_percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules, ledger = secrets_ledger.MASK_RULES, secrets_ledger.Ledger(f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    secrets_ledger.advance(docs, ledger, "documents", rules)
    spans = _free(docs, "spans")
    found = secrets_ledger.findings(docs, ledger.read(spark), rules, out=spans)
    masked = secrets_ledger.redacted(F.col("text"), F.col(spans))
    held = F.size(spans) > 0
    return found.withColumn("text", F.when(held, masked).otherwise(F.col("text"))).withColumn("n_chars", F.when(held, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written before the next begins, and deleted once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs


#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None
