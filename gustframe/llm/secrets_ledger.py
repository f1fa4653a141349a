"""Secret scans over versioned text with an incremental ledger of blobs.

Every version of a file is a row (path, version) with a text. A text is addressed by its content (SHA-256): texts that occur
under many paths or in many versions are one blob. A ledger, a folder of Parquet batches, remembers which pairs of blob and rule
version have been scanned and what they held. advance() scans the pairs that it lacks and appends them; findings() joins what it holds
back to every path. A batch that is written again replaces itself, so a run that was cut off can be repeated.

Only DataFrame and SQL functions run over the rows. Positions are code points, end exclusive. A rule's matches are found by
extracting all of them and splitting at them: the lengths of pieces and matches, summed in a window, are the positions.

Null texts count as empty and have no findings. Repeated rows each get the findings. Empty tables give none. Texts are scanned whole; the
work is linear in a text's length and matches. Other columns stay, whatever their names; one that is named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.llm.shared import exists


@dataclass(frozen=True)
class Rule:
    """kind and version name it; group `value` of the pattern must have `least` characters."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1


def _either(words: str) -> str:
    """ASCII letters in either case, written out."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: What a key to a credential is called.
NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The rules in the order in which kinds are listed. A greedy run of at least n characters is the same as a greedy run, kept if it has n.
BASE_RULES = (Rule("assign", 1, ASSIGN, 2, 12), Rule("access", 1, r"AKIA[A-Z0-9]{14,}"), Rule("hex", 1, r"[0-9a-f]{16,}"))
#: Public formats of other credentials.
MORE_RULES = (
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
#: A private key from its heading over header lines and base64 (line breaks may be written \n) to its END line; without one, to the last
#: line that is base64 alone. The long runs are of single characters, which Java matches without recursion.
_PEM = r"[A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
_PEM_HEADERS = r"(?:(?:\s|\\[rn]){1,80}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID|Content-Domain):[^\r\n\\]*){0,20}"
PRIVATE = rf"-----BEGIN {_PEM}{_PEM_HEADERS}(?:[A-Za-z0-9+/=\\\s]*+-----END {_PEM}|(?:(?!(?<=\S)[ \t]++\S)[A-Za-z0-9+/=\\\s])*(?<=\S)(?![^\r\n\"'])|)"
#: For redaction: the whole key. RULES find its heading, as the SQL of op6_secrets does, whose regular expressions can't look around.
MASK_RULES = tuple(Rule("private", 2, PRIVATE) if r.kind == "private" else r for r in RULES)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


#: A ledger's columns: what each scanned rule version found in a blob.
LEDGER = f"blob string, scans array<struct<rule:string,spans:array<{SPAN}>>>"
#: Up to so many spans (about 16 MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_SPANS = 250_000


@dataclass(frozen=True)
class Ledger:
    """A folder that driver and executors share."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        """(blob, scans): a row for each blob and batch that scanned it."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], LEDGER)
        return spark.read.schema(LEDGER).parquet(self.path).select("blob", "scans")

    def append(self, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def _key(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def _steps(text: Column, rule: Rule) -> Column:
    """For each match, leftmost and without overlaps: the characters before it since the last one, its own, and those of its value."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(values, F.length).alias("val"))
    return F.when(text.rlike(rule.pattern), steps)


def _blob(text: str) -> Column:
    """The SHA-256 of a text's bytes."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen(df: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger's new rows: for each blob of df, the rule versions that the ledger lacks, with what they find. Each text is scanned once."""
    seen = ledger.select("blob", F.explode("scans.rule").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # A partial step on the rows' side thins out copies before blobs meet.
    blobs = df.select(_blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    due = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(F.array(*[F.lit(_key(r)) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("due") > 0)
    scans = [F.struct(F.lit(i).alias("rank"), F.lit(_key(r)).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.array_contains("due", _key(r)).alias("asked"), F.when(F.array_contains("due", _key(r)), _steps(F.col("text"), r)).alias("steps")) for i, r in enumerate(rules)]
    each = due.select("blob", F.inline(F.array(*scans))).filter("asked")
    each = each.select("blob", "rank", "rule", "kind", "least", F.posexplode_outer("steps").alias("i", "step"))
    # All that follows is by blob, as the rows are already.
    end = F.sum(F.col("step.gap") + F.col("step.len")).over(W.partitionBy("blob", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    span = F.struct((F.col("end") - F.col("step.len")).alias("start"), "rank", "kind", "end").cast(SPAN)
    found = each.withColumn("end", end).groupBy("blob", "rank", "rule").agg(F.collect_list(F.when(F.col("step.val") >= F.col("least"), span)).alias("spans"))
    return found.groupBy("blob").agg(F.collect_list(F.struct("rule", "spans")).alias("scans"))


def advance(df: DataFrame, ledger: Ledger, batch: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan the pairs of df's blobs and rule versions that the ledger lacks, and append them as one batch."""
    ledger.append(unseen(df, ledger.read(df.sparkSession), rules, text), batch)


def findings(df: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """df with `out`, array<struct<start, rank, kind, end>> sorted by start, then the rules' order: what the ledger holds of each row's blob
    for these rule versions. Empty if that is nothing."""
    keep = [c for c in df.columns if c != out]
    said = ledger.select("blob", F.inline("scans")).filter(F.col("rule").isin([_key(r) for r in rules]) & (F.size("spans") > 0))
    held = said.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    if (said.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        held = F.broadcast(held)
    rows = df.select(F.struct(*[df[c] for c in keep]).alias("row"), _blob(text).alias("blob"))
    return rows.join(held, "blob", "left").select("row.*", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias(out))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch that spans cover replaced by the mark of the first span's kind; sorted spans, overlaps are merged."""
    # Where what came before each span ends, and the span's own end if that is further.
    n = F.size(spans)
    ends = F.transform(spans, lambda s: s["end"])
    before = F.transform(spans, lambda s, i: F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0)))
    pieces = F.zip_with(
        spans,
        before,
        lambda s, b: F.when(s["start"] >= b, F.concat(F.substring(text, b + 1, F.greatest(s["start"] - b, F.lit(0))), F.lit("[secret:"), s["kind"], F.lit("]"))).otherwise(F.lit("")),
    )
    last = F.coalesce(F.array_max(ends), F.lit(0))
    return F.when(n > 0, F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)
