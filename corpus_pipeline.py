"""The corpus pipeline over `documents`: quality classifier, line dedup, MinHash near-dedup, secret scans, packing.

Every stage works on all rows that the one before kept; all but the last return the columns of documents. Where a stage
changes text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table, written
from holdfast.llm.op1_minhash import keep_one
from holdfast.llm.op2_classifier import keep_good
from holdfast.llm.op5_secrets import redact_secrets
from holdfast.llm.op6_packing import pack
from holdfast.llm.op9_lines import dedup_lines

#: Two documents of the pipeline are near duplicates from this similarity of their five-word shingles, in percent.
NEAR_PERCENT = 80
_WORD = r"[^\x20\x09-\x0D]"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good: rows of docs whose score is THRESHOLD or more. Each row has its own
    score, so rows that repeat stay or go together; null and empty texts have one too. Empty table: no rows."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with an earlier document; one that had words and has none left goes. What a null
    or empty text, a tie of doc_id or a repeated row becomes says dedup_lines. Empty table: no rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    out = dedup_lines(rows)
    worded = lambda text: F.coalesce(text.rlike(_WORD), F.lit(False))
    out = out.where((F.col("n_removed") == 0) | worded(F.col("text")) | ~worded(F.col("row.text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id. What a text without words, a null or tied doc_id
    or a repeated row becomes says keep_one. Empty table: no rows."""
    return keep_one(docs, NEAR_PERCENT).select(*[F.col(f"`{c}`") for c in docs.columns])


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced by a mark; null and empty texts stay, repeated rows are treated each. Empty table: no
    rows."""
    return redact_secrets(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of 2048 tokens; null and empty texts give one piece each, repeated rows are packed
    each. Empty table: no rows."""
    return pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_common_lines),
    ("minhash_near_dedup", dedup_near),
    ("secret_scans", scan_secrets),
    ("retrieval_packing", pack_windows),
]
#: No SQL: the classifier, the random field and the packing order can't be said in it. Tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns; what each stage before it returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
