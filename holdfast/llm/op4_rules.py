"""Quality rules of documents and of hosts.

A host is a value of `source`. Its share of documents that fail the base rules is shrunk towards the shares of all
hosts by a beta prior fitted to them (by moments); hosts whose shrunk share is over HOST_LIMIT are rejected, and the
verdict is joined back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import passes, salted_join, table, written
from holdfast.llm.textops import SHINGLE, Words, windows

HOST_LIMIT = 0.5
_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(h: np.ndarray) -> int:
    """Words in five-word windows found twice or more; h: window hashes of a text in order."""
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    covered = np.zeros(len(h) + SHINGLE - 1, bool)
    for i in range(SHINGLE):
        covered[i : i + len(h)] |= twice
    return int(covered.sum())


def metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts)
    b = words.buf[: words.text_ends[-1] + 1] if len(texts) else words.buf[:0]
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))
    chars = upto(((b & 0xC0) != 0x80) & (b != 32) & ((b < 9) | (b > 13)))
    symbols = upto(_SYMBOL[b])
    w = windows(words.hashes())
    dup_lines, repeats = [], []
    for text, i, j in zip(texts, words.first[:-1].tolist(), words.first[1:].tolist()):
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup_lines.append(len(lines) - len(set(lines)))
        repeats.append(repeated_words(w[i : j - SHINGLE + 1]) if j - i > SHINGLE else 0)
    span = lambda c: c[words.text_ends] - c[words.text_starts]
    return dict(zip(METRICS, (np.diff(words.first), span(chars), span(symbols), np.array(dup_lines), np.array(repeats))))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        found = metrics(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *(pa.array(found[m].astype(np.int64)) for m in METRICS)], ["doc_id", "source", *METRICS])


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Rows (source, n, failed, shrunk_rate, host_failed) of hosts, from rows (source, base_failed).

    With shares p of mean m and variance v over hosts, the prior is beta(m * s, (1 - m) * s), s = m * (1 - m) / v - 1. If
    v is 0 all hosts have the mean share; if s isn't positive (every host fails or passes whole) there is nothing to shrink.
    """
    hosts = judged.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(p).alias("m"), F.var_pop(p).alias("v")).withColumn("s", F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1))
    hosts = hosts.join(F.broadcast(prior))  # one row
    rate = F.when(F.col("s") > 0, (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))).when(F.col("v") > 0, p).otherwise(F.col("m"))
    return hosts.withColumn("shrunk_rate", rate).select("source", "n", "failed", "shrunk_rate", (F.col("shrunk_rate") > HOST_LIMIT).alias("host_failed"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of documents
    (doc_id, text, source).

    Null or empty text: zeros, so base_failed. Null source: no host, so the base rules decide alone. Repeated rows
    count, and are returned, each. Empty table: no rows. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_measure, "doc_id long, source string, " + ", ".join(f"{m} long" for m in METRICS))
    rows = written(rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    out = salted_join(rows, host_verdicts(rows).select("source", "host_failed"), "source", "doc_id", "left")
    return out.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
five AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM five), range(0, 5) r(k) WHERE c > 1 GROUP BY ALL),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
base AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT m, v, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 END AS s FROM (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM host)),
bad AS (SELECT source FROM host, prior WHERE CASE WHEN s > 0 THEN (failed + m * s) / (n + s) WHEN v > 0 THEN failed / n ELSE m END > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""
