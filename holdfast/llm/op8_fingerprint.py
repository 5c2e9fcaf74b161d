"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions alone.

A fingerprint keeps every five-word shingle hash below a fixed fraction of the hash range, so fingerprints of very
unequal texts can be merged (union) and compared (containment). A text none of whose hashes is below keeps its
smallest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import table

#: One hash in so many is kept.
SCALE = 8
_BELOW = -(2**63) + 2**64 // SCALE
_LOWEST = -(2**63)
#: Rows that a bucket of the descending order should hold, and the bounds on the number of buckets.
BUCKET_ROWS, QUANTILES, MOST_BUCKETS = 1000, 256, 65_536


def sketch(text: Column) -> Column:
    """Sorted array of the kept hashes; empty for a text without words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    shingles = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= 5, F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))[0]
    return F.transform(F.array(shingles), lambda s: F.when(F.size(s) == 0, s).otherwise(F.sort_array(F.array_union(F.filter(s, lambda x: x < _BELOW), F.array(F.array_min(s))))))[0]


def as_text(kept: Column) -> Column:
    return F.concat_ws("", F.transform(kept, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the other: 1 if both are empty, 0 if one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def with_next(docs: DataFrame) -> DataFrame:
    """Add next_text and next_sketch: of the following row in descending doc_id, after the last of the first.

    The order is cut into buckets of about BUCKET_ROWS rows: quantiles of doc_id, each cut evenly. Rows of a bucket are
    sorted together; the top row of each bucket also goes, flagged, to the end of the bucket before it. What the driver
    holds is bounded by MOST_BUCKETS.
    """
    k = F.coalesce("doc_id", F.lit(_LOWEST))
    found = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    cuts = sorted({found["low"], *found["q"]} - {None}) if found["q"] else []
    parts = min(MOST_BUCKETS // QUANTILES, -(-found["n"] // (BUCKET_ROWS * QUANTILES))) or 1
    if cuts:
        at = F.lit(cuts)
        which = F.size(F.filter(at, lambda c: c <= F.col("doc_id")))
        low, high = F.get(at, which - 1), F.coalesce(F.get(at, which), F.lit(found["high"] + 1))
        share = F.floor((F.col("doc_id").cast("double") - low) * parts / F.greatest(high.cast("double") - low, F.lit(1.0))).cast("int")
        bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(which * parts + F.greatest(F.lit(0), F.least(share, F.lit(parts - 1))))
    else:
        bucket = F.lit(-1)
    docs = docs.withColumn("bucket", bucket.cast("int")).withColumn("k", k)
    # Of each bucket: its largest key, and the bucket to whose end its top rows go too: the next one up, for the last the first.
    each = Window.orderBy("bucket")  # MOST_BUCKETS rows and a few more
    tops = docs.groupBy("bucket").agg(F.max("k").alias("top"))
    tops = tops.select("bucket", "top", F.coalesce(F.lead("bucket").over(each), F.first("bucket").over(each)).alias("below"))
    docs = docs.join(F.broadcast(tops), "bucket")
    is_top, to = F.col("k") == F.col("top"), F.col("below")
    own = F.struct(F.col("bucket").alias("in"), F.lit(False).alias("borrowed"))
    rows = docs.withColumn("to", F.explode(F.when(is_top, F.array(own, F.struct(to.alias("in"), F.lit(True).alias("borrowed")))).otherwise(F.array(own))))
    order = Window.partitionBy("to.in").orderBy("to.borrowed", F.col("k").desc(), F.xxhash64("text"), "text")
    both = F.lead(F.struct("text", "sketch")).over(order)  # one window, so one shuffle
    return rows.withColumn("next", both).where("not to.borrowed").select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending doc_id (or all of it, if shorter). Likenesses are containments of the smaller sketch in the other.

    Null text: as empty. A text without words: empty fingerprint; like another such text 1, like others 0. Rows with
    equal doc_id follow each other by hash of text; null doc_id comes last. A single row is its own next document.
    Empty table: no rows. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
