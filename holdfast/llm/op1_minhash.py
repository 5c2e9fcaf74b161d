"""Near-duplicate documents by MinHash with tensored banding, every candidate confirmed on full shingle sets.

Two collections hold M sub-keys each, a sub-key being T minimum hashes. A table key is a pair of one sub-key from either
collection, so M * M tables of 2 * T hashes each cost only 2 * M * T minimum hashes.

Documents with equal shingle sets are one class from the start. In a bucket, all classes are compared with its smallest
one; once components are known, each class outside the bucket's largest component is compared with the classes of other
components there, in parts of PART_CLASSES. Classes in one component need no link among them, so no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import discard, passes, spread_join, table, written
from holdfast.llm.components import components
from holdfast.llm.textops import U, Words, shingle_sets

M, T = 10, 3
_RANDOM = np.random.Generator(np.random.PCG64(7))
_MUL = _RANDOM.integers(1, 2**63, (2 * M * T, 1), U) * U(2) + U(1)
_ADD = _RANDOM.integers(0, 2**63, (2 * M * T, 1), U)
PERCENT = 85
#: Classes of a bucket that one task of the second comparison compares with the others of the bucket.
PART_CLASSES = 1000

#: Words of a set's parity bitmap, and which column holds each.
BITS = 8
_BIT_COLUMNS = [f"b{i}" for i in range(BITS)]
SKETCH = "doc_id long, text_key struct<a:long,b:long>, n_shingles long, set_key binary, left array<long>, right array<long>, " + ", ".join(f"{c} long" for c in _BIT_COLUMNS)


def sub_keys(shingles: np.ndarray) -> np.ndarray:
    """The 2 * M sub-keys of a set: those of the left collection first."""
    low = np.full(2 * M * T, 2**64 - 1, U)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at : at + 4096] * _MUL + _ADD).min(axis=1))
    low = low.reshape(2 * M, T)
    key = low[:, 0]
    for i in range(1, T):
        key = (key ^ (key >> U(31))) * U(0x9E3779B97F4A7C15) + low[:, i]
    return key.view(np.int64)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """BITS words: bit k says whether an odd number of shingles fall on it. Two sets' bitmaps differ in |x ^ y| bits at most."""
    odd = np.bincount((shingles % U(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch, texts in passes(batches):
        sets = shingle_sets(Words(texts, lower=True))
        keys = [sub_keys(s) if len(s) else None for s in sets]
        bits = np.array([parity_bits(s) for s in sets]).reshape(-1, BITS)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "left": pa.array([None if k is None else k[:M] for k in keys], pa.list_(pa.int64())),
                "right": pa.array([None if k is None else k[M:] for k in keys], pa.list_(pa.int64())),
                **{c: pa.array(bits[:, i]) for i, c in enumerate(_BIT_COLUMNS)},
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        sets = shingle_sets(Words(texts, lower=True))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, a = [], None, None
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])

    return confirm


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """A table of the pairs (a, b) of class ids whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = reps.select("id", F.col("low.doc_id").alias("doc_id"), F.col("low.text_key").alias("text_key")).join(ids, "id")
    sets = written(docs.join(wanted, ["doc_id", "text_key"]).select("id", "text").mapInArrow(_sets, "id long, shingles binary"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    out = written(pairs.join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long"))
    discard(sets)
    return out


def text_key(text):
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def near_classes(docs: DataFrame, percent: int = PERCENT, join_ids: bool = True) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, low) of documents (doc_id, text), one for each; low: the smallest (doc_id, text_key) of the
    row's component, null without shingles or doc_id.

    join_ids: texts that share a doc_id are in one component. Else the likeness of texts alone links them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    sketches = written(docs.mapInArrow(_sketch, SKETCH))
    live = sketches.where("set_key is not null and doc_id is not null")
    # The id of a class is its smallest doc_id, or, where several classes have that, the hash of its set.
    reps = live.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("low"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), *[F.first(c).alias(c) for c in _BIT_COLUMNS])
    several = F.count("*").over(Window.partitionBy("low.doc_id")) > 1
    reps = written(reps.withColumn("id", F.when(several, F.xxhash64("set_key")).otherwise(F.col("low.doc_id"))))
    keys = F.array(*[F.xxhash64(F.lit(M * i + j), F.col("left")[i], F.col("right")[j]) for i in range(M) for j in range(M)])
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("id", "n", "left", "right").repartition(n_parts, "id").select("id", "n", F.explode(keys).alias("bucket")).repartition(n_parts, "bucket")
    hubs = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = written(rows.join(hubs.hint("shuffle_hash"), "bucket").select("bucket", "id", "n", "hub"))

    enough = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    first = written(buckets.where(F.col("id") > F.col("hub.id")).where(enough(F.col("n"), F.col("hub.n"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    links = confirmed(first, docs, reps, percent)
    if join_ids:
        torn = live.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a < b").select("doc_id")
        named = live.join(torn, "doc_id").select("doc_id", "set_key").distinct().join(reps.select("set_key", "id"), "set_key")
        same = named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
        alone, links = links, written(links.unionByName(same.where("a != b")))
        discard(alone)
    parts = written(components(links))

    labelled = buckets.select("bucket", "id", "n").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("parts"), F.sum("k").alias("all"))
    main = main.where("parts > 1").select("bucket", F.col("most.component").alias("main"), F.ceil((F.col("all") - F.col("most.k")) / PART_CLASSES).cast("int").alias("split"))
    # |x ^ y| is at least the count of bits in which the bitmaps differ, so J >= p needs (100 + p) * bits <= (100 - p) * (|x| + |y|).
    bits = reps.select("id", *_BIT_COLUMNS)
    mixed = written(labelled.join(main, "bucket").join(bits, "id"))
    rest = mixed.where("component != main").withColumn("part", F.pmod(F.xxhash64("id"), F.col("split")).cast("int"))
    other = mixed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"), *[F.col(c).alias(f"{c}_2") for c in ("id", "n", "component", *_BIT_COLUMNS)])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in _BIT_COLUMNS), F.lit(0))
    near = (F.col("component") != F.col("component_2")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_2")))
    more = rest.join(other, ["bucket", "part"]).where(near & enough(F.col("n"), F.col("n_2"))).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    more = written(more.join(first, ["a", "b"], "left_anti"))
    late = confirmed(more, docs, reps, percent)
    if not late.isEmpty():
        parts = written(components(links.unionByName(late)))
    discard(buckets, first, links, mixed, more, late)

    labels = reps.select("set_key", "low", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("set_key", "low", F.coalesce("component", "id").alias("component"))
    lowest = labels.groupBy("component").agg(F.min("low").alias("low"))
    named = labels.select("set_key", "component").join(lowest, "component").select("set_key", "low")
    out = spread_join(sketches.select("doc_id", "text_key", "n_shingles", "set_key"), named, "set_key", "text_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("low"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a set has the distinct five-word shingles, or the whole
    sequence with fewer words. Two documents are linked if 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable, kept says whether it is the document's own.

    Null or empty text, or text without words: no shingles, linked with nothing, its component_id its doc_id. Null doc_id: component_id null,
    kept true; such rows link nothing. Rows that repeat a doc_id are one document with the links of all its texts, and
    each is returned. Empty table: no rows. Further columns are ignored.
    """
    out = near_classes(docs, percent).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low.doc_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each group of near-duplicate texts the row of the smallest doc_id, with all its columns; texts are compared as in
    near_duplicates, but each for itself: a text isn't dropped for what else has its doc_id.

    Texts without words are like nothing and stay. Of rows that repeat a doc_id and its text one stays, that of the
    smallest other columns. A row without doc_id stays. Empty table: no rows. Further columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("text_key")).alias("key"))
    found = near_classes(docs, percent, join_ids=False)
    gone = found.select(F.struct("doc_id", "text_key").alias("key"), "low").where("low is not null and key != low").select("key").distinct()
    kept = rows.join(gone, "key", "left_anti")
    one = kept.where("key.doc_id is not null").groupBy("key").agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(kept.where("key.doc_id is null").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY ALL) ON node = d.doc_id
"""
