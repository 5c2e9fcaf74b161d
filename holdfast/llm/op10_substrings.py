"""Exact substring dedup over a corpus by longest-previous-factor arrays.

A string of LENGTH bytes is marked by the smallest hash of its grams, so equal strings have equal marks. Marks that occur
twice anywhere are found by counting; the stretches of a text whose strings have one such mark are its runs. Runs of
equal bytes are one member of the mark's class, with a count and a first occurrence. Only classes with several members,
or with one that holds its mark twice, are compared on bytes: in suffix order, the nearest earlier positions on either side
give each position's longest previous factor, and the nearest later ones its longest next factor. Where the first has
LENGTH bytes a later copy starts, which goes while the first stays; where either has, all copies go.

Texts are deduplicated first and lie in a table bucketed by a hash, where what is found about them is joined without
moving them; the table is dropped in the end. A class of more than CLASS members is never gathered: hashes of its strings are counted instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import discard, passes, salted_join, shared_dir, table, written
from holdfast.llm.lpf import LENGTH, anchors, other_factors, runs
from holdfast.llm.textops import U

#: Members of a class that are compared in one task; bytes that one comparison takes.
CLASS, TOGETHER = 20_000, 1_000_000
RANGES = "array<struct<a:int,b:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        found = []
        for t in texts:
            mark, n = np.unique(anchors(np.frombuffer(t, np.uint8)), return_counts=True)
            found.append(np.concatenate((mark, mark[n > 1])).view(np.int64))  # a mark's second place counts too
        yield pa.RecordBatch.from_arrays([batch.column("k1"), pa.array(found, pa.list_(pa.int64()))], ["k1", "marks"])


RUN = "k1 long, k2 long, mark long, same long, lo int, hi int, inner boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        rows: list[tuple] = []
        for t, k1, k2, marks in zip(texts, *(batch.column(c).to_pylist() for c in ("k1", "k2", "marks"))):
            lo, hi, mark, inner = runs(np.frombuffer(t, np.uint8), np.sort(np.array(marks, np.int64).view(U)))
            for a, b, m, i in zip(lo.tolist(), hi.tolist(), mark.view(np.int64).tolist(), inner.tolist()):
                rows.append((k1, k2, m, xxhash.xxh3_64_intdigest(t[a : b + LENGTH]) - 2**63, a, b, i))
        cols = list(zip(*rows)) or [()] * 7
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], ["k1", "k2", "mark", "same", "lo", "hi", "inner"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        out: dict[str, list] = {"mark": [], "same": [], "first": [], "bytes": []}
        for t, k2, wanted in zip(texts, *(batch.column(c).to_pylist() for c in ("k2", "wanted"))):
            for w in wanted:
                if w["k2"] == k2:
                    out["mark"].append(w["mark"])
                    out["same"].append(w["same"])
                    out["first"].append(w["first"])
                    out["bytes"].append(t[w["lo"] : w["hi"] + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(out["mark"], pa.int64()), pa.array(out["same"], pa.int64()), pa.array(out["first"], pa.string()), pa.array(out["bytes"], pa.binary())], ["mark", "same", "first", "bytes"])


def ranges_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true flags: first and last places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"a": a, "b": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


FOUND = f"mark long, same long, twice {RANGES}, later {RANGES}"


def _found(marks: list, sames: list, twice: list, later: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sames, pa.int64()), pa.array(twice, _RANGES), pa.array(later, _RANGES)], ["mark", "same", "twice", "later"])


def compare(members: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Of members (mark, same, bytes), classes together and each in order of first occurrence: which of a member's starts
    have their LENGTH bytes at an earlier or a later place of the class, and which at an earlier one."""
    sizes = np.array([len(b) for _, _, b in members])
    at = np.cumsum(sizes) - sizes
    many = sizes - LENGTH + 1
    begin = np.cumsum(many) - many
    starts = np.arange(many.sum()) + np.repeat(at - begin, many)
    group = np.repeat(np.cumsum([i > 0 and members[i][0] != members[i - 1][0] for i in range(len(members))]), many)
    lpf, lnf = other_factors(np.frombuffer(b"".join(b for _, _, b in members), np.uint8), starts, group)
    spans = list(zip(begin.tolist(), (begin + many).tolist()))
    return _found([m for m, _, _ in members], [s for _, s, _ in members], [ranges_of(np.maximum(lpf[a:b], lnf[a:b]) >= LENGTH) for a, b in spans], [ranges_of(lpf[a:b] >= LENGTH) for a, b in spans])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over members sorted by class and first occurrence; holds whole classes of about TOGETHER bytes, or one class."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for m, s, b in zip(*(batch.column(c).to_pylist() for c in ("mark", "same", "bytes"))):
            if size > TOGETHER and held[-1][0] != m:
                yield compare(held)
                held, size = [], 0
            held.append((m, s, b))
            size += len(b)
    if held:
        yield compare(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m, s, first, b in zip(*(batch.column(c).to_pylist() for c in ("mark", "same", "first", "bytes"))):
            n = len(b) - LENGTH + 1
            yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int64()), pa.array([s] * n, pa.int64()), pa.array([first] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(b[i : i + LENGTH]) for i in range(n)], pa.binary())], ["mark", "same", "first", "at", "string"])


def _by_counting(members: DataFrame) -> DataFrame:
    """What compare() finds, for classes of any size: strings are counted by hash."""
    rows = written(members.mapInArrow(_strings, "mark long, same long, first string, at int, string binary"))
    place = F.struct("first", "same", "at")
    seen = rows.groupBy("string").agg(F.count("*").alias("k"), F.min(place).alias("low")).where("k > 1")
    hit = salted_join(rows, seen, "string", "same").withColumn("late", F.col("low") != place)
    return hit.groupBy("mark", "same").agg(F.sort_array(F.collect_list("at")).alias("twice"), F.sort_array(F.collect_list(F.when(F.col("late"), F.col("at")))).alias("later")).mapInArrow(_as_ranges, FOUND)


def _as_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ranges(at: list[int]) -> list[dict[str, int]]:
        flags = np.zeros(max(at, default=-1) + 1, bool)
        flags[at] = True
        return ranges_of(flags)

    for batch in batches:
        twice, later = ([ranges(x) for x in batch.column(c).to_pylist()] for c in ("twice", "later"))
        yield _found(batch.column("mark").to_pylist(), batch.column("same").to_pylist(), twice, later)


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed stretches, and the rest, if LENGTH bytes from each start in the ranges go."""
    gone = np.zeros(len(text) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[b + LENGTH] -= 1
    flags = np.cumsum(gone[:-1]) > 0
    return int(flags.sum()), len(ranges_of(flags)), np.frombuffer(text, np.uint8)[~flags].tobytes()


def _removed(texts_too: bool):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in passes(batches):
            out = []
            for t, k2, ranges in zip(texts, *(batch.column(c).to_pylist() for c in ("k2", "ranges"))):
                out.append(cut(t, [(r["a"], r["b"]) for r in ranges if r["k2"] == k2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[2] if texts_too else None for x in out], pa.binary())],
                ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return removed


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table bucketed by a key, in the shared folder, so that joins on the key don't move it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"holdfast_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(name)
    out.scratch, out.table = path, name
    return out


def dedup_substrings(docs: DataFrame, keep_first: bool = False, with_text: bool = False, class_members: int = CLASS) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of documents (doc_id, text), taken as UTF-8 bytes.

    Each byte of a LENGTH-byte string that also starts anywhere else, in this or another row, is removed; strings are
    judged on the input, and none crosses rows. keep_first: only strings that also start earlier count, by doc_id (null
    last) and then position, so that the first copy stays; of rows equal in doc_id and text one is the first.
    with_text: kept is what is left, as bytes.

    Null text: as empty. Texts under LENGTH bytes lose nothing. Repeated rows are copies of each other. Empty table: no
    rows. Further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(text)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), part(1).alias("k1"), part(17).alias("k2"))
    rows = written(keyed.select("order", "doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    counts = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("order").alias("low"))

    once = keyed.where(F.octet_length("text") >= LENGTH).groupBy("k1").agg(F.collect_set(F.struct("k2", "text")).alias("all")).select("k1", F.explode("all").alias("x")).select("k1", "x.k2", "x.text")
    texts = bucketed(once, "k1")
    marks = written(texts.select("k1", "text").mapInArrow(_anchors, "k1 long, marks array<long>"))
    rows_of_marks = marks.select("k1", F.explode("marks").alias("mark"))
    shared = rows_of_marks.groupBy("mark").agg(F.count("*").alias("k")).where("k > 1").select("mark")
    listed = salted_join(rows_of_marks, shared, "mark", "k1").groupBy("k1").agg(F.collect_set("mark").alias("marks"))
    members = written(texts.join(listed.hint("merge"), "k1").select("k1", "k2", "text", "marks").mapInArrow(_runs, RUN))

    # The first occurrence of a member, in an order that texts inherit from their first copies; padded to sort as strings.
    low = counts.select(F.struct("k1", "k2").alias("key"), "low", "copies")
    placed = members.join(low, (members.k1 == F.col("key.k1")) & (members.k2 == F.col("key.k2"))).drop("key")
    first = F.concat(F.format_string("%020d", F.col("low")), F.format_string("%012d", F.col("lo")), F.format_string("%020d", F.col("k1")), F.format_string("%020d", F.col("k2")))
    placed = written(placed.withColumn("first", first))
    each = written(placed.groupBy("mark", "same").agg(F.count("*").alias("n"), F.min(F.struct("first", "k1", "k2", "lo", "hi")).alias("low"), F.max("inner").alias("inner")))
    sizes = each.groupBy("mark").agg(F.count("*").alias("members"), F.max("inner").alias("inner")).where("members > 1 or inner").drop("inner")
    several = salted_join(each, sizes, "mark", "same")
    wanted = several.groupBy(F.col("low.k1").alias("k1")).agg(F.collect_list(F.struct(F.col("low.k2").alias("k2"), "mark", "same", F.col("low.first").alias("first"), F.col("low.lo").alias("lo"), F.col("low.hi").alias("hi"))).alias("wanted"))
    bodies = written(texts.join(wanted.hint("merge"), "k1").select("k2", "text", "wanted").mapInArrow(_members, "mark long, same long, first string, bytes binary"))
    huge = sizes.where(F.col("members") > class_members).select("mark")
    alone = bodies.join(huge, "mark", "left_anti").repartition("mark").sortWithinPartitions("mark", "first", "same").drop("first").mapInArrow(_compare, FOUND)
    counted = _by_counting(bodies.join(huge, "mark", "left_semi"))
    found = written(alone.unionByName(counted))

    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("low.hi") - F.col("low.lo")).alias("b")))
    none = F.array().cast(RANGES)
    fates = each.join(found, ["mark", "same"], "left").select(F.struct("mark", "same").alias("run"), F.col("low.first").alias("is_first"), F.when(F.col("n") > 1, whole).otherwise(F.coalesce("twice", none)).alias("twice"), F.coalesce("later", none).alias("later"), whole.alias("whole"))
    told = salted_join(placed.select(F.struct("mark", "same").alias("run"), "first", "k1", "k2", "lo"), fates, "run", "k1")
    ranges = F.when(F.col("first") == F.col("is_first"), F.col("later")).otherwise(F.col("whole")) if keep_first else F.col("twice")
    told = told.withColumn("r", F.explode(ranges)).groupBy("k1").agg(F.collect_set(F.struct("k2", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))).alias("ranges"))
    partly = texts.join(told.hint("merge"), "k1").select("k1", "k2", "text", "ranges").mapInArrow(_removed(with_text), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    partly = written(partly.where("n_removed > 0"))
    docs.sparkSession.sql(f"DROP TABLE {texts.table}")
    discard(texts, marks, members, placed, each, bodies, found)

    verdicts = counts.join(partly, ["k1", "k2"], "left").select(F.struct("k1", "k2").alias("key"), "copies", "low", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
    out = salted_join(rows.withColumn("key", F.struct("k1", "k2")).withColumn("dice", F.struct("doc_id", "key")), verdicts, "key", "dice")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    if keep_first:
        from pyspark.sql import Window

        again = F.row_number().over(Window.partitionBy("key", "order").orderBy("doc_id")) > 1
        copy = copy & ((F.col("order") > F.col("low")) | again)
    empty = F.sha2(F.lit(""), 256)
    extra = [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *extra,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
