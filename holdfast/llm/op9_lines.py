"""Line dedup by pairwise alignment of overlapping documents.

A line of a later document goes if it is in a block of lines, MIN_WORDS words or more in all, that an earlier document
holds too. Such documents share the hash of a window, the shortest stretch of lines from a line on (or up to it) that has
MIN_WORDS words; every line of a shared block is in a shared window. Each document is aligned by patience diff with the
earliest holder of each of its windows, and aligned common blocks go. What an alignment must leave, because the common
blocks stand in another order or repeat, is looked up at the place where the holder has the window and goes as well. So
whatever earlier document is aligned, the same lines go, and the result is that of aligning all pairs.

Only line hashes and word counts are shuffled; the texts are joined with what is to be deleted from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import passes, spread_join, table, written

#: Words that a deleted block has at least.
MIN_WORDS = 10
KEY = "struct<id:long,t:long>"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs, given in order of their first place, whose second places rise too."""
    ends: list[int] = []
    tops: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(tops[at - 1] if at else -1)
        ends[at : at + 1], tops[at : at + 1] = [j], [k]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of equal lines of a[a0:a1] and b[b0:b1] that are unique in either; without any, of those that are the same
    occurrence of their line."""
    many_a, many_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {b[j]: j for j in range(b0, b1)}
    once = [(i, where[a[i]]) for i in range(a0, a1) if many_a[a[i]] == 1 and many_b.get(a[i]) == 1]
    if once or many_a.keys().isdisjoint(many_b):
        return once
    seen: Counter[int] = Counter()
    places = {}
    for j in range(b0, b1):
        places[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen.clear()
    for i in range(a0, a1):
        if (j := places.get((a[i], seen[a[i]]))) is not None:
            once.append((i, j))
        seen[a[i]] += 1
    return once


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matching places of two sequences, rising in both: anchors are matched along a longest rising run, matches grow over equal
    neighbours, and the gaps between them are aligned the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if chain := rising(anchors(a, b, a0, a1, b0, b1)):
            out += chain
            ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


def aligned_lines(a: list[int], b: list[int], words: list[int]) -> set[int]:
    """Places in b of aligned blocks, matches that are adjacent in both sequences, of MIN_WORDS words or more; words: of b's."""
    found: set[int] = set()
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= MIN_WORDS:
                found.update(block)
            block = []
        block.append(j)
        last = (i, j)
    return found


def windows(words: list[int]) -> list[tuple[int, int]]:
    """First and last line of each window: the shortest stretch of MIN_WORDS words from a line on, and up to a line."""
    out, i, total = set(), 0, 0
    for j, w in enumerate(words):  # up to j
        total += w
        while total - words[i] >= MIN_WORDS:
            total -= words[i]
            i += 1
        if total >= MIN_WORDS:
            out.add((i, j))
    j, total = len(words) - 1, 0
    for i in range(len(words) - 1, -1, -1):  # from i on
        total += words[i]
        while total - words[j] >= MIN_WORDS:
            total -= words[j]
            j -= 1
        if total >= MIN_WORDS:
            out.add((i, j))
    return sorted(out)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        hashes, words, places, second = [], [], [], []
        for t in texts:
            lines = t.split(b"\n")
            counts = [len(x.split()) for x in lines]
            at = [i for i, n in enumerate(counts) if n]
            hashes.append([xxhash.xxh3_64_intdigest(lines[i]) - 2**63 for i in at])
            words.append([counts[i] for i in at])
            places.append([0, *at[1:], len(lines)])
            second.append(xxhash.xxh3_64_intdigest(t) - 2**63)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(second, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))],
            ["key", "t2", "l", "w", "p"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, h, first, last = [], [], [], []
        for k, (lines, words) in enumerate(zip(batch.column("l"), batch.column("w").to_pylist())):
            data = memoryview(lines.values.to_numpy().tobytes())
            for i, j in windows(words):
                at.append(k)
                h.append(xxhash.xxh3_64_intdigest(data[8 * i : 8 * j + 8]) - 2**63)
                first.append(i)
                last.append(j)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "h", "i", "j"])


def deleted(a: list[int], b: list[int], words: list[int], shared: list[tuple[int, int, int]]) -> set[int]:
    """Places in b of lines that go: aligned blocks, and of the shared windows (place in a, first, last place in b) those that the
    alignment leaves. Windows that share a hash alone don't count."""
    gone = aligned_lines(a, b, words)
    for at, i, j in shared:
        if not gone.issuperset(range(i, j + 1)) and a[at : at + j + 1 - i] == b[i : j + 1]:
            gone.update(range(i, j + 1))
    return gone


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for a, b, w, p, shared in zip(*(batch.column(c).to_pylist() for c in ("la", "lb", "w", "p", "shared"))):
            found = deleted(a, b, w, [(x["at"], x["i"], x["j"]) for x in shared])
            gone.append([x for k in sorted(found) for x in range(p[k], p[k + 1])])
        yield pa.RecordBatch.from_arrays([batch.column("later"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def line_list(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def common_with_any(one: DataFrame) -> DataFrame:
    """Rows (key, gone): the lines that an earlier document has in common, from a table (key, l, w, p) of documents."""
    each = written(one.select("key", "l", "w").mapInArrow(_windows, f"key {KEY}, h long, i int, j int"))
    shared = each.groupBy("h").agg(F.min(F.struct("key", "i")).alias("first"), F.max("key").alias("last")).where("first.key < last").select("h", "first")
    held = spread_join(each, shared, "h", "key").where("key > first.key")
    pairs = held.groupBy(F.col("first.key").alias("earlier"), F.col("key").alias("later")).agg(F.collect_list(F.struct(F.col("first.i").alias("at"), "i", "j")).alias("shared"))
    b = one.select(F.col("key").alias("later"), F.col("l").alias("lb"), "w", "p")
    found = spread_join(written(pairs.join(b, "later")), one.select(F.col("key").alias("earlier"), F.col("l").alias("la")), "earlier", "later")
    gone = found.select("later", "la", "lb", "w", "p", "shared").mapInArrow(_align, f"key {KEY}, gone array<int>")
    return gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; deleted lines are gone from text, and n_removed says how many.

    Lines are parts between newlines, words are `[^\\x20\\x09-\\x0D]+`. Earlier is the smaller doc_id, and with equal doc_id
    (null is the largest) the smaller hash of text. A line without words is no part of a block; it goes with the line
    with words before it, at the start of a text with the one after it. Equal texts are aligned once: later copies lose
    all their lines if the text has MIN_WORDS words; their text is then ''. Rows that repeat a doc_id and its text are
    one document and get one result. Null text stays null. Empty table: no rows. A column n_removed of the input is
    replaced; other columns may have any names.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    each = docs.where("text is not null").select(key.alias("key"), F.col("text").cast("string").alias("text"))
    each = written(each.mapInArrow(_lines, f"key {KEY}, t2 long, l array<long>, w array<int>, p array<int>"))
    copies = each.groupBy(F.col("key.t").alias("t"), "t2").agg(F.min("key").alias("key")).select("key")
    one = written(each.join(copies, "key", "left_semi").dropDuplicates(["key"]))
    later = each.join(copies, "key", "left_anti").where(F.aggregate("w", F.lit(0), lambda s, x: s + x) >= MIN_WORDS)
    whole = later.select("key", F.sequence(F.lit(0), F.element_at("p", -1) - 1).alias("gone")).dropDuplicates(["key"])
    fates = written(common_with_any(one).unionByName(whole))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key")).join(fates, "key", "left")
    kept = F.filter(line_list(F.col("row.text").cast("string")), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "n_removed"], F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, kept_sha256): lines of the document, lines deleted, digest of what is left."""
    docs = table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text", F.size(line_list(F.col("text"))).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH line AS MATERIALIZED (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
worded AS MATERIALIZED (
  SELECT doc_id, pos, line, words, row_number() OVER w AS g, sum(words) OVER w AS upto FROM line WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
whole AS MATERIALIZED (SELECT doc_id, list(line ORDER BY pos) AS ls FROM worded GROUP BY doc_id),
stretch AS (
  SELECT a.doc_id, a.g AS i, b.g AS j, md5(array_to_string(ls[a.g:b.g], chr(10))) AS run
  FROM worded a JOIN worded b ON b.doc_id = a.doc_id AND b.g BETWEEN a.g AND a.g + 9 JOIN whole ON whole.doc_id = a.doc_id
  WHERE b.upto - a.upto + a.words >= 10 AND (b.upto - b.words - a.upto + a.words < 10 OR b.upto - a.upto < 10)),
late AS (SELECT doc_id, i, j FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM stretch) WHERE doc_id > first),
gone AS (SELECT DISTINCT w.doc_id, w.g FROM late JOIN worded w ON w.doc_id = late.doc_id AND w.g BETWEEN late.i AND late.j),
owned AS (SELECT line.*, greatest(1, count(*) FILTER (words > 0) OVER (PARTITION BY doc_id ORDER BY pos)) AS g FROM line)
SELECT doc_id, count(*) AS n_lines, count(gone.g) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.g IS NULL), '')) AS kept_sha256
FROM owned LEFT JOIN gone USING (doc_id, g) GROUP BY doc_id
"""
