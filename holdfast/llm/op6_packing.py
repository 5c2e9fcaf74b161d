"""Packing of tokenised documents into training sequences by lexical retrieval.

The inverted index is sharded by content: a document's terms, its distinct tokens, are ranked by hashes that favour rare
ones (those of high merge rank), so that documents which share rare terms are likely to have the same first and second
term. Documents of a first term share a shard, or shards by second term if they are many, and what is still too large,
such as very many copies, is dealt evenly. A shard holds about SHARD_DOCS documents, whole ones in its index; a long one
counts for as many as the windows that it reaches into, since long ones share their rarest terms and would fill a shard.

A document fills whole windows of its own as far as it can; its rest is packed. A seed, the smallest unused document,
opens a window; BM25 ranks the unused documents of the shard for it, and those whose rests fit go in by rank. The best
one that doesn't fit is cut to close the window, and its rest opens the next one. The last tokens of a shard form
sequences whose lengths are powers of two, so no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.bpe import default_path, vocabulary
from holdfast.llm.common import passes, salted_join, table, written
from holdfast.llm.textops import U, mix

WINDOW, END_ID = 2048, 1
SHARD_DOCS = 1000
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_RANKED = mix(np.arange(1 << 16, dtype=U) + U(1)) >> U(11)
#: Of each token, an exponential draw from its hash over a weight that grows with its id; the smallest ones of a text are its terms.
DRAW = (-np.log((_RANKED.astype(np.float64) + 1) / 2**53) / np.log(2 + np.arange(1 << 16)) ** 4).astype(np.float64)


def first_terms(ids: np.ndarray) -> tuple[int, int]:
    """The two tokens of the smallest draws (one twice if there is no other). Texts with equal token sets have equal ones."""
    terms = np.unique(ids)
    low = terms[np.argsort(DRAW[terms], kind="stable")[:2]]
    return int(low[0]), int(low[-1])


def _tokens(source, window: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch, texts in passes(batches):
            ids, at = v.encode_texts(texts)
            out: dict[str, list] = {"doc_tokens": [], "full": [], "ids": [], "k1": [], "k2": []}
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                whole = np.append(ids[a:b], np.uint16(END_ID))
                n = len(whole) // window
                wide = whole[: n * window].astype("<u4")
                out["doc_tokens"].append(len(whole))
                out["full"].append(np.array([zlib.crc32(wide[i : i + window].tobytes()) for i in range(0, n * window, window)], "<u4").tobytes())
                out["ids"].append(whole.astype("<u2").tobytes())
                k1, k2 = first_terms(whole)
                out["k1"].append(k1)
                out["k2"].append(k2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["doc_tokens"], pa.int64()), pa.array(out["full"], pa.binary()), pa.array(out["ids"], pa.binary()), pa.array(out["k1"], pa.int32()), pa.array(out["k2"], pa.int32())], ["doc_id", *out])

    return tokens


class Index:
    """BM25 over the token ids of a shard's documents. Terms in more than half of them have no weight."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        keys = np.sort(np.concatenate([d.astype(np.int64) for d in docs]) << 32 | np.repeat(np.arange(n), lengths))
        keys, tf = np.unique(keys, return_counts=True)
        term, self.doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int64)
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        tf = tf.astype(np.float64)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / lengths.mean()))).astype(np.float32)
        self.at = np.concatenate(([0], np.cumsum(df)))
        self.useful = (idf > 0) & (df > 1)
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = np.unique(query)
        terms = terms[self.useful[terms]]
        if not len(terms):
            return np.zeros(self.n, np.float32)
        begin, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        return np.bincount(self.doc[rows], self.weight[rows], self.n)


def fill(docs: list[np.ndarray], window: int = WINDOW, rests: list[int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (number of the document, start, length) that hold every token of the documents' rests once; rests: their
    lengths, by default those of the documents."""
    index = Index(docs) if docs else None
    lengths = [len(d) for d in docs] if rests is None else rests
    unused = np.ones(len(docs), bool)
    sequences, open_, room, seed = [], [], window, 0
    while True:
        if not open_:
            while seed < len(docs) and not unused[seed]:
                seed += 1
            if seed == len(docs):
                break
            unused[seed] = False
            open_, room, about = [(seed, 0, lengths[seed])], window - lengths[seed], seed
        left = np.flatnonzero(unused)
        if len(left):
            score = index.scores(docs[about])[left]
            order = left[np.argsort(-score, kind="stable")].tolist()
            cut = None
            for d in order:
                if lengths[d] <= room:
                    unused[d] = False
                    open_.append((d, 0, lengths[d]))
                    room -= lengths[d]
                    if not room:
                        break
                elif cut is None:
                    cut = d
            if room and cut is not None:
                unused[cut] = False
                open_.append((cut, 0, room))
                sequences.append(open_)
                open_, room, about = [(cut, room, lengths[cut] - room)], window - lengths[cut] + room, cut
                continue
        if not room or unused.any():
            sequences.append(open_)
            open_, room = [], window
            continue
        break
    # The last window isn't full: cut it into powers of two, largest first.
    while open_:
        total = sum(p[2] for p in open_)
        size, sequence = 1 << (total.bit_length() - 1), []
        while size:
            d, start, length = open_.pop(0)
            take = min(length, size)
            sequence.append((d, start, take))
            size -= take
            if take < length:
                open_.insert(0, (d, start + take, length - take))
        sequences.append(sequence)
    return sequences


def _pack(window: int):
    def pack(group: pa.Table) -> pa.Table:
        doc_ids = group.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
        order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, ids[i].tobytes()))
        number = group.column("shard")[0].as_py() << 40 | group.column("piece")[0].as_py() << 20
        last = number + (1 << 20)
        out: list[tuple] = []
        for i, full in enumerate(group.column("full").to_pylist()):
            for k, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
                out.append((doc_ids[i], k * window, window, crc, len(ids[i]), number, 0))
                number += 1
        order = [i for i in order if len(ids[i]) % window]
        for sequence in fill([ids[i] for i in order], window, [len(ids[i]) % window for i in order]):
            offset = 0
            for d, start, length in sequence:
                i = order[d]
                start += len(ids[i]) // window * window
                crc = zlib.crc32(ids[i][start : start + length].astype("<u4").tobytes())
                out.append((doc_ids[i], start, length, crc, len(ids[i]), number, offset))
                offset += length
            number += 1
        if number > last:
            raise ValueError("a shard has more than 2 ** 20 sequences")
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table({name: pa.array(col, pa.int64()) for name, col in zip(names, zip(*out))})

    return pack


def sharded(rows: DataFrame) -> DataFrame:
    """Add shard and piece to a table with columns k1, k2, row and doc_tokens: groups of some SHARD_DOCS rows, 2 * SHARD_DOCS where
    terms are shared by so many; a row counts once for each WINDOW begun. The driver holds a row for each token of the vocabulary."""
    size = F.sum(F.floor(F.col("doc_tokens") / WINDOW) + 1).alias("n")
    shard, room, plan = 0, SHARD_DOCS, []
    for k1, n in sorted((r["k1"], r["n"]) for r in rows.groupBy("k1").agg(size).collect()):
        parts = -(-n // SHARD_DOCS)
        if n > room:
            shard, room = shard + 1, SHARD_DOCS
        plan.append((k1, shard, parts))
        room -= n
        if parts > 1:
            shard, room = shard + parts, SHARD_DOCS
    spark = rows.sparkSession
    told = rows.join(F.broadcast(spark.createDataFrame(plan, "k1 int, base long, parts long")), "k1")  # a row for each token at most
    told = told.withColumn("shard", F.col("base") + F.pmod(F.xxhash64("k2"), F.col("parts"))).drop("base", "parts")
    large = told.groupBy("shard").agg(size).where(F.col("n") > 2 * SHARD_DOCS).select("shard", F.ceil(F.col("n") / SHARD_DOCS).alias("pieces"))
    # A table, whose size is known before the join: a small one is broadcast, and the rows stay where they are.
    told = salted_join(told, written(large), "shard", "row", "left")
    return told.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0).cast("long"))).drop("pieces")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece, of documents (doc_id, text).

    Null or empty text: its closing id alone, one piece. Null doc_id stays null; repeated rows are packed each. Texts of
    any length are cut at windows. Ties of BM25 go to the smaller doc_id. Empty table: no rows. Further columns are
    ignored.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())  # a vocabulary: of a fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokens(source, window), "doc_id long, doc_tokens long, full binary, ids binary, k1 int, k2 int")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    return sharded(rows).groupBy("shard", "piece").applyInArrow(_pack(window), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
