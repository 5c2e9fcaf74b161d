"""Byte-pair encoding and decoding of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.bpe import default_path, vocabulary
from holdfast.llm.common import passes, table


def _encoder(source, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch, texts in passes(batches):
            ids, at = v.encode_texts(texts)
            each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            if digest:
                cols = {
                    "n_tokens": pa.array([len(x) for x in each], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(v.decode(x.tolist()).encode()).hexdigest() for x in each], pa.string()),
                }
            else:
                cols = {"ids": pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), "decoded": pa.array([v.decode(x.tolist()) for x in each], pa.string())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **cols})

    return encode


def _run(docs: DataFrame, path: str | None, digest: bool, schema: str) -> DataFrame:
    source = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())  # a vocabulary: of a fixed size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoder(source, digest), schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, decoded) of documents (doc_id, text), with the tokenizer file at path (on the driver).

    Null or empty text, or white space alone: no ids, decoded to ''. Repeated rows are encoded each; null doc_id stays
    null. Empty table: no rows. Further columns are ignored.
    """
    return _run(docs, path, False, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As encode(), with digests for the ids and the decoded text."""
    return _run(docs, path, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
