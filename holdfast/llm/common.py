"""What the operators of this subpackage share: tables, written intermediates, salted joins, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the small side of a join whose key can be hot; each row of the large side picks one of them.
SALTS = 8
#: Parts at most that a hot key is dealt to where copies are made for those parts alone that there are.
SPREAD = 1024
#: Bytes of text that one numpy pass handles; bounds the memory of a Python worker.
PASS_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/holdfast-shared"


def written(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The files go with discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/holdfast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that written() made and that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(large: DataFrame, small: DataFrame, key: str, salt_of: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be hot in `large` and is unique in `small`: SALTS tasks share each key.

    salt_of: a column of `large` whose hash picks the copy.
    """
    few = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    many = large.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)).cast("int"))
    return many.join(few, [key, "_salt"], how).drop("_salt")


def spread_join(large: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be very hot in `large` and is unique in `small`: up to SPREAD tasks share each key.

    A row of `large`, best a table since it is read twice, has a part by the hash of column spread_by; `small` is copied to
    those parts of a key that there are, so keys of few rows cost few copies.
    """
    many = large.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int"))
    copies = many.select(key, "_part").distinct().join(small, key)
    return many.join(copies, [key, "_part"], how).drop("_part")


def give_back() -> None:
    """Return to the system what the allocators of this process hold free: a Python worker outlives its task, beside those of other
    stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def passes(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text (one row at least), with the texts as UTF-8; null counts as empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        at = 0
        while at < batch.num_rows:
            texts, size, end = [], 0, at
            while end < batch.num_rows and (not texts or size < limit):
                texts.append(column[end].as_py() or b"")
                size += len(texts[-1])
                end += 1
            yield batch.slice(at, end - at), texts
            at = end
        batch = column = texts = None
        give_back()
