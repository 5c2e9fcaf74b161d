"""Exact ranks without a one-partition window.

Rows are cut into buckets that follow the order; counts of buckets give offsets, and rows are numbered within their
bucket. A bucket table has BUCKETS rows (for each partition value) whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import fresh, hash_key
from holdfast.spec import DataError

_BUCKET, _COUNT, _BEFORE, _HASH, _X, _PART, _POS, _OWN = (fresh(n) for n in ("bucket", "count", "before", "hash", "x", "part", "pos", "own"))
#: Hex digits that make a bucket of a hash order; quantiles that cut any other order.
HEX, QUANTILES = 3, 256
#: Rows that permuted() takes at most: its permutation is drawn on the driver.
PERMUTED_ROWS = 10_000_000


def _numbered(df: DataFrame, bucket: Column, order: list[Column], name: str, within: Sequence[str]) -> DataFrame:
    within = list(within)
    rows = df.withColumn(_BUCKET, bucket)
    counts = rows.groupBy(*within, _BUCKET).agg(F.count("*").alias(_COUNT))
    before = F.sum(_COUNT).over(Window.partitionBy(*within).orderBy(_BUCKET)) - F.col(_COUNT)
    offsets = counts.withColumn(_BEFORE, before).drop(_COUNT)
    same = F.lit(True)
    for c in [*within, _BUCKET]:
        offsets = offsets.withColumnRenamed(c, f"{_OWN}{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"{_OWN}{c}"))
    if not within:
        offsets = F.broadcast(offsets)  # 16 ** HEX or QUANTILES + 1 rows
    number = F.row_number().over(Window.partitionBy(*within, _BUCKET).orderBy(*order))
    out = rows.join(offsets, same).withColumn(name, F.col(_BEFORE) + number - 1)
    return out.drop(_BUCKET, _BEFORE, *[f"{_OWN}{c}" for c in [*within, _BUCKET]])


def hash_ranked(df: DataFrame, id_cols: Sequence[str], seed: int, name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based rank in the hash order of the ids (ties by id), within equal values of some columns or overall."""
    df = df.withColumn(_HASH, hash_key(id_cols, seed))
    return _numbered(df, F.substring(_HASH, 1, HEX), [F.col(_HASH), *[F.col(c) for c in id_cols]], name, within).drop(_HASH)


def _cut(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the number (_BUCKET) of the stretch of about n / QUANTILES rows that a row lies in, -1 where the first column is null."""
    kind = df.schema[order[0]].dataType.typeName()
    x = F.unix_micros(F.col(order[0]).cast("timestamp")) if "timestamp" in kind or kind == "date" else F.col(order[0])
    rows = df.withColumn(_X, x)
    cuts = rows.agg(F.percentile_approx(_X, [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []), key=lambda c: (c != c, c))  # NaN last
    steps = [2**i for i in reversed(range(len(cuts).bit_length()))]
    below = lambda at, step: at + F.when(F.get(F.lit(cuts), at + step - 1) <= F.col(_X), step).otherwise(0)  # noqa: E731  a binary search
    return rows.withColumn(_BUCKET, F.when(F.col(_X).isNull(), F.lit(-1)).otherwise(F.aggregate(F.lit(steps), F.lit(0), below) if cuts else F.lit(0))).drop(_X)


def ordered(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank in the order of some columns (nulls first); the first one must be a number or a time."""
    rows = _cut(df, order)
    return _numbered(rows.withColumnRenamed(_BUCKET, _X), F.col(_X), [F.col(c) for c in order], name, ()).drop(_X)


def sliced(df: DataFrame, order: Sequence[str], places: Callable[[int], Sequence[int]], name: str) -> DataFrame:
    """Add how many of some ranks, places(number of rows), are at most a row's rank in ordered().

    Only the buckets in which such a rank lies are sorted, to find the row there; all rows are compared with that one. If it is
    tied with the row before, or can't be a literal, rows are numbered instead.
    """
    kinds = {c: df.schema[c].dataType for c in order}
    rows = _cut(df.select(*dict.fromkeys(order)), order)
    ends, n = {}, 0
    for r in sorted(rows.groupBy(_BUCKET).count().collect()):
        ends[r[0]] = (n, n := n + r[1])
    at = sorted(places(n))
    need = {p - i for p in at for i in (0, 1) if 0 <= p - i < n}
    inside = {b: first for b, (first, last) in ends.items() if any(first <= p < last for p in need)}
    if all(t.typeName() in ("byte", "short", "integer", "long", "float", "double", "string", "date") or t.typeName().startswith("decimal") for t in kinds.values()):
        first = F.lit(None).cast("long")
        for bucket, k in inside.items():
            first = F.when(F.col(_BUCKET) == bucket, F.lit(k)).otherwise(first)
        numbered = rows.where(F.col(_BUCKET).isin(list(inside))).withColumn(_POS, first + F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*order)) - 1)
        key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
        met = numbered.where(F.col(_POS).isin(list(need))).select(_POS, key.alias("key")).collect()
        keys = {r[_POS]: tuple(r["key"]) for r in met}
        if all(p <= 0 or p >= n or keys[p] != keys[p - 1] for p in at) and not any(v != v for key in keys.values() for v in key):
            passed = [F.lit(1 if p <= 0 else 0) if p <= 0 or p >= n else (key >= F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(keys[p], kinds.values()))])).cast("int") for p in at]
            return df.withColumn(name, sum(passed, F.lit(0)))
    rank = F.col(_POS)
    return ordered(df, order, _POS).withColumn(name, sum(((rank >= p).cast("int") for p in at), F.lit(0))).drop(_POS)


def permuted(df: DataFrame, order: Sequence[str], seed: int, name: str = "rank", within: str | None = None, sort: str | None = None) -> DataFrame:
    """Add the place that numpy's RandomState(seed).permutation gives each row, rows numbered in the given order. within: a column
    of few values, each permuted on its own by one generator, in the order of their smallest `sort`.

    For results that must equal those of a Mersenne Twister; hash_ranked() has no bound on rows.
    """
    parts = df.groupBy(within).agg(F.count("*").alias("n"), F.min(sort).alias("s")).orderBy("s").collect() if within else [{"n": df.count()}]
    if sum(p["n"] for p in parts) > PERMUTED_ROWS:
        raise DataError(f"a permutation takes {PERMUTED_ROWS} rows at most")
    draw = np.random.RandomState(seed)
    places = [np.argsort(draw.permutation(p["n"])) for p in parts]
    sizes = [len(p) for p in places]
    table = {_POS: np.concatenate([np.arange(n) for n in sizes]), name: np.concatenate(places)}
    if within:
        table |= {_PART: np.repeat([str(p[within]) for p in parts], sizes)}
    numbered = df.withColumn(_PART, F.coalesce(F.col(within).cast("string"), F.lit("None")) if within else F.lit(""))
    numbered = numbered.withColumn(_POS, (F.row_number().over(Window.partitionBy(_PART).orderBy(*order)) - 1).cast("long"))
    found = df.sparkSession.createDataFrame(pa.table({c: pa.array(v) for c, v in table.items()}))
    return numbered.join(found, [_PART, _POS] if within else _POS).select(*[F.col(f"`{c}`") for c in df.columns], name)


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, over rows that are neither null nor NaN; [] without any."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = x.count()
    if not n:
        return []
    spots = [(n - 1) * s for s in shares]
    need = sorted({k for p in spots for k in (int(p), min(int(p) + 1, n - 1))})
    at = {r["rank"]: r["x"] for r in ordered(x, ["x"]).where(F.col("rank").isin(need)).collect()}
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in spots]
