"""Splits as tables. The shuffle behind them is the hash order of the ids, so no partitioning changes an assignment.

With compat_rng, it is the permutation of numpy's RandomState over rows (or sorted groups) in id order, for a bounded number of
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import digitize, fresh
from holdfast.operators.ranks import hash_ranked, ordered, permuted, quantiles, sliced
from holdfast.spec import DataError

RANK, _STRATUM, _G, _HELD, _M, _S = (fresh(n) for n in ("rank", "stratum", "group", "held", "size", "stratum"))


def _slices(n: int, k: int):
    if k < 2 or k > n:
        raise DataError(f"k={k} folds of {n} rows or groups")
    return F.least(F.floor(F.col(RANK) / F.lit(n // k)), F.lit(k - 1)).cast("int")


def _shuffled(df: DataFrame, id_cols: Sequence[str], seed: int, compat_rng: bool) -> DataFrame:
    return permuted(df, id_cols, seed, RANK) if compat_rng else hash_ranked(df, id_cols, seed, RANK)


def kfold(df: DataFrame, id_cols: Sequence[str], k: int = 5, seed: int = 42, compat_rng: bool = False) -> DataFrame:
    """The rows with a column fold, of n // k rows each; the last fold takes the remainder."""
    return _shuffled(df, id_cols, seed, compat_rng).withColumn("fold", _slices(df.count(), k)).drop(RANK)


def grouped_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, compat_rng: bool = False) -> DataFrame:
    """The rows with a column fold that is one for a whole group; folds balance groups, not rows. A null group is a group."""
    groups = df.select(F.col(group).alias(_G)).distinct()
    folds = _shuffled(groups, [_G], seed, compat_rng).withColumn("fold", _slices(groups.count(), k)).drop(RANK)
    return df.join(folds, F.col(group).eqNullSafe(F.col(_G))).drop(_G)


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """The rows with a column fold: stretches in the order of the given columns, unshuffled."""

    def starts(n: int) -> list[int]:
        if k < 2 or k > n:
            raise DataError(f"k={k} folds of {n} rows or groups")
        return [i * (n // k) for i in range(1, k)]

    return sliced(df, order, starts, "fold")


def train_test(df: DataFrame, id_cols: Sequence[str], test_fraction: float = 0.2, seed: int = 42, compat_rng: bool = False) -> DataFrame:
    """The rows with a column role: the first floor((1 - f) * n) in shuffled order train."""
    cut = int((1 - test_fraction) * df.count())
    return _shuffled(df, id_cols, seed, compat_rng).withColumn("role", F.when(F.col(RANK) < cut, "train").otherwise("test")).drop(RANK)


def temporal_split(df: DataFrame, order: Sequence[str], fraction: float = 0.15) -> DataFrame:
    """The rows with a column split: the last rows in time are sanctified, at least one row on either side."""
    n = df.count()
    if n < 2:
        raise DataError("a temporal split needs two rows")
    cut = min(max(int(n * (1 - fraction)), 1), n - 1)
    return ordered(df, order, RANK).withColumn("split", F.when(F.col(RANK) < cut, "dev").otherwise("sanctified")).drop(RANK)


def expanding_window(df: DataFrame, order: Sequence[str], k: int = 3, gap: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Membership rows (fold, role, columns): fold i trains on the first (i + 1) segments of n // (k + 1) rows and is tested on the
    next one less its first `gap` rows; the last test runs to the end. Folds without a test row are left out."""
    n = df.count()
    seg = n // (k + 1)
    folds = [(i, (i + 1) * seg, (i + 1) * seg + gap, n if i == k - 1 else (i + 2) * seg) for i in range(k)]
    folds = [f for f in folds if f[2] < f[3]]
    if seg < 1 or not folds:
        raise DataError(f"no expanding window of k={k}, gap={gap} over {n} rows")
    rows = ordered(df.select(*(columns or df.columns)), order, RANK)
    r = F.col(RANK)
    member = [F.when(r < train, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role"))).when((r >= start) & (r < end), F.struct(F.lit(i).alias("fold"), F.lit("test").alias("role"))) for i, train, start, end in folds]
    return rows.withColumn("m", F.explode(F.filter(F.array(*member), lambda m: m.isNotNull()))).select("m.fold", "m.role", *(columns or df.columns))


def strata(df: DataFrame, y: str, name: str = "stratum") -> DataFrame:
    """The rows with a column (stratum): the value of y, or its decile if y has over 20 values."""
    if df.select(y).distinct().limit(21).count() <= 20:
        return df.withColumn(name, F.col(y).cast("string"))
    edges = quantiles(df, y, [i / 10 for i in range(11)])
    edges[-1] += 1
    return df.withColumn(name, (digitize(F.col(y), edges) - 1).cast("string"))


def sanctified(df: DataFrame, id_cols: Sequence[str], fraction: float = 0.15, seed: int = 42, stratify: str | None = None, group: str | None = None, compat_rng: bool = False) -> DataFrame:
    """The rows with a column split, dev or sanctified: max(1, floor(n * f)) rows, or of whole groups, or in each stratum of
    several rows (a single row stays in dev)."""
    if group is not None:
        groups = df.select(F.col(group).alias(_G)).distinct()
        n = groups.count()
        if n < 2:
            raise DataError("a grouped holdout needs two groups")
        held = _shuffled(groups, [_G], seed, compat_rng).where(F.col(RANK) < max(1, int(n * fraction))).select(_G, F.lit(True).alias(_HELD))
        return df.join(held, F.col(group).eqNullSafe(F.col(_G)), "left").withColumn("split", F.when(F.col(_HELD), "sanctified").otherwise("dev")).drop(_G, _HELD)
    if stratify is not None:
        rows = strata(df, stratify, _STRATUM)
        sizes = rows.groupBy(_STRATUM).agg(F.count("*").alias(_M))
        ranked = permuted(rows, id_cols, seed, RANK, within=_STRATUM, sort=stratify) if compat_rng else hash_ranked(rows, id_cols, seed, RANK, within=[_STRATUM])
        out = ranked.join(sizes.withColumnRenamed(_STRATUM, _S), F.col(_STRATUM).eqNullSafe(F.col(_S))).drop(_S)
        held = (F.col(_M) > 1) & (F.col(RANK) < F.greatest(F.lit(1), F.floor(F.col(_M) * F.lit(float(fraction)))))
        return out.withColumn("split", F.when(held, "sanctified").otherwise("dev")).drop(RANK, _M, _STRATUM)
    n = df.count()
    if n < 2:
        raise DataError("a holdout needs two rows")
    return _shuffled(df, id_cols, seed, compat_rng).withColumn("split", F.when(F.col(RANK) < max(1, math.floor(n * fraction)), "sanctified").otherwise("dev")).drop(RANK)


def membership(folded: DataFrame, id_cols: Sequence[str], k: int) -> DataFrame:
    """Membership rows (fold, *ids, role) of rows with a column fold: each row is tested in its fold and trains in the others."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.when(F.col("fold") == i, "test").otherwise("train").alias("role")) for i in range(k)]))
    return folded.select(*id_cols, "fold").withColumn("m", each).select(F.col("m.f").alias("fold"), *id_cols, "m.role")


class FoldData(NamedTuple):
    fold: int
    train: DataFrame
    test: DataFrame
    n_folds: int


def iter_folds(members: DataFrame, n_folds: int | None = None) -> Iterator[FoldData]:
    """The folds of membership rows (fold, role, ...), each as two DataFrames."""
    numbers = range(n_folds) if n_folds is not None else sorted(r[0] for r in members.select("fold").distinct().collect())
    for i in numbers:
        train, test = (members.where((F.col("fold") == i) & (F.col("role") == role)).drop("fold", "role") for role in ("train", "test"))
        yield FoldData(i, train, test, len(numbers))
