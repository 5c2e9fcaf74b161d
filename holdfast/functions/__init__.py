"""Column expressions and driver-side scalars."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(stem: str) -> str:
    """A name for a temporary column that no column of a user has."""
    return f"_{stem}_{uuid.uuid4().hex}"


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), x clipped to +-20."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def digitize(x: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds are <= x; NaN lies beyond all."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= x)) if thresholds else F.lit(0)


def route(x: Column, thresholds: Sequence[float], names: Sequence[str]) -> Column:
    """The name of x's bin; null where there are fewer names than bins."""
    return F.get(F.array(*[F.lit(n) for n in names]), digitize(x, thresholds))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def feature_key(features: Sequence[str], bits: bool = False) -> list[Column]:
    """Columns that are equal for duplicate rows. bits: -0.0 and 0.0 differ, as their bytes do."""
    return [F.col(c).cast("string") if bits else F.col(c) for c in features]


def hash_key(id_cols: Sequence[str], seed: int) -> Column:
    """A uniform pseudo-random key of a row: the order by it is the shuffle of this library."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def derive_seeds(base_seed: int, n: int, purpose: str) -> list[int]:
    """Seeds from the first eight hex digits of sha256 over base seed, purpose and number."""
    return [int(hashlib.sha256(f"{base_seed}|{purpose}|{i}".encode()).hexdigest()[:8], 16) for i in range(n)]


def derived_seed(base_seed: int, purpose: str, i: Column) -> Column:
    """derive_seeds() as an expression."""
    text = F.concat_ws("|", F.lit(str(base_seed)), F.lit(purpose), i.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
