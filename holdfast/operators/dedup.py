"""Exact duplicates: reports and three ways to remove them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import feature_key
from holdfast.spec import DatasetSpec


@dataclass
class DedupResult:
    """rows, and the counts that the strategy reports (computed when asked for)."""

    rows: DataFrame
    counts: DataFrame

    def report(self) -> dict[str, int]:
        return self.counts.first().asDict()


def _first(spec: DatasetSpec):
    return F.struct(*spec.id_cols)


def duplicate_pairs(df: DataFrame, spec: DatasetSpec, bits: bool = False) -> DataFrame:
    """Rows (first_*, dup_*): each later copy with the first row of its key, by id. NaN equals NaN; null equals null."""
    keys = feature_key(spec.features, bits)
    first = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(_first(spec)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    on = [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.join(first, on).where(_first(spec) > F.col("_first"))
    return rows.select(*[F.col(f"_first.{c}").alias(f"first_{c}") for c in spec.id_cols], *[F.col(c).alias(f"dup_{c}") for c in spec.id_cols])


def dedup_exact(df: DataFrame, spec: DatasetSpec, bits: bool = False) -> DedupResult:
    """Drop all copies of duplicated rows. Keys are grouped with partial counts, so a hot key is never gathered."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(feature_key(spec.features, bits))]
    rest = [c for c in df.columns]
    kept = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    counts = kept.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n_dropped"), F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("n_groups"))
    return DedupResult(kept.where("_n = 1").select("_row.*"), counts)


def dedup_average(df: DataFrame, spec: DatasetSpec, bits: bool = False) -> DedupResult:
    """One row for each key: the first by id, with the mean target of all copies."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(feature_key(spec.features, bits))]
    rest = [c for c in df.columns if c != spec.target and c not in spec.id_cols]
    kept = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(spec.target).alias("_y"), F.min(F.struct(*spec.id_cols, *rest)).alias("_row"))
    rows = kept.select("_row.*", F.col("_y").alias(spec.target)).select(*df.columns)
    return DedupResult(rows, kept.agg(F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("n_merged"), F.count("*").alias("n_unique")))


def dedup_keep_first(df: DataFrame, spec: DatasetSpec, bits: bool = False) -> DedupResult:
    """The first row of each key, by id."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(feature_key(spec.features, bits))]
    rest = [c for c in df.columns if c not in spec.id_cols]
    kept = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*spec.id_cols, *rest)).alias("_row"))
    rows = kept.select("_row.*").select(*df.columns)
    return DedupResult(rows, kept.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_dropped"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_before")))


def apply_dedup(df: DataFrame, spec: DatasetSpec, strategy: str | None = "average", warn_frac: float = 0.10, bits: bool = False) -> DataFrame:
    """average, keep-first, exact or None (features and target become double). Warns if more than warn_frac is affected."""
    doubles = [*spec.features, *([spec.target] if spec.target else [])]
    df = df.withColumns({c: F.col(c).cast("double") for c in doubles})
    if strategy is None:
        return df
    ways = {"average": (dedup_average, "n_merged", "n_unique"), "keep-first": (dedup_keep_first, "n_dropped", "n_before"), "exact": (dedup_exact, "n_dropped", None)}
    if strategy not in ways:
        raise ValueError(f"unknown dedup strategy {strategy!r}: one of {sorted(ways)} or None")
    way, part, whole = ways[strategy]
    out = way(df, spec, bits)
    counts = out.report()
    total = counts[whole] if whole else df.count()
    if total and counts[part] / total > warn_frac:
        warnings.warn(f"{strategy}: {counts[part]} of {total} rows are affected", stacklevel=2)
    return out.rows
