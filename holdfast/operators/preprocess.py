"""Preparation from training rows alone: imputation and normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import nan_to_null
from holdfast.operators.ranks import quantiles


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame | None
    stats: dict = field(default_factory=dict)


def medians(train: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of what isn't missing; None for a column without values."""
    return {c: (quantiles(train, c, [0.5]) or [None])[0] for c in features}


def _filled(df: DataFrame, found: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(m).cast("double")) for c, m in found.items()})


def fold_impute(train: DataFrame, test: DataFrame | None, features: Sequence[str]) -> Prepared:
    """Fill both sides with the medians of the training rows. A column that is all missing there stays missing."""
    found = medians(train, features)
    return Prepared(_filled(train, found), None if test is None else _filled(test, found), {"medians": found})


def moments(train: DataFrame, features: Sequence[str], name: str = "") -> DataFrame:
    """One row with mean and population deviation of each feature: null if any value is missing, as a mean that isn't told
    to skip missing values would be."""
    whole = lambda c, x: F.when(F.count(nan_to_null(F.col(c).cast("double"))) == F.count("*"), x)
    return train.agg(*[whole(c, F.avg(F.col(c).cast("double"))).alias(f"mean_{c}") for c in features], *[whole(c, F.stddev_pop(F.col(c).cast("double"))).alias(f"std_{c}") for c in features])


def _scaled(df: DataFrame, stats: dict, features: Sequence[str], floor) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(stats[f"mean_{c}"])) / F.lit(floor(stats[f"std_{c}"])) for c in features})


def fold_normalize(train: DataFrame, test: DataFrame | None, features: Sequence[str]) -> Prepared:
    """(x - mean) / std of the training rows; a deviation under 1e-12 counts as 1."""
    stats = moments(train, features).first().asDict()
    floor = lambda s: None if s is None else (1.0 if s < 1e-12 else s)
    return Prepared(_scaled(train, stats, features, floor), None if test is None else _scaled(test, stats, features, floor), stats)


def fold_safe_preprocess(train: DataFrame, test: DataFrame | None, features: Sequence[str], impute: bool = True, normalize: bool = True) -> Prepared:
    out = Prepared(train, test)
    for on, step in ((impute, fold_impute), (normalize, fold_normalize)):
        if on:
            got = step(out.train, out.test, features)
            out = Prepared(got.train, got.test, out.stats | got.stats)
    return out


def compute_norm_stats(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each feature for networks: the deviation is 1e-12 at least (another rule than fold_normalize())."""
    stats = moments(df, features).first()
    return {c: (stats[f"mean_{c}"], None if stats[f"std_{c}"] is None else max(stats[f"std_{c}"], 1e-12)) for c in features}


def normalize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def out_of_fold_moments(folded: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (fold, n, mean_*, std_*) of each fold's training rows, from one pass: counts, means and squared deviations of the
    folds are merged over the other folds, in a form that doesn't cancel."""
    parts = folded.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features], *[(F.var_pop(F.col(c).cast("double")) * F.count(F.col(c))).alias(f"q_{c}") for c in features])
    other = parts.select(*[F.col(c).alias(f"o_{c}") for c in parts.columns])
    both = parts.select("fold").join(other, F.col("fold") != F.col("o_fold"))  # as many rows as folds, squared
    total = both.groupBy("fold").agg(F.sum("o_n").alias("n"), *[(F.sum(F.col(f"o_m_{c}") * F.col("o_n")) / F.sum("o_n")).alias(f"mean_{c}") for c in features])
    merged = both.join(total, "fold").groupBy("fold").agg(F.max("n").alias("n"), *[F.max(f"mean_{c}").alias(f"mean_{c}") for c in features], *[F.sqrt(F.sum(F.col(f"o_q_{c}") + F.col("o_n") * (F.col(f"o_m_{c}") - F.col(f"mean_{c}")) ** 2) / F.max("n")).alias(f"std_{c}") for c in features])
    return merged
