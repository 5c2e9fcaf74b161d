"""Features from a first guess at the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import sigmoid
from holdfast.operators.splits import contiguous_folds


def build_indicators(yhat: Column, thresholds: Sequence[float], tau: float | Sequence[float] = 0.3) -> list[Column]:
    """sigmoid((yhat - t) / tau) for each threshold; tau is one number, or one for each (the shorter list decides)."""
    taus = [tau] * len(thresholds) if isinstance(tau, (int, float)) else list(tau)
    pairs = list(zip(thresholds, taus))
    if not pairs:
        raise ValueError("no thresholds")
    return [sigmoid((yhat - float(t)) / float(s)) for t, s in pairs]


def augment(df: DataFrame, yhat: str, thresholds: Sequence[float], tau: float | Sequence[float] = 0.3, prefix: str = "ind_") -> DataFrame:
    """The rows with their indicators; yhat stays behind them as a feature."""
    found = build_indicators(F.col(yhat), thresholds, tau)
    return df.select(*[c for c in df.columns if c != yhat], *[x.alias(f"{prefix}{i}") for i, x in enumerate(found)], yhat)


def oof_splits(df: DataFrame, order: Sequence[str], n_folds: int = 5) -> DataFrame:
    return contiguous_folds(df, order, n_folds)
