"""Networks without a model object around them: one or several by seed, on features as they are or normalised first.

All networks of a call train in one job. Their l2 is 0.01 unless told, unlike a model's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.nn import NetConfig, predict_networks, train_many
from holdfast.operators.preprocess import compute_norm_stats, normalize
from holdfast.spec import DataError

Net = list[np.ndarray]
L2 = 0.01


def ensemble_train(df: DataFrame, features: Sequence[str], y: str, order: Sequence[str], hidden_sizes: Sequence[int], epochs: int, seeds: Sequence[int], **settings) -> list[Net]:
    """A network for each seed. order: id columns that fix the order of rows; settings: further ones of NetConfig."""
    configs = [NetConfig(hidden_sizes=tuple(hidden_sizes), epochs=epochs, seed=s, **{"l2": L2, **settings}) for s in seeds]
    nets = train_many(df.withColumn("fold", F.lit(0)), features, y, order, configs)
    if configs and not nets:
        raise DataError("no rows to train on")
    return [nets[(0, i)] for i in range(len(configs))]


def train_nl(df: DataFrame, features: Sequence[str], y: str, order: Sequence[str], hidden_sizes: Sequence[int], epochs: int, seed: int, **settings) -> Net:
    return ensemble_train(df, features, y, order, hidden_sizes, epochs, [seed], **settings)[0]


def predict_nl(df: DataFrame, features: Sequence[str], net: Net, name: str = "pred") -> DataFrame:
    return predict_networks(df, features, [net], name)


def ensemble_predict(df: DataFrame, features: Sequence[str], nets: Sequence[Net], name: str = "pred") -> DataFrame:
    """The mean of the networks' predictions."""
    return predict_networks(df, features, nets, name)


def fit_ensemble(df: DataFrame, features: Sequence[str], y: str, order: Sequence[str], hidden_sizes: Sequence[int], epochs: int, seeds: Sequence[int], **settings) -> tuple[list[Net], dict]:
    """Networks on normalised features, and the means and deviations that normalised them."""
    stats = compute_norm_stats(df, features)
    return ensemble_train(normalize(df, stats), features, y, order, hidden_sizes, epochs, seeds, **settings), stats


def predict_ensemble(df: DataFrame, features: Sequence[str], nets: Sequence[Net], stats: dict, name: str = "pred") -> DataFrame:
    return predict_networks(df, features, nets, name, stats)
