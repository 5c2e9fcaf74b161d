"""Snapshots of experiments: predictions as Parquet, what a model learned and the model itself as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from holdfast.operators.models import Model, restore

#: Bytes of a model's JSON beyond which it isn't stored unless forced.
LIMIT = 5_000_000


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    return x


def save_snapshot(save_dir: str, name: str, oof: DataFrame, final: DataFrame | None, learned: dict, force: bool = False, model: Model | None = None) -> bool:
    """Write predictions (dev rows without one stay null) and, if it is small enough, what the model learned and its state. False if it wasn't."""
    base = f"{save_dir}/snapshots/{name}"
    oof.write.mode("overwrite").parquet(f"{base}/oof")
    if final is not None:
        final.write.mode("overwrite").parquet(f"{base}/sanctified")
    text = json.dumps({"learned": _plain(learned), "state": _plain(model.state() if model is not None else None)})
    if len(text) > LIMIT and not force:
        return False
    spark = oof.sparkSession
    spark.createDataFrame([(text,)], "learned string").write.mode("overwrite").json(f"{base}/model")
    return True


def load_snapshot(spark: SparkSession, save_dir: str | None, name: str) -> dict:
    """oof, sanctified (if there is one), learned, and model, which predicts (both None if they were too large; model also if its
    state can't be told, see Model.state)."""
    if save_dir is None:
        raise ValueError("no save_dir")
    jvm, base = spark.sparkContext._jvm, f"{save_dir}/snapshots/{name}"

    def there(part: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{part}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    if not there("oof"):
        raise FileNotFoundError(base)
    told = json.loads(spark.read.schema("learned string").json(f"{base}/model").first()[0]) if there("model") else {"learned": None, "state": None}
    out = {"oof": spark.read.parquet(f"{base}/oof"), "learned": told["learned"], "model": restore(told["state"]) if told["state"] else None}
    if there("sanctified"):
        out["sanctified"] = spark.read.parquet(f"{base}/sanctified")
    return out
