"""Ridge regression from sums of products: one pass over the rows, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fresh


def gram_columns(features: Sequence[str], y: str) -> list[Column]:
    """Aggregates of the upper triangle of X'X and of X'y, X with a last column of ones."""
    xs = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    d = len(xs)
    out = [F.sum(xs[i] * xs[j]).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)]
    return out + [F.sum(x * F.col(y).cast("double")).alias(f"b_{i}") for i, x in enumerate(xs)]


def solve(row, d: int, alpha: float) -> np.ndarray:
    """Weights, the bias last and unpenalised. Raises numpy's LinAlgError if the system is singular."""
    g = np.zeros((d + 1, d + 1))
    for i in range(d + 1):
        for j in range(i, d + 1):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    g[np.arange(d), np.arange(d)] += alpha
    return np.linalg.solve(g, np.array([row[f"b_{i}"] for i in range(d + 1)]))


def ridge_solve(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> np.ndarray:
    """From centred sums, which don't cancel where a feature varies little about a large mean; from plain ones if values are missing."""
    d = len(features)
    xs = [F.col(c).cast("double") for c in [*features, y]]
    centred = [F.covar_pop(xs[i], xs[j]).alias(f"v_{i}_{j}") for i in range(d) for j in range(i, d + 1)]
    row = df.agg(*gram_columns(features, y), *centred, *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)], *[F.count(x).alias(f"n_{i}") for i, x in enumerate(xs)]).first()
    n = row[f"g_{d}_{d}"]
    if not n or any(row[f"n_{i}"] != n for i in range(d + 1)):
        return solve(row, d, alpha)
    g = np.array([[row[f"v_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) * n + alpha * np.eye(d)
    w = np.linalg.solve(g, np.array([row[f"v_{i}_{d}"] for i in range(d)]) * n)
    return np.append(w, row[f"m_{d}"] - sum(w[i] * row[f"m_{i}"] for i in range(d)))


def ridge_out_of_fold(folded: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> dict[int, np.ndarray]:
    """Weights for each fold, from the other folds: sums of all folds less the fold's own, one pass for all."""
    rows = folded.groupBy("fold").agg(*gram_columns(features, y)).collect()
    names = [c for c in rows[0].asDict() if c != "fold"] if rows else []
    return {r["fold"]: solve({c: sum(o[c] for o in rows if o["fold"] != r["fold"]) for c in names}, len(features), alpha) for r in rows}


def linear(features: Sequence[str], weights) -> Column:
    """The prediction of one weight vector as an expression."""
    return sum((F.col(c).cast("double") * float(w) for c, w in zip(features, weights)), F.lit(float(weights[-1])))


def ridge_predict(df: DataFrame, features: Sequence[str], weights, name: str = "pred") -> DataFrame:
    return df.withColumn(name, linear(features, weights))


def predict_by(df: DataFrame, features: Sequence[str], weights: dict, by: str, name: str = "pred") -> DataFrame:
    """Predictions with the weights of each row's value of `by`; null for a value without weights."""
    out = F.lit(None).cast("double")
    for key, w in weights.items():
        out = F.when(F.col(by) == F.lit(key), linear(features, w)).otherwise(out)
    return df.withColumn(name, out)


def _solver(d: int, alpha: float):
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [solve(r, d, alpha).tolist() for r in batch.to_pylist()]
            rest = [c for c in batch.schema.names if not c.startswith(("g_", "b_"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(weights, pa.list_(pa.float64()))], [*rest, "w"])

    return solved


class HierarchicalRidge:
    """Ridge models of nested groups, each shrunk towards its parent's: (1 - shrinkage) * own + shrinkage * parent's.

    The sums for all levels come from one rollup. A group with fewer than min_samples rows (a number, or one a level;
    levels past the list take the first) has no model, nor have its subgroups. A row takes the model of its deepest
    group that has one, else the global one. The weights of a level are a table (k0, k1, ..., w), groups in their own
    types (null is a group too), solved on the executors and joined level by level; nothing is collected.
    """

    def __init__(self, features: Sequence[str], y: str, groups: Sequence[str], alpha: float = 1.0, shrinkage: float = 0.2, min_samples: int | Sequence[int] = 10):
        self.features, self.y, self.groups = list(features), y, list(groups)
        self.alpha, self.shrinkage, self.min_samples = alpha, shrinkage, min_samples
        self.levels: list[DataFrame] | None = None

    def _least(self, level: int) -> int:
        m = self.min_samples
        return m if isinstance(m, int) else m[level] if level < len(m) else m[0]

    def fit(self, df: DataFrame) -> HierarchicalRidge:
        deep, d = len(self.groups), len(self.features)
        keys = [f"k{i}" for i in range(deep)]
        rows = df.select(*[F.col(g).alias(k) for g, k in zip(self.groups, keys)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)], F.col(self.y).cast("double").alias("y"))
        sums = rows.rollup(*keys).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), *gram_columns([f"x{i}" for i in range(d)], "y"))
        # Each bit of gid stands for a group that is rolled up, the last group lowest.
        sums = sums.where("n > 0").withColumn("level", F.lit(deep) - F.bit_count("gid")).drop("gid").persist()
        told = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "n long, level int, w array<double>"])
        solved = [sums.where((F.col("level") == level) & (F.col("n") >= (self._least(level - 1) if level else 0))).mapInArrow(_solver(d, self.alpha), told).select(*keys[:level], "w") for level in range(deep + 1)]
        self.levels = [solved[0]]
        for level in range(1, deep + 1):
            parent = self.levels[-1].withColumnsRenamed({**{k: f"p{k}" for k in keys}, "w": "pw"})
            same = F.lit(True)
            for k in keys[: level - 1]:
                same = same & F.col(k).eqNullSafe(F.col(f"p{k}"))
            if level == 1:
                parent = F.broadcast(parent)  # one row
            mixed = F.zip_with("w", "pw", lambda own, up: (1 - self.shrinkage) * own + self.shrinkage * up)
            self.levels.append(solved[level].join(parent, same).select(*keys[:level], mixed.alias("w")))
        self.levels = [t.persist() for t in self.levels]
        return self

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        if self.levels is None:
            raise RuntimeError("fit() comes first")
        own, found = fresh("key"), []
        out = df
        for level, table in enumerate(self.levels):
            w = fresh("w")
            table = table.withColumnsRenamed({**{f"k{i}": f"{own}{i}" for i in range(level)}, "w": w})
            same = F.lit(True)
            for i in range(level):
                same = same & F.col(self.groups[i]).eqNullSafe(F.col(f"{own}{i}"))
            out = out.join(table if level else F.broadcast(table), same, "left").drop(*[f"{own}{i}" for i in range(level)])  # level 0: one row
            found.insert(0, w)
        w = F.coalesce(*[F.col(c) for c in found])
        value = sum((F.col(c).cast("double") * w[i] for i, c in enumerate(self.features)), w[len(self.features)])
        return out.withColumn(name, value).drop(*found)

    def fit_predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return self.fit(df).predict(df, name)
