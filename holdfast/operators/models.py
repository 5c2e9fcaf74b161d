"""Models over DataFrames: fit(df, features, y, order), predict(df, name), clone(), analyze()."""

from __future__ import annotations

import copy
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import route
from holdfast.operators.metrics import scores
from holdfast.operators.nn import NetConfig, predict_networks, train_many
from holdfast.operators.preprocess import compute_norm_stats, normalize
from holdfast.operators.ridge import predict_by, ridge_out_of_fold, ridge_predict, ridge_solve
from holdfast.operators.splits import contiguous_folds


class Model(ABC):
    """order: id columns, which also make training independent of partitioning."""

    features: list[str] | None = None

    @abstractmethod
    def fit(self, df: DataFrame, features: Sequence[str], y: str, order: Sequence[str]) -> Model: ...

    @abstractmethod
    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame: ...

    def clone(self) -> Model:
        new = copy.copy(self)
        new.features = None
        return new

    def predict_out_of_fold(self, folded: DataFrame, k: int, features: Sequence[str], y: str, order: Sequence[str], name: str = "pred") -> DataFrame:
        """The rows of k folds (a column fold), each predicted by a clone fitted to the other folds."""
        parts = []
        for i in range(k):
            m = self.clone().fit(folded.where(F.col("fold") != i), features, y, order)
            parts.append(m.predict(folded.where(F.col("fold") == i), name))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def analyze(self) -> dict:
        self.check_fitted()
        return {}

    def state(self) -> dict | None:
        """All that prediction needs, as plain values, for restore(); None if a model can't be told so (it holds a function)."""
        return None

    def check_fitted(self) -> None:
        if self.features is None:
            raise RuntimeError(f"{type(self).__name__}: fit() comes first")

    def score(self, df: DataFrame, y: str) -> float:
        return scores(self.predict(df, "_p"), y, "_p").first()["r2"]


class RidgeModel(Model):
    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, df, features, y, order):
        self.weights = ridge_solve(df, features, y, self.alpha)
        self.features = list(features)
        return self

    def predict(self, df, name="pred"):
        self.check_fitted()
        return ridge_predict(df, self.features, self.weights, name)

    def predict_out_of_fold(self, folded, k, features, y, order, name="pred"):
        """One pass for all folds, and one plan for all rows."""
        return predict_by(folded, features, ridge_out_of_fold(folded, features, y, self.alpha), "fold", name)

    def analyze(self):
        self.check_fitted()
        return {"weights": dict(zip(self.features, self.weights[:-1].tolist())), "bias": float(self.weights[-1])}

    def state(self):
        return {"kind": "ridge", "features": self.features, "alpha": self.alpha, "weights": [float(w) for w in self.weights]}


class NLModel(Model):
    """One network on normalised features."""

    def __init__(self, config: NetConfig | None = None, **settings):
        self.config = replace(config or NetConfig(), **settings)

    def _fit_nets(self, df, features, y, order, configs):
        self.stats = compute_norm_stats(df, features)
        nets = train_many(normalize(df, self.stats).withColumn("fold", F.lit(0)), features, y, order, configs)
        self.features = list(features)
        return [nets[(0, i)] for i in range(len(configs))]

    def fit(self, df, features, y, order):
        self.net = self._fit_nets(df, features, y, order, [self.config])[0]
        return self

    def predict(self, df, name="pred"):
        self.check_fitted()
        return predict_networks(df, self.features, [self.net], name, self.stats)

    def analyze(self):
        self.check_fitted()
        return {"layer_norms": [float(np.linalg.norm(w)) for w in self.net[::2]], "n_params": sum(p.size for p in self.net)}

    def state(self):
        return {"kind": "network", "features": self.features, "config": asdict(self.config), "stats": {c: [float(x) for x in self.stats[c]] for c in self.features}, "net": [p.tolist() for p in self.net]}


class EnsembleModel(Model):
    """The mean of members: one base with n_seeds seeds (networks among them train in one job), or given models."""

    def __init__(self, base: Model | None = None, n_seeds: int = 3, base_seed: int = 42, models: Sequence[Model] | None = None):
        if (base is None) == (models is None):
            raise ValueError("either base or models")
        self.base, self.n_seeds, self.base_seed, self.models = base, n_seeds, base_seed, models

    def fit(self, df, features, y, order):
        if isinstance(self.base, NLModel):
            configs = [replace(self.base.config, seed=self.base_seed + i) for i in range(self.n_seeds)]
            worker = self.base.clone()
            self.members = []
            for c, net in zip(configs, worker._fit_nets(df, features, y, order, configs)):
                m = NLModel(c)
                m.net, m.stats, m.features = net, worker.stats, list(features)
                self.members.append(m)
        else:
            made = [self.base.clone() for _ in range(self.n_seeds)] if self.base is not None else [m.clone() for m in self.models]
            self.members = [m.fit(df, features, y, order) for m in made]
        self.features = list(features)
        return self

    def predict_members(self, df, prefix="pred_"):
        self.check_fitted()
        for i, m in enumerate(self.members):
            df = m.predict(df, f"{prefix}{i}")
        return df

    def predict(self, df, name="pred"):
        self.check_fitted()
        if all(isinstance(m, NLModel) for m in self.members) and self.base is not None:
            return predict_networks(df, self.features, [m.net for m in self.members], name, self.members[0].stats)
        out = self.predict_members(df, "_m")
        cols = [F.col(f"_m{i}") for i in range(len(self.members))]
        return out.withColumn(name, sum(cols[1:], cols[0]) / len(cols)).drop(*[f"_m{i}" for i in range(len(cols))])

    def analyze(self):
        self.check_fitted()
        return {"members": [m.analyze() for m in self.members]}

    def state(self):
        told = [m.state() for m in self.members]
        return None if None in told else {"kind": "ensemble", "features": self.features, "members": told}


class StackedModel(Model):
    """A second model on features with the first one's out-of-fold predictions.

    augment: append, replace, or a function of (df, features, prediction column) that returns (df, features). oof_folds
    contiguous chunks in id order; 0 takes in-sample predictions.
    """

    def __init__(self, first: Model, second: Model, augment: str | Callable = "append", oof_folds: int = 5):
        self.first, self.second, self.how, self.oof_folds = first, second, augment, oof_folds

    def _augmented(self, df, features, name):
        if self.how == "append":
            return df, [*features, name]
        if self.how == "replace":
            return df, [name]
        if callable(self.how):
            return self.how(df, list(features), name)
        raise ValueError(f"unknown augment {self.how!r}")

    def fit(self, df, features, y, order):
        self.one = self.first.clone().fit(df, features, y, order)
        if self.oof_folds:
            folded = contiguous_folds(df, order, self.oof_folds)
            rows = self.first.predict_out_of_fold(folded, self.oof_folds, features, y, order, "_first")
        else:
            rows = self.one.predict(df, "_first")
        rows, cols = self._augmented(rows, features, "_first")
        self.two = self.second.clone().fit(rows, cols, y, order)
        self.features = list(features)
        return self

    def predict(self, df, name="pred"):
        self.check_fitted()
        rows, _ = self._augmented(self.one.predict(df, "_first"), self.features, "_first")
        return self.two.predict(rows, name).select(*df.columns, name)

    def analyze(self):
        self.check_fitted()
        return {"first": self.one.analyze(), "second": self.two.analyze()}

    def state(self):
        told = [self.one.state(), self.two.state()]
        return None if None in told or callable(self.how) else {"kind": "stacked", "features": self.features, "augment": self.how, "models": told}


class RoutedModel(Model):
    """Experts by route. route_fn: (df, router prediction column or None) to a Column of keys. An expert trains on the rows of
    its half-open target range, else on those routed to it; under min_samples rows, on all. Rows with an unknown key get 0.
    """

    def __init__(self, router: Model | None, experts: dict[str, Model], route_fn: Callable[[DataFrame, Column | None], Column], train_ranges: dict[str, tuple[float, float]] | None = None, min_samples: int = 2):
        self.router, self.experts, self.route_fn, self.train_ranges, self.min_samples = router, experts, route_fn, train_ranges, min_samples

    #: Thresholds of the router's prediction and the names of its bins, where route_fn is made of them.
    bins: tuple[Sequence[float], Sequence[str]] | None = None

    def _routed(self, df):
        if self.fitted_router is not None:
            df = self.fitted_router.predict(df, "_router")
        return df.withColumn("_key", self.route_fn(df, F.col("_router") if self.fitted_router is not None else None))

    def fit(self, df, features, y, order):
        self.fitted_router = self.router.clone().fit(df, features, y, order) if self.router is not None else None
        rows = self._routed(df)
        self.fitted = {}
        ranges = self.train_ranges or {}
        picks = {k: (F.col(y) >= ranges[k][0]) & (F.col(y) < ranges[k][1]) if k in ranges else F.col("_key") == k for k in self.experts}
        counts = rows.agg(*[F.coalesce(F.sum(F.coalesce(p, F.lit(False)).cast("long")), F.lit(0)).alias(f"_c{i}") for i, p in enumerate(picks.values())]).first()
        for i, (key, expert) in enumerate(self.experts.items()):
            mine = rows.where(picks[key]) if counts[f"_c{i}"] >= self.min_samples else rows
            self.fitted[key] = expert.clone().fit(mine, features, y, order)
        self.features = list(features)
        return self

    def predict(self, df, name="pred"):
        self.check_fitted()
        rows = self._routed(df)
        out = F.lit(0.0)
        for i, (key, expert) in enumerate(self.fitted.items()):
            rows = expert.predict(rows, f"_e{i}")
            out = F.when(F.col("_key") == key, F.col(f"_e{i}")).otherwise(out)
        return rows.withColumn(name, out).select(*df.columns, name)

    def routing_distribution(self, df) -> DataFrame:
        self.check_fitted()
        return self._routed(df).groupBy(F.col("_key").alias("route")).agg(F.count("*").alias("n"))

    def analyze(self):
        self.check_fitted()
        router = {} if self.fitted_router is None else {"router": self.fitted_router.analyze()}
        return router | {"experts": {k: m.analyze() for k, m in self.fitted.items()}}

    def state(self):
        told = [self.fitted_router.state() if self.fitted_router is not None else None, *(m.state() for m in self.fitted.values())]
        return None if None in told or self.bins is None else {"kind": "cascade", "features": self.features, "bins": [list(b) for b in self.bins], "router": told[0], "experts": dict(zip(self.fitted, told[1:]))}


@dataclass(frozen=True)
class BinConfig:
    name: str
    model: Model
    train: tuple[float, float] | None = None


@dataclass(frozen=True)
class CascadeConfig:
    router: Model
    thresholds: tuple[float, ...]
    bins: tuple[BinConfig, ...]
    epochs: int = 5000
    min_samples: int = 50


def _set_epochs_and_seed(model: Model, epochs: int, seed: int) -> Model:
    """A network takes both; a given-models ensemble passes them on; other models have neither."""
    model = copy.copy(model)
    if isinstance(model, NLModel):
        model.config = replace(model.config, epochs=epochs, seed=seed)
    elif isinstance(model, EnsembleModel) and model.models is not None:
        model.models = [_set_epochs_and_seed(m, epochs, seed) for m in model.models]
    return model


def build_cascade(config: CascadeConfig, seed: int = 42) -> RoutedModel:
    """A router whose prediction picks the expert of its bin."""
    names = [b.name for b in config.bins]
    experts = {b.name: _set_epochs_and_seed(b.model, config.epochs, seed + i + 1) for i, b in enumerate(config.bins)}
    ranges = {b.name: b.train for b in config.bins if b.train is not None}
    out = RoutedModel(_set_epochs_and_seed(config.router, config.epochs, seed), experts, lambda df, p: route(p, config.thresholds, names), ranges, config.min_samples)
    out.bins = (list(config.thresholds), names)
    return out


def restore(state: dict) -> Model:
    """A fitted model from its state()."""
    kind = state["kind"]
    if kind == "ridge":
        out = RidgeModel(state["alpha"])
        out.weights = np.array(state["weights"])
    elif kind == "network":
        out = NLModel(NetConfig(**{**state["config"], "hidden_sizes": tuple(state["config"]["hidden_sizes"])}))
        out.net, out.stats = [np.array(p) for p in state["net"]], {c: tuple(x) for c, x in state["stats"].items()}
    elif kind == "ensemble":
        out = EnsembleModel(models=[restore(m) for m in state["members"]])
        out.members = list(out.models)
    elif kind == "stacked":
        one, two = (restore(m) for m in state["models"])
        out = StackedModel(one, two, state["augment"])
        out.one, out.two = one, two
    elif kind == "cascade":
        thresholds, names = state["bins"]
        experts = {k: restore(m) for k, m in state["experts"].items()}
        out = RoutedModel(restore(state["router"]), experts, lambda df, p: route(p, thresholds, names))
        out.fitted_router, out.fitted, out.bins = out.router, experts, (thresholds, names)
    else:
        raise ValueError(f"unknown kind of model {kind!r}")
    out.features = list(state["features"])
    return out
