"""Step pipelines: each step learns from training rows and transforms both sides; a model follows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from holdfast.operators.models import Model
from holdfast.operators.preprocess import fold_impute, fold_normalize

_STEPS: dict[str, type[Step]] = {}


def register_step_type(name: str, cls: type[Step]) -> None:
    _STEPS[name] = cls


class Step(ABC):
    @abstractmethod
    def execute(self, train: DataFrame, y: str, features: list[str], val: DataFrame | None = None) -> dict:
        """A dict with train, val, features and meta. The target column passes through."""


class Impute(Step):
    def execute(self, train, y, features, val=None):
        got = fold_impute(train, val, features)
        return {"train": got.train, "val": got.test, "features": features, "meta": got.stats}


class Normalize(Step):
    def execute(self, train, y, features, val=None):
        got = fold_normalize(train, val, features)
        return {"train": got.train, "val": got.test, "features": features, "meta": got.stats}


register_step_type("impute", Impute)
register_step_type("normalize", Normalize)


@dataclass
class PipelineResult:
    train: DataFrame
    val: DataFrame | None
    features: list[str]
    metas: list[dict] = field(default_factory=list)

    @property
    def n_features(self) -> int:
        return len(self.features)

    @property
    def history(self):
        return next((m["history"] for m in reversed(self.metas) if "history" in m), None)

    @property
    def names(self) -> list[str]:
        return list(self.features)


class Pipeline:
    def __init__(self):
        self.steps: list[Step] = []
        self._template: Model | None = None
        self._model: Model | None = None
        self._result: PipelineResult | None = None

    def add(self, step: str | Step, **kwargs) -> Pipeline:
        if isinstance(step, str):
            if step not in _STEPS:
                raise ValueError(f"unknown step {step!r}: one of {sorted(_STEPS)}")
            step = _STEPS[step](**kwargs)
        elif not isinstance(step, Step) or kwargs:
            raise TypeError("a step is a name with arguments, or a Step without")
        self.steps.append(step)
        return self

    def set_model(self, model: Model) -> Pipeline:
        self._template = model
        return self

    def run(self, train: DataFrame, y: str, features: Sequence[str], val: DataFrame | None = None) -> PipelineResult:
        out = PipelineResult(train, val, list(features))
        for step in self.steps:
            got = step.execute(out.train, y, out.features, out.val)
            out = PipelineResult(got["train"], got.get("val"), list(got["features"]), [*out.metas, got.get("meta") or {}])
        return out

    def fit(self, train: DataFrame, y: str, features: Sequence[str], order: Sequence[str], val: DataFrame | None = None) -> Pipeline:
        if self._template is None:
            raise ValueError("set_model() comes first")
        self._result = self.run(train, y, features, val)
        self._model = self._template.clone().fit(self._result.train, self._result.features, y, order)
        return self

    @property
    def model_(self) -> Model:
        if self._model is None:
            raise ValueError("fit() comes first")
        return self._model

    def predict(self, df: DataFrame | None = None, name: str = "pred") -> DataFrame:
        """Predictions for the validation rows given to fit(); for other rows only without steps."""
        model = self.model_
        if df is not None and self.steps:
            raise ValueError("with steps, give the validation rows to fit()")
        rows = df if df is not None else self._result.val
        if rows is None:
            raise ValueError("no validation rows")
        return model.predict(rows, name)

    def analyze(self) -> dict:
        steps = [{"index": i, "type": type(s).__name__, "meta": m} for i, (s, m) in enumerate(zip(self.steps, self._result.metas if self._result else [{}] * len(self.steps)))]
        return {"steps": steps, "model": self._model.analyze() if self._model else None}
