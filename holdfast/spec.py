"""Declared datasets and configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class DataError(ValueError):
    """A check that blocks: duplicates, degenerate columns, broken splits, wrong lengths."""


class HoldoutError(RuntimeError):
    """The holdout was read too early, or a second time."""


@dataclass(frozen=True)
class DatasetSpec:
    """Which columns of a DataFrame mean what. id_cols identify a row and order rows where position matters."""

    id_cols: tuple[str, ...]
    features: tuple[str, ...]
    target: str | None = None
    group: str | None = None
    source: str | None = None
    time: str | None = None

    def __post_init__(self):
        for name in ("id_cols", "features"):
            given = getattr(self, name)
            object.__setattr__(self, name, (given,) if isinstance(given, str) else tuple(given))
        if not self.id_cols or not self.features:
            raise DataError("a dataset needs id columns and features")

    @property
    def columns(self) -> list[str]:
        rest = [c for c in (self.target, self.group, self.source, self.time) if c]
        return list(dict.fromkeys([*self.id_cols, *self.features, *rest]))


@dataclass(frozen=True)
class ExperimentConfig:
    seed: int = 42
    sanctified_fraction: float = 0.15
    k: int = 5
    stratify: bool = True
    dedup: str | None = None
    group_by: str | None = None
    dev_strategy: str = "kfold"
    holdout_fraction: float = 0.20
    temporal: bool = False
    temporal_gap: int = 0
    brackets: tuple | None = None
    compat_rng: bool = False


@dataclass
class RunContext:
    config: ExperimentConfig
    quick: bool = False
    data_dir: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)
    feature_names: tuple[str, ...] = ()
