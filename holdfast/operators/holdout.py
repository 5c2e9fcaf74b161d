"""Datasets that passed validation, and the one-shot holdout."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import nan_to_null
from holdfast.operators import splits
from holdfast.operators.checks import check_degenerate_columns, check_exact_duplicates, fingerprint_check, label_conflicts, near_duplicate_pairs, warn_pairs
from holdfast.operators.preprocess import Prepared, fold_safe_preprocess
from holdfast.spec import DataError, DatasetSpec, ExperimentConfig, HoldoutError

_SENTINEL = object()


class ValidatedDataset:
    """Made by validate() alone: rows whose duplicates and degenerate columns were ruled out and whose doubtful pairs were named."""

    def __init__(self, token: object, df: DataFrame, spec: DatasetSpec):
        if token is not _SENTINEL:
            raise TypeError("use ValidatedDataset.validate()")
        self.df, self.spec = df, spec

    @classmethod
    def validate(cls, df: DataFrame, spec: DatasetSpec, tol: float = 1e-8) -> ValidatedDataset:
        df = df.select(*spec.columns).withColumns({c: nan_to_null(F.col(c).cast("double")) for c in spec.features})
        ids = df.groupBy(*spec.id_cols).count().where("count > 1").limit(1).collect()
        if ids:
            raise DataError(f"ids aren't unique: {ids[0]}")
        check_exact_duplicates(df, spec)
        check_degenerate_columns(df, spec.features)
        pairs = near_duplicate_pairs(df, spec, tol).persist()
        if warn_pairs(pairs, "near-duplicate pairs") and spec.target:
            warn_pairs(label_conflicts(pairs, df, spec), "near-duplicate pairs with different targets")
        pairs.unpersist()
        if spec.group:
            found = fingerprint_check(df, spec).first()
            if found["risk"] in ("medium", "high"):
                warnings.warn(f"{found['risk']} risk that features tell the group: {found['ratio']:.1f} times chance", stacklevel=2)
        return cls(_SENTINEL, df, spec)

    def transform(self, fn: Callable[[DataFrame], DataFrame], features: Sequence[str] | None = None) -> ValidatedDataset:
        """Apply a function that keeps the rows, and validate again."""
        out = fn(self.df)
        if out.count() != self.df.count():
            raise DataError("a transform must keep the rows")
        return self.validate(out, replace(self.spec, features=tuple(features or self.spec.features)))


@dataclass
class SanctifiedResult:
    rows: DataFrame
    spec: DatasetSpec


class SanctifiedDataset:
    """Rows split into dev, which is open, and a holdout that one final_evaluate() may read.

    The assignment is a column over a hash order (or, with compat_rng, over numpy's permutation of rows in id order), so no
    recomputation changes it. ledger: a path to a JSON file on the
    driver in which consumed splits are noted, so that another process can't evaluate the same holdout again.
    """

    def __init__(self, data: ValidatedDataset | tuple[DataFrame, DatasetSpec], fraction: float = 0.15, seed: int = 42, stratify: bool = True, groups: bool = False, temporal: bool = False, temporal_gap: int = 0, skip_validation: bool = False, ledger: str | None = None, compat_rng: bool = False):
        if not isinstance(data, ValidatedDataset):
            df, spec = data
            data = ValidatedDataset(_SENTINEL, df.select(*spec.columns), spec) if skip_validation else ValidatedDataset.validate(df, spec)
        df, self.spec = data.df, data.spec
        self.temporal, self.temporal_gap, self.compat_rng = temporal, temporal_gap, compat_rng
        order = [*([self.spec.time] if self.spec.time else []), *self.spec.id_cols]
        if temporal:
            rows = splits.temporal_split(df, order, fraction)
        elif groups:
            rows = splits.sanctified(df, self.spec.id_cols, fraction, seed, group=self.spec.group, compat_rng=compat_rng)
        else:
            rows = splits.sanctified(df, self.spec.id_cols, fraction, seed, stratify=self.spec.target if stratify else None, compat_rng=compat_rng)
        rows = rows.persist()
        self.dev = rows.where("split = 'dev'").drop("split")
        self._held = rows.where("split = 'sanctified'").drop("split")
        self._state = "locked"
        self._ledger = ledger
        self._stamp = f"{seed}|{fraction}|{temporal}|{groups}|{stratify}|{','.join(self.spec.columns)}"
        if self.dev.isEmpty():
            raise DataError("no development row is left")

    @property
    def n_samples(self) -> int:
        return self.dev.count() + self.n_sanctified

    @property
    def n_sanctified(self) -> int:
        return 0 if self._state == "consumed" else self._held.count()

    @property
    def sanctified(self) -> DataFrame:
        """The holdout's features; readable only while final_evaluate() runs."""
        if self._state != "open":
            raise HoldoutError("the holdout is locked" if self._state == "locked" else "the holdout is consumed")
        return self._held

    def dev_folds(self, k: int = 5, group_by: str | None = None, seed: int = 42) -> tuple[DataFrame, list[int]]:
        """Membership rows (fold, role, dev columns) and the fold ids: expanding windows in time, else whole groups or sources, else
        random rows."""
        cols = self.dev.columns
        if self.temporal:
            order = [*([self.spec.time] if self.spec.time else []), *self.spec.id_cols]
            rows = splits.expanding_window(self.dev, order, k, self.temporal_gap, cols)
            return rows, sorted(r[0] for r in rows.select("fold").distinct().collect())
        if group_by is not None:
            label = {"groups": self.spec.group, "source": self.spec.source}.get(group_by)
            if label is None:
                raise ValueError(f"no column for group_by={group_by!r}")
            folded = splits.grouped_kfold(self.dev, label, k, seed, self.compat_rng)
        else:
            folded = splits.kfold(self.dev, self.spec.id_cols, k, seed, self.compat_rng)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.when(F.col("fold") == i, "test").otherwise("train").alias("role")) for i in range(k)]))
        return folded.withColumn("m", each).select(F.col("m.f").alias("fold"), "m.role", *cols), list(range(k))

    def prepare_dev_fold(self, train: DataFrame, test: DataFrame, impute: bool = True, normalize: bool = True) -> Prepared:
        return fold_safe_preprocess(train, test, self.spec.features, impute, normalize)

    def final_evaluate(self, evaluate_fn: Callable | None = None):
        """The holdout, once: as a SanctifiedResult, or what evaluate_fn returns for it (or for nothing, if it takes nothing). If the
        function raises, the holdout stays open but can't be evaluated again."""
        if self._state != "locked":
            raise HoldoutError("the holdout was evaluated before")
        self._note()
        self._state = "open"
        if evaluate_fn is None:
            out = SanctifiedResult(self._held, self.spec)
        else:
            try:
                need = [p for p in inspect.signature(evaluate_fn).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
                out = evaluate_fn(self._held) if need else evaluate_fn()
            except (TypeError, ValueError) as e:
                if "signature" not in str(e):
                    raise
                out = evaluate_fn(self._held)
        self._state = "consumed"
        return out

    def _note(self) -> None:
        if self._ledger is None:
            return
        from holdfast.sources.history import Ledger

        digest = self._held.agg(F.sum(F.xxhash64(*self.spec.id_cols).cast("decimal(38,0)"))).first()[0]
        if not Ledger(self._ledger).claim(f"{self._stamp}|{digest}"):
            raise HoldoutError("another run evaluated this holdout")


def load_dataset(df: DataFrame, spec: DatasetSpec, config: ExperimentConfig, ledger: str | None = None) -> SanctifiedDataset:
    """Dedup, validation and holdout as a config says."""
    from holdfast.operators.dedup import apply_dedup

    rows = apply_dedup(df.select(*spec.columns), spec, config.dedup)
    data = ValidatedDataset.validate(rows, spec)
    return SanctifiedDataset(data, config.sanctified_fraction, config.seed, config.stratify, config.group_by == "groups", config.temporal, config.temporal_gap, ledger=ledger, compat_rng=config.compat_rng)
