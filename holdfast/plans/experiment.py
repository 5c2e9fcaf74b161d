"""One experiment: folds of the open rows, predictions recorded for them, and the holdout once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import metrics, splits
from holdfast.operators.holdout import SanctifiedDataset
from holdfast.operators.models import Model
from holdfast.plans.pipeline import Pipeline
from holdfast.spec import DataError, ExperimentConfig, HoldoutError


@dataclass
class RunResult:
    oof: DataFrame
    final: DataFrame
    recap: dict
    model: Model | Pipeline


class Fold:
    def __init__(self, owner: Experiment, number: int, n_folds: int, train: DataFrame, test: DataFrame):
        self.owner, self.fold, self.n_folds, self.train, self.test = owner, number, n_folds, train, test
        self._predictions: DataFrame | None = None

    @property
    def recorded(self) -> bool:
        return self._predictions is not None

    def record(self, predictions: DataFrame, name: str = "pred") -> None:
        """Predictions (ids, name) for exactly the test rows."""
        ids = list(self.owner.spec.id_cols)
        self._predictions = _matched(self.test, predictions, ids, name).withColumn("fold", F.lit(self.fold))


def _matched(rows: DataFrame, predictions: DataFrame, ids: list[str], name: str) -> DataFrame:
    p = predictions.select(*ids, F.col(name).cast("double").alias("pred"), F.lit(True).alias("_p"))
    r = rows.withColumn("_r", F.lit(True))
    both = r.join(p, ids, "full")
    wrong = both.agg(F.count(F.when(F.col("_r").isNull() | F.col("_p").isNull(), 1)), F.count("*")).first()
    if wrong[0] or wrong[1] != rows.count():
        raise DataError(f"predictions don't match the rows: {wrong[0]} of {wrong[1]} have no counterpart, or ids repeat")
    return both.drop("_r", "_p")


class Experiment:
    def __init__(self, data: SanctifiedDataset, config: ExperimentConfig | None = None):
        if not isinstance(data, SanctifiedDataset):
            raise TypeError("an experiment needs a SanctifiedDataset")
        self.data, self.config, self.spec = data, config or ExperimentConfig(), data.spec
        self._folds: list[Fold] = []
        self._held: DataFrame | None = None
        self._final: DataFrame | None = None

    @property
    def n_dev(self) -> int:
        return self.data.dev.count()

    @property
    def n_sanctified(self) -> int:
        return self._held.count() if self._held is not None else self.data.n_sanctified

    @property
    def n_samples(self) -> int:
        return self.n_dev + self.n_sanctified

    @property
    def feature_names(self) -> list[str]:
        return list(self.spec.features)

    @property
    def n_features(self) -> int:
        return len(self.spec.features)

    def target_distribution(self, brackets=None) -> DataFrame:
        return metrics.target_distribution(self.data.dev, brackets or self.config.brackets, self.spec.target)

    def folds(self, k: int | None = None, group_by: str | None = None) -> Iterator[Fold]:
        if self._held is not None:
            raise HoldoutError("no folds after final_evaluate()")
        rows, numbers = self.data.dev_folds(k or self.config.k, group_by or self.config.group_by, self.config.seed)
        rows = rows.persist()
        self._folds = []
        for i in numbers:
            side = lambda role, i=i: rows.where((F.col("fold") == i) & (F.col("role") == role)).drop("fold", "role")
            self._folds.append(Fold(self, i, len(numbers), side("train"), side("test")))
            yield self._folds[-1]

    def holdout(self, fraction: float | None = None) -> Fold:
        """One fold: a random part of the open rows."""
        if self._held is not None:
            raise HoldoutError("no folds after final_evaluate()")
        rows = splits.train_test(self.data.dev, self.spec.id_cols, fraction or self.config.holdout_fraction, self.config.seed, self.data.compat_rng).persist()
        self._folds = [Fold(self, 0, 1, rows.where("role = 'train'").drop("role"), rows.where("role = 'test'").drop("role"))]
        return self._folds[0]

    def final_evaluate(self) -> DataFrame:
        if self.spec.target is None:
            raise DataError("no target column")
        self._held = self.data.final_evaluate().rows
        return self._held

    def set_sanctified(self, rows: DataFrame) -> None:
        """The holdout that another experiment on the same data unlocked."""
        self._held = rows

    def record_final(self, predictions: DataFrame, name: str = "pred") -> None:
        if self._held is None:
            raise HoldoutError("final_evaluate() comes first")
        self._final = _matched(self._held, predictions, list(self.spec.id_cols), name)

    @property
    def oof(self) -> DataFrame | None:
        done = [f._predictions for f in self._folds if f.recorded]
        if not done:
            return None
        out = done[0]
        for p in done[1:]:
            out = out.unionByName(p)
        return out

    @property
    def dev_predictions(self) -> DataFrame | None:
        """All open rows with pred and fold; null where no fold tested the row."""
        oof, ids = self.oof, list(self.spec.id_cols)
        return None if oof is None else self.data.dev.join(oof.select(*ids, "pred", "fold"), ids, "left")

    def recap(self, brackets=None) -> dict | None:
        """Nested results, or None if nothing was recorded."""
        oof, y = self.oof, self.spec.target
        if oof is None:
            return None
        brackets = brackets or self.config.brackets
        r = metrics.recap(oof, self._final, y).first()
        out = {"data": {"n_samples": self.n_samples, "n_features": self.n_features, "n_dev": self.n_dev, "n_sanctified": self.n_sanctified, "k": r["k"], "target_distribution": [x.asDict() for x in self.target_distribution(brackets).orderBy("ord").collect()] if brackets else None}}
        out["dev"] = {m: {"mean": r[f"dev_{m}"], "std": r[f"dev_{m}_std"], "per_fold": r[f"dev_{m}_per_fold"]} for m in ("mae", "r2", "rmse")}
        held = self._final is not None
        out["sanctified"] = {m: r[f"sanctified_{m}"] for m in ("n", "mae", "r2", "rmse")} if held else None
        out["comparison"] = {m: r[m] for m in ("mae_gap", "r2_gap")} if held else None
        table = lambda df: None if df is None else [x.asDict() for x in metrics.bracket_scores(df, brackets, y).orderBy("ord").collect()]
        out["brackets"] = {"dev": table(oof), "sanctified": table(self._final)} if brackets else None
        return out

    def summary(self) -> str:
        text = f"{self.n_samples} rows, {self.n_features} features, {self.n_dev} dev, {self.n_sanctified} sanctified; folds recorded: {sum(f.recorded for f in self._folds)} of {len(self._folds)}"
        print(text)
        return text

    def _fitted(self, make: Callable, train: DataFrame, test: DataFrame) -> tuple[Model | Pipeline, DataFrame]:
        model, ids = make(), list(self.spec.id_cols)
        if isinstance(model, Pipeline):
            model.fit(train, self.spec.target, self.spec.features, ids, test)
            return model, model.predict()
        model = model.fit(train, self.spec.features, self.spec.target, ids)
        return model, model.predict(test)

    def evaluate_dev(self, make: Callable, k: int | None = None, group_by: str | None = None, strategy: str = "kfold") -> None:
        for fold in [self.holdout()] if strategy == "holdout" else self.folds(k, group_by):
            fold.record(self._fitted(make, fold.train, fold.test)[1])

    def run(self, make: Callable, group_by: str | None = None, verbose: bool = True) -> RunResult:
        """All folds, then the holdout with a model trained on every open row, then the recap."""
        self.evaluate_dev(make, group_by=group_by)
        held = self.final_evaluate()
        model, predictions = self._fitted(make, self.data.dev, held)
        self.record_final(predictions)
        out = RunResult(self.oof, self._final, self.recap(), model)
        if verbose:
            print_recap(out.recap)
        return out


def print_recap(recap: dict) -> None:
    say = lambda x: "-" if x is None else f"{x:.4f}"
    d, held, gaps = recap["data"], recap["sanctified"], recap["comparison"]
    print(f"{d['n_samples']} rows of {d['n_features']} features: {d['n_dev']} dev ({'one holdout' if d['k'] == 1 else f'{d["k"]} folds'}), {d['n_sanctified']} sanctified")
    for b in d["target_distribution"] or []:
        print(f"  target {b['name']}: n {b['n']} ({b['frac']:.1%}) mean {say(b['mean'])} std {say(b['std'])}")
    for m, v in recap["dev"].items():
        print(f"{m:5} dev {say(v['mean'])} +- {say(v['std'])}   sanctified {say(held and held[m])}")
    print("  mae by fold:", " ".join(say(x) for x in recap["dev"]["mae"]["per_fold"]))
    if gaps:
        print(f"  dev less sanctified: mae {say(gaps['mae_gap'])} ({'worse' if (gaps['mae_gap'] or 0) > 0 else 'better'} on dev), r2 {say(gaps['r2_gap'])}")
    for side, rows in (recap["brackets"] or {}).items():
        for b in rows or []:
            print(f"  {side} {b['name']}: n {b['n']} mae {say(b['mae'])} r2 {say(b['r2'])}")


def print_comparison(recaps: dict[str, dict]) -> None:
    for name, r in recaps.items():
        if r:
            print(f"{name}: dev MAE {r['dev']['mae']['mean']:.4f}" + (f", sanctified MAE {r['sanctified']['mae']:.4f}" if r["sanctified"] else ""))


def print_brackets(df: DataFrame, brackets, y: str = "y", p: str = "pred", label: str = "", indent: int = 2) -> None:
    if label:
        print(label)
    for b in metrics.bracket_mae(df, brackets, y, p).orderBy("ord").collect():
        print(f"{' ' * indent}{b['name']}: n {b['n']} mae {b['mae']:.4f}")
