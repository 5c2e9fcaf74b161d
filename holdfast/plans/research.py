"""A workbench of named experiments on one dataset, with a history."""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from holdfast.operators.holdout import SanctifiedDataset
from holdfast.plans.experiment import Experiment, print_comparison, print_recap
from holdfast.plans.pipeline import Pipeline
from holdfast.sources.history import Notes, RunHistory, append_run, config_record, load_runs, now
from holdfast.sources.snapshots import load_snapshot, save_snapshot
from holdfast.spec import ExperimentConfig, RunContext


@dataclass
class _Named:
    id: str
    name: str
    model_fn: Callable
    after: Callable | None


class Research:
    """loader(data_dir, config) returns a SanctifiedDataset, anew for each run; model_fn(ctx) returns a fresh model or pipeline."""

    def __init__(self, spark: SparkSession, name: str, loader: Callable, config: ExperimentConfig | None = None, *, quick_k: int = 3, save_dir: str | None = None, notes_path: str | None = None):
        self.spark, self.name, self.loader, self.config = spark, name, loader, config or ExperimentConfig()
        self.quick_k, self.save_dir, self.notes = quick_k, save_dir, Notes(notes_path, name)
        self._experiments: dict[str, _Named] = {}
        self._records: list[dict] = []
        self._arguments: list[tuple] = []
        self._extra: dict = {}

    def new_experiment(self, name: str, model_fn: Callable, *, after: Callable | None = None) -> str:
        if name in self._experiments:
            raise ValueError(f"there is an experiment {name!r}")
        self._experiments[name] = _Named(uuid.uuid4().hex[:8], name, model_fn, after)
        return self._experiments[name].id

    @property
    def experiments(self) -> dict[str, str]:
        return {e.id: e.name for e in self._experiments.values()}

    def experiment(self, name: str) -> Research:
        """A copy with this experiment alone, and the same history."""
        if name not in self._experiments:
            raise KeyError(f"{name!r}: one of {sorted(self._experiments)}")
        out = Research.__new__(Research)
        out.__dict__.update(self.__dict__)
        out._experiments = {name: self._experiments[name]}
        return out

    def experiment_by_id(self, experiment_id: str) -> Research:
        if experiment_id not in self.experiments:
            raise KeyError(f"{experiment_id!r}: one of {sorted(self.experiments)}")
        return self.experiment(self.experiments[experiment_id])

    def rerun(self, experiment_id: str, **kwargs) -> dict:
        return self.experiment_by_id(experiment_id).run(**kwargs)

    def add_argument(self, *args, **kwargs) -> None:
        self._arguments.append((args, kwargs))

    def main(self, argv: list[str] | None = None) -> dict:
        p = argparse.ArgumentParser(self.name)
        p.add_argument("--data-dir")
        p.add_argument("--quick", action="store_true")
        p.add_argument("--folds", type=int)
        p.add_argument("--dedup", choices=["average", "keep-first", "exact", "none"])
        p.add_argument("--exp", choices=sorted(self._experiments))
        own = {a.dest for a in p._actions}
        for args, kwargs in self._arguments:
            p.add_argument(*args, **kwargs)
        got = vars(p.parse_args(argv))
        scope = self.experiment(got["exp"]) if got["exp"] else self
        scope._extra = {k: v for k, v in got.items() if k not in own}
        return scope.run(quick=got["quick"], data_dir=got["data_dir"], folds=got["folds"], dedup=got["dedup"])

    def run(self, *, quick: bool = False, data_dir: str | None = None, folds: int | None = None, dedup: str | None = None) -> dict:
        """Load, evaluate every experiment on the open rows, unlock the holdout once for all, report, snapshot, remember."""
        began = time.time()
        config = replace(self.config, k=folds or (self.quick_k if quick else self.config.k))
        if dedup is not None and self.config.dedup is not None:
            config = replace(config, dedup=None if dedup == "none" else dedup)
        data: SanctifiedDataset = self.loader(data_dir, config)
        ctx = RunContext(config, quick, data_dir, dict(self._extra), tuple(data.spec.features))
        tried = {}
        for name, e in self._experiments.items():
            tried[name] = Experiment(data, config)
            tried[name].evaluate_dev(lambda e=e: e.model_fn(ctx), config.k, config.group_by, config.dev_strategy)
        held = data.final_evaluate()
        recaps, learned = {}, {}
        for name, e in self._experiments.items():
            x = tried[name]
            x.set_sanctified(held.rows)
            model, predictions = x._fitted(lambda e=e: e.model_fn(ctx), data.dev, held.rows)
            x.record_final(predictions)
            if e.after is not None:
                e.after(model, held, ctx)
            recaps[name], learned[name] = x.recap(), model
            print_recap(recaps[name])
        print_comparison(recaps)
        record = self.record(ctx, recaps, time.time() - began)
        self._records.append(record)
        if self.save_dir is not None:
            append_run(self.spark, self.save_dir, record)
            for name, x in tried.items():
                model = learned[name]
                save_snapshot(self.save_dir, name, x.dev_predictions, x._final, model.analyze(), model=model.model_ if isinstance(model, Pipeline) else model)
        return recaps

    def record(self, ctx: RunContext, recaps: dict, elapsed: float) -> dict:
        some = next(iter(recaps.values()))["data"]
        out = {"timestamp": now(), "name": self.name, "quick": ctx.quick, "config": config_record(ctx.config, ctx.config.k), "n_samples": some["n_samples"], "n_features": some["n_features"], "n_dev": some["n_dev"], "n_sanctified": some["n_sanctified"], "elapsed_s": round(elapsed, 2), "experiments": {}}
        for i, (name, r) in enumerate(recaps.items()):
            dev, held = r["dev"], r["sanctified"] or {}
            out["experiments"][name] = {"dev_mae": dev["mae"]["mean"], "dev_mae_std": dev["mae"]["std"], "dev_r2": dev["r2"]["mean"], "dev_r2_std": dev["r2"]["std"], "dev_rmse": dev["rmse"]["mean"], **{f"sanctified_{m}": held.get(m) for m in ("mae", "r2", "rmse")}, "id": self._experiments[name].id, "ord": i}
        return out

    def runs(self) -> RunHistory:
        return RunHistory(load_runs(self.spark, self.save_dir, self._records))

    def load_snapshot(self, name: str) -> dict:
        """Its model is that of the experiment; of a pipeline it takes the rows that the steps give."""
        return load_snapshot(self.spark, self.save_dir, name)

    def note(self, text: str, run: dict | None = None) -> None:
        self.notes.note(text, run if run is not None else (self._records[-1] if self._records else None))
