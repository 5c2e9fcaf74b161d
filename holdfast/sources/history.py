"""Run history as append-only JSON lines, queried as DataFrames; notes; a ledger of consumed holdouts."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("dev_mae", "dev_mae_std", "dev_r2", "dev_r2_std", "dev_rmse", "sanctified_mae", "sanctified_r2", "sanctified_rmse")
_EXPERIMENT = "struct<" + ", ".join(f"{m}: double" for m in METRICS) + ", id: string, ord: int>"
SCHEMA = (
    "timestamp string, name string, quick boolean, "
    "config struct<seed: bigint, k: int, sanctified_fraction: double, dedup: string, brackets: array<struct<lo: double, hi: double, name: string>>>, "
    f"n_samples bigint, n_features bigint, n_dev bigint, n_sanctified bigint, elapsed_s double, experiments map<string, {_EXPERIMENT}>"
)
#: Metrics of which more is better.
HIGHER = ("dev_r2", "sanctified_r2")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def append_run(spark: SparkSession, save_dir: str, record: dict) -> None:
    """One more file; earlier ones are never rewritten."""
    rows = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(record)], 1))
    rows.write.mode("append").json(f"{save_dir}/runs")


def load_runs(spark: SparkSession, save_dir: str | None, records: list[dict] = ()) -> DataFrame:
    """Runs on disk and in memory, one for each timestamp."""
    held = spark.createDataFrame([], SCHEMA)
    if records:
        held = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 1))
    if save_dir is None:
        return held
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{save_dir}/runs")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return held
    disk = spark.read.schema(SCHEMA).json(f"{save_dir}/runs")
    return disk.join(held.select("timestamp"), "timestamp", "left_anti").select(*held.columns).unionByName(held)


class RunHistory:
    """Queries over runs. Every method that narrows returns another history."""

    def __init__(self, runs: DataFrame):
        self.runs = runs.withColumn("_ts", F.to_timestamp("timestamp")) if "_ts" not in runs.columns else runs

    def __len__(self) -> int:
        return self.runs.count()

    def __iter__(self):
        return (r.asDict(True) for r in self.runs.drop("_ts").orderBy("timestamp").toLocalIterator())

    def __getitem__(self, i: int) -> dict:
        return list(self)[i]

    def __repr__(self) -> str:
        return f"RunHistory({len(self)} runs)"

    def experiment(self, name: str) -> RunHistory:
        return RunHistory(self.runs.where(F.map_contains_key("experiments", F.lit(name))))

    def full(self) -> RunHistory:
        return RunHistory(self.runs.where(~F.coalesce("quick", F.lit(False))))

    def quick(self) -> RunHistory:
        return RunHistory(self.runs.where(F.coalesce("quick", F.lit(False))))

    def last(self, n: int = 1) -> RunHistory:
        """The newest n runs; none for 0."""
        return RunHistory(self.runs.orderBy(F.col("_ts").desc(), F.col("timestamp").desc()).limit(n))

    def since(self, timestamp: str) -> RunHistory:
        return RunHistory(self.runs.where(F.col("_ts") >= F.to_timestamp(F.lit(timestamp))))

    def latest(self) -> dict | None:
        found = self.runs.drop("_ts").orderBy(F.to_timestamp("timestamp").desc()).limit(1).collect()
        return found[0].asDict(True) if found else None

    def scores(self) -> DataFrame:
        """Rows (timestamp, _ts, quick, experiment, metrics, mae, r2), one for each experiment of a run; mae and r2 are the holdout's,
        else those of dev."""
        out = self.runs.select("timestamp", "_ts", F.coalesce("quick", F.lit(False)).alias("quick"), F.explode("experiments").alias("experiment", "e"))
        out = out.where("e is not null").select("timestamp", "_ts", "quick", "experiment", F.col("e.ord").alias("ord"), *[F.col(f"e.{m}").alias(m) for m in METRICS])
        return out.withColumns({"mae": F.coalesce("sanctified_mae", "dev_mae"), "r2": F.coalesce("sanctified_r2", "dev_r2")})

    def best(self, metric: str = "sanctified_mae", experiment: str | None = None, higher_is_better: bool | None = None) -> dict | None:
        """The run of the best value, the earliest among equals; of the given experiment, else of each run's first."""
        rows = self.scores().where(F.col(metric).isNotNull())
        if experiment is not None:
            rows = rows.where(F.col("experiment") == experiment)
        else:
            rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("timestamp").orderBy(F.coalesce("ord", F.lit(0)), "experiment"))).where("_k = 1")
        up = metric in HIGHER if higher_is_better is None else higher_is_better
        found = rows.orderBy(F.col(metric).desc() if up else F.col(metric), "_ts").limit(1).collect()
        if not found:
            return None
        return self.runs.where(F.col("timestamp") == found[0]["timestamp"]).drop("_ts").first().asDict(True)

    def compare(self, *names: str) -> DataFrame:
        """Rows (experiment, best_mae, latest_mae, delta, best_r2, n_runs); delta is the latest less the one before."""
        rows = self.scores()
        if names:
            rows = rows.where(F.col("experiment").isin(*names))
        before = F.lag("mae").over(Window.partitionBy("experiment").orderBy("_ts"))
        rows = rows.withColumn("_delta", F.col("mae") - before)
        return rows.groupBy("experiment").agg(F.min("mae").alias("best_mae"), F.max_by("mae", "_ts").alias("latest_mae"), F.max_by("_delta", "_ts").alias("delta"), F.max("r2").alias("best_r2"), F.count("*").alias("n_runs"))

    def table(self, names: list[str] | None = None) -> DataFrame:
        """One row for each run in time, with a column of mae for each experiment."""
        mode = F.when(F.col("quick"), "quick").otherwise("full").alias("mode")
        return self.scores().groupBy("timestamp", mode).pivot("experiment", names).agg(F.first("mae")).orderBy("timestamp")


def config_record(config, k: int) -> dict:
    brackets = [{"lo": float(b[0]), "hi": float(b[1]), "name": str(b[2]) if len(b) > 2 else f"{b[0]}-{b[1]}"} for b in config.brackets or ()]
    return {"seed": config.seed, "k": k, "sanctified_fraction": config.sanctified_fraction, "dedup": config.dedup, "brackets": brackets or None}


def format_note(text: str, run: dict | None) -> str:
    """A Markdown entry; with a run, a table of its experiments. R2 is the holdout's, else that of dev."""
    lines = [f"## {datetime.now().strftime('%Y-%m-%d %H:%M')}", "", text, ""]
    if run is not None:
        say = lambda x: "-" if x is None else f"{x:.4f}"
        lines += ["| experiment | dev MAE | sanctified MAE | R2 |", "|-|-|-|-|"]
        for name, e in (run.get("experiments") or {}).items():
            e = e or {}
            r2 = e.get("sanctified_r2") if e.get("sanctified_r2") is not None else e.get("dev_r2")
            lines.append(f"| {name} | {say(e.get('dev_mae'))} | {say(e.get('sanctified_mae'))} | {say(r2)} |")
        lines += ["", f"Config: {json.dumps(run.get('config'), default=str)}", ""]
    return "\n".join(lines) + "\n"


class Notes:
    """A Markdown file on the driver."""

    def __init__(self, path: str | None, title: str = "Notes"):
        self.path, self.title = path, title

    def note(self, text: str, run: dict | None = None) -> None:
        if self.path is None:
            raise ValueError("no notes path")
        new = not os.path.exists(self.path)
        with open(self.path, "a") as f:
            f.write((f"# {self.title}\n\n" if new else "") + format_note(text, run))

    def read(self) -> str | None:
        if self.path is None or not os.path.exists(self.path):
            return None
        text = Path(self.path).read_text()
        print(text)
        return text


class Ledger:
    """Names that were claimed once, a line each, in a file on the driver."""

    def __init__(self, path: str):
        self.path = Path(path)

    def claim(self, name: str) -> bool:
        known = self.path.read_text().splitlines() if self.path.exists() else []
        if name in known:
            return False
        with self.path.open("a") as f:
            f.write(name + "\n")
        return True
