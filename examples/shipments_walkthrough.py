"""A workbench on the lineitem table: how much a shipment costs, judged on suppliers that no model has seen.

Quartiles of the price are the brackets; whole suppliers are held out and folded. The experiments differ in how strongly
they are penalised, and in whether small and large shipments have models of their own.

python examples/shipments_walkthrough.py [--data-dir DIR] [--quick] [--exp plain]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from holdfast.api import DatasetSpec, ExperimentConfig, NLModel, Pipeline, Research, RidgeModel, RoutedModel, load_dataset  # noqa: E402
from holdfast.functions import route  # noqa: E402
from holdfast.operators.ranks import quantiles  # noqa: E402

ID = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
SPEC = DatasetSpec(ID, ("pieces", "rebate", "age"), "price", group="supplier")


def shipments(spark: SparkSession, data_dir: str | None) -> DataFrame:
    """Shipments: pieces, rebate, years since 1992, and the price in thousands."""
    rows = spark.read.parquet(f"{data_dir or '/root/testdata/sf0.001'}/lineitem.parquet")
    age = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 365.0
    return rows.select(*ID, F.col("l_quantity").alias("pieces"), F.col("l_discount").alias("rebate"), age.alias("age"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_suppkey").alias("supplier"))


def penalised(alpha: float):
    return lambda ctx: Pipeline().add("impute").add("normalize").set_model(RidgeModel(alpha))


def by_size(ctx):
    """A model for shipments of up to 25 pieces and one for larger ones."""
    return RoutedModel(None, {"small": RidgeModel(), "large": RidgeModel()}, lambda df, _: route(F.col("pieces"), [25.0], ["small", "large"]))


def curved(ctx):
    return NLModel(hidden_sizes=(6,), epochs=50 if ctx.quick else 800, seed=ctx.config.seed)


def main(argv: list[str] | None = None) -> dict:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    edges = quantiles(shipments(spark, None), "price", [0.0, 0.25, 0.5, 0.75, 1.0])
    brackets = tuple((lo, hi, f"quarter {i + 1}") for i, (lo, hi) in enumerate(zip(edges, [*edges[1:-1], edges[-1] + 1e-9])))
    config = ExperimentConfig(k=4, dedup="keep-first", group_by="groups", brackets=brackets)
    lab = Research(spark, "Shipments", lambda data_dir, c: load_dataset(shipments(spark, data_dir), SPEC, c), config, save_dir=os.path.abspath("shipments_runs"))
    for name, make in {"plain": penalised(1.0), "stiff": penalised(1e4), "by_size": by_size, "curved": curved}.items():
        lab.new_experiment(name, make)
    return lab.main(argv)


if __name__ == "__main__":
    main()
