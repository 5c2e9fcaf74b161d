"""Regression metrics: whole, by fold, by half-open bracket of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_columns(y: str = "y", p: str = "pred") -> list[Column]:
    """Aggregates n, mae, r2 and rmse. R2 is 1 - SSres / SStot; with SStot 0 it is 1 if SSres is 0, else 0; null under two rows."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    total = F.var_pop(F.col(y).cast("double")) * F.count("*")
    rest = F.sum(e * e)
    r2 = F.when(F.count("*") < 2, None).when(total > 0, 1 - F.try_divide(rest, total)).when(rest == 0, 1.0).otherwise(0.0)
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse")]


def scores(df: DataFrame, y: str = "y", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*score_columns(y, p)) if by else df.agg(*score_columns(y, p))


def bracket_table(df: DataFrame, brackets: Sequence) -> DataFrame:
    """The brackets (lo, hi[, name]) as rows (ord, lo, hi, name)."""
    rows = [(i, float(b[0]), float(b[1]), str(b[2]) if len(b) > 2 else f"{b[0]}-{b[1]}") for i, b in enumerate(brackets)]
    return df.sparkSession.createDataFrame(rows, "ord int, lo double, hi double, name string")


def bracketed(df: DataFrame, brackets: Sequence, y: str = "y") -> DataFrame:
    """The rows with ord, once for each bracket that holds y (brackets may overlap): a pass over the rows, no join."""
    inside = [F.when((F.col(y) >= float(b[0])) & (F.col(y) < float(b[1])) & ~F.isnan(F.col(y).cast("double")), F.lit(i)) for i, b in enumerate(brackets)]
    return df.withColumn("ord", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())))


def bracket_scores(df: DataFrame, brackets: Sequence, y: str = "y", p: str = "pred") -> DataFrame:
    """Rows (ord, name, n, mae, r2, rmse), one for each bracket in order; no scores with under two rows."""
    found = bracketed(df, brackets, y).groupBy("ord").agg(*score_columns(y, p))
    out = bracket_table(df, brackets).join(found, "ord", "left")
    enough = F.col("n") > 1
    return out.select("ord", "name", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(enough, F.col(c)).alias(c) for c in ("mae", "r2", "rmse")])


def bracket_mae(df: DataFrame, brackets: Sequence, y: str = "y", p: str = "pred") -> DataFrame:
    """Rows (ord, name, n, mae) of brackets that have a row."""
    found = bracketed(df, brackets, y).groupBy("ord").agg(*score_columns(y, p)[:2])
    return bracket_table(df, brackets).join(found, "ord").select("ord", "name", "n", "mae")


def target_distribution(df: DataFrame, brackets: Sequence, y: str = "y") -> DataFrame:
    """Rows (ord, name, n, frac, mean, std): share of all rows; mean 0 if empty, population deviation 0 under two rows."""
    if not brackets:
        raise ValueError("target_distribution needs brackets")
    v = F.col(y).cast("double")
    found = bracketed(df, brackets, y).groupBy("ord").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    total = df.agg(F.count("*").alias("total"))
    out = bracket_table(df, brackets).join(found, "ord", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return out.select("ord", "name", n.alias("n"), F.coalesce(F.try_divide(n.cast("double"), F.col("total")), F.lit(0.0)).alias("frac"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(n > 1, F.col("std")).otherwise(0.0).alias("std"))


def recap(oof: DataFrame, final: DataFrame | None = None, y: str = "y", p: str = "pred") -> DataFrame:
    """One row: mean, population deviation and list of the folds' metrics, the holdout's metrics, and gaps between them.

    oof: rows (fold, y, pred); final: rows (y, pred) of the holdout.
    """
    folds = scores(oof, y, p, ["fold"])
    aggs = []
    for m in ("mae", "r2", "rmse"):
        aggs += [F.avg(m).alias(f"dev_{m}"), F.stddev_pop(m).alias(f"dev_{m}_std"), F.sort_array(F.collect_list(F.struct("fold", m))).getField(m).alias(f"dev_{m}_per_fold")]
    out = folds.agg(F.count("*").alias("k"), *aggs)
    if final is not None:
        held = scores(final, y, p).select(F.col("n").alias("sanctified_n"), *[F.col(m).alias(f"sanctified_{m}") for m in ("mae", "r2", "rmse")])
        out = out.crossJoin(F.broadcast(held)).withColumns({"mae_gap": F.col("dev_mae") - F.col("sanctified_mae"), "r2_gap": F.col("dev_r2") - F.col("sanctified_r2")})  # one row
    return out
