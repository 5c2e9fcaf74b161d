"""One query for each operator over the star-schema tables, and SQL with the same rows where SQL can express it."""

from __future__ import annotations

import contextlib
import io
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import derived_seed, digitize, nan_to_null, route, sigmoid
from holdfast.operators import checks, dedup, hint, metrics, models, preprocess, ridge, splits
from holdfast.operators.holdout import load_dataset
from holdfast.operators.nn import NetConfig
from holdfast.operators.ranks import quantiles
from holdfast.plans.experiment import Experiment
from holdfast.plans.pipeline import Pipeline
from holdfast.plans.research import Research
from holdfast.sources.history import METRICS, SCHEMA, RunHistory, load_runs
from holdfast.spec import DatasetSpec, ExperimentConfig

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINEITEM_ID = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
ITEMS = DatasetSpec(LINEITEM_ID, ("l_quantity", "l_discount", "l_tax"), "l_extendedprice")
ORDERS = DatasetSpec("o_orderkey", ("cust", "day"), "o_totalprice")
BRACKETS = ((0, 100_000, "low"), (100_000, 300_000, "mid"), (300_000, 500_000), (900_000, 1_000_000, "none"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(*ITEMS.columns)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two features: the customer's key in thousands, and the day."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", (F.col("o_custkey") / 1000.0).alias("cust"), day.alias("day"))


def r(c, digits: int = 6):
    return F.round(c, digits)


_RANK = "row_number() OVER (ORDER BY md5('42|' || {k}), {k}) - 1"
_ORDERS = "o AS (SELECT *, o_custkey / 1000.0::DOUBLE AS cust, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day FROM orders)"
_FOLDED = f"f AS (SELECT *, CAST(least(({_RANK.format(k='o_orderkey')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM o)"


# Duplicates
@query("dedup_exact", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice FROM (SELECT *, count(*) OVER (PARTITION BY l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1")
def dedup_exact(spark, d):
    return dedup.dedup_exact(items(spark, d), ITEMS).rows


@query("dedup_average", "SELECT i.l_orderkey, i.l_partkey, i.l_suppkey, i.l_linenumber, l_quantity, l_discount, l_tax, round(y, 6) AS l_extendedprice FROM (SELECT l_quantity, l_discount, l_tax, avg(l_extendedprice) AS y, min({'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_linenumber': l_linenumber}) AS i FROM lineitem GROUP BY 1, 2, 3)")
def dedup_average(spark, d):
    return dedup.dedup_average(items(spark, d), ITEMS).rows.withColumn("l_extendedprice", r("l_extendedprice"))


@query("dedup_keep_first", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) = 1")
def dedup_keep_first(spark, d):
    return dedup.dedup_keep_first(items(spark, d), ITEMS).rows


@query(
    "dedup_reports",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax)
SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS exact_dropped, count(*) FILTER (n > 1) AS n_groups, count(*) AS n_unique, CAST(sum(n - 1) AS BIGINT) AS first_dropped FROM g""",
)
def dedup_reports(spark, d):
    df = items(spark, d)
    a, b, c = (f(df, ITEMS).counts for f in (dedup.dedup_exact, dedup.dedup_average, dedup.dedup_keep_first))
    # one row each
    return a.select(F.col("n_dropped").alias("exact_dropped"), "n_groups").crossJoin(b.select("n_unique")).crossJoin(c.select(F.col("n_dropped").alias("first_dropped")))


@query("exact_dup_pairs", "SELECT first_doc_id, doc_id AS dup_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents) WHERE doc_id > first_doc_id")
def exact_dup_pairs(spark, d):
    return dedup.duplicate_pairs(load(spark, d, "documents").select("doc_id", "text"), DatasetSpec("doc_id", "text"))


# Checks
@query(
    "column_profile",
    "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CASE WHEN count({c}) = 0 THEN 'all_nan' WHEN min({c}) = max({c}) THEN 'zero_variance' ELSE 'ok' END AS status FROM {t}" for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("part", "p_size"), ("part", "p_retailprice"))),
)
def column_profile(spark, d):
    a = checks.column_profile(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return a.unionByName(checks.column_profile(load(spark, d, "part"), ["p_size", "p_retailprice"]))


PARTS = DatasetSpec("p_partkey", ("p_size", "p_retailprice"), "p_brand")
_NEAR = "SELECT a.p_partkey AS a, b.p_partkey AS b, sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) AS far, a.p_brand AS y_a, b.p_brand AS y_b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 0.5 AND abs(a.p_retailprice - b.p_retailprice) <= 0.5"


@query("near_dup_pairs", f"SELECT a, b, round(far, 6) AS distance FROM ({_NEAR}) WHERE far <= 0.5")
def near_dup_pairs(spark, d):
    found = checks.near_duplicate_pairs(load(spark, d, "part"), PARTS, 0.5)
    return found.select(F.col("id_a.p_partkey").alias("a"), F.col("id_b.p_partkey").alias("b"), r("distance").alias("distance"))


@query("label_conflicts", f"SELECT a, b, y_a, y_b FROM ({_NEAR}) WHERE far <= 0.5 AND y_a <> y_b")
def label_conflicts(spark, d):
    found = checks.near_label_conflicts(load(spark, d, "part"), PARTS, 0.5)
    return found.select(F.col("id_a.p_partkey").alias("a"), F.col("id_b.p_partkey").alias("b"), "y_a", "y_b")


@query(
    "fingerprint_check",
    """WITH e AS (SELECT vec_id, label AS g, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS x, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS m FROM embeddings),
t AS (SELECT *, m > 1 AND r < greatest(1, floor(m * 0.2::DOUBLE)) AS test FROM e),
l AS (SELECT vec_id, g, test, i, x[i] AS v FROM t, range(1, 65) s(i)),
st AS (SELECT i, avg(v) AS a, stddev_pop(v) AS s FROM l WHERE NOT test GROUP BY i),
z AS (SELECT vec_id, g, test, i, (v - a) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM l JOIN st USING (i)),
c AS (SELECT g AS c, i, avg(z) AS centre FROM z WHERE NOT test GROUP BY ALL),
far AS (SELECT vec_id, g, c, sum((z - centre) ** 2) AS far FROM z JOIN c USING (i) WHERE test GROUP BY ALL),
hit AS (SELECT vec_id, g, arg_min(c, {'far': far, 'c': c}) AS guess FROM far GROUP BY ALL),
k AS (SELECT count(DISTINCT label) AS n_groups FROM embeddings), sc AS (SELECT count(*) AS n_test, avg((guess = g)::INT) AS accuracy FROM hit)
SELECT n_groups, n_test, round(accuracy, 6) AS accuracy, round(1.0 / n_groups, 6)::DOUBLE AS chance, round(accuracy * n_groups, 6) AS ratio, CASE WHEN accuracy * n_groups < 3 THEN 'low' WHEN accuracy * n_groups < 10 THEN 'medium' ELSE 'high' END AS risk FROM k, sc""",
)
def fingerprint(spark, d):
    cols = [f"e{i}" for i in range(64)]
    df = load(spark, d, "embeddings").select("vec_id", F.col("label").alias("g"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    out = checks.fingerprint_check(df, DatasetSpec("vec_id", cols, group="g"))
    return out.withColumns({c: r(c) for c in ("accuracy", "chance", "ratio")})


# Splits
@query("kfold", f"WITH {_ORDERS}, {_FOLDED} SELECT o_orderkey, fold FROM f")
def kfold(spark, d):
    return splits.kfold(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, SEED)


@query("grouped_kfold", f"WITH g AS (SELECT DISTINCT o_custkey FROM orders), f AS (SELECT o_custkey, CAST(least(({_RANK.format(k='o_custkey')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM g) SELECT o_orderkey, fold FROM orders JOIN f USING (o_custkey)")
def grouped_kfold(spark, d):
    return splits.grouped_kfold(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, SEED).select("o_orderkey", "fold")


@query("train_test", f"SELECT o_orderkey, CASE WHEN {_RANK.format(k='o_orderkey')} < floor((1 - 0.2::DOUBLE) * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS role FROM orders")
def train_test(spark, d):
    return splits.train_test(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, SEED)


@query("oof_folds", "SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM orders")
def oof_folds(spark, d):
    return hint.oof_splits(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query("temporal_split", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) - 1 < floor((SELECT count(*) FROM events) * (1 - 0.15::DOUBLE)) THEN 'dev' ELSE 'sanctified' END AS split FROM events")
def temporal_split(spark, d):
    return splits.temporal_split(load(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 0.15).select("event_id", "split")


@query(
    "expanding_window",
    """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events), k AS (SELECT CAST(i AS INT) AS fold FROM range(0, 3) t(i))
SELECT fold, CASE WHEN r < (fold + 1) * (n // 4) THEN 'train' ELSE 'test' END AS role, event_id FROM e, k
WHERE r < (fold + 1) * (n // 4) OR (r >= (fold + 1) * (n // 4) + 10 AND r < CASE WHEN fold = 2 THEN n ELSE (fold + 2) * (n // 4) END)""",
)
def expanding_window(spark, d):
    return splits.expanding_window(load(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 3, 10).select("fold", "role", "event_id")


@query("holdout_random", f"SELECT o_orderkey, CASE WHEN {_RANK.format(k='o_orderkey')} < greatest(1, floor((SELECT count(*) FROM orders) * 0.15::DOUBLE)) THEN 'sanctified' ELSE 'dev' END AS split FROM orders")
def holdout_random(spark, d):
    return splits.sanctified(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.15, SEED)


@query(
    "holdout_stratified",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders),
s AS (SELECT o_orderkey, len(list_filter(e, lambda t: t <= o_totalprice)) AS s FROM orders, q),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY s) AS m FROM s)
SELECT o_orderkey, CASE WHEN m > 1 AND r < greatest(1, floor(m * 0.15::DOUBLE)) THEN 'sanctified' ELSE 'dev' END AS split FROM k""",
)
def holdout_stratified(spark, d):
    return splits.sanctified(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.15, SEED, stratify="o_totalprice").select("o_orderkey", "split")


@query("holdout_grouped", f"WITH g AS (SELECT l_suppkey, {_RANK.format(k='l_suppkey')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN r < greatest(1, floor(n * 0.15::DOUBLE)) THEN 'sanctified' ELSE 'dev' END AS split FROM lineitem JOIN g USING (l_suppkey)")
def holdout_grouped(spark, d):
    return splits.sanctified(load(spark, d, "lineitem").select(*LINEITEM_ID), LINEITEM_ID, 0.15, SEED, group="l_suppkey")


@query("source_folds", f"WITH g AS (SELECT source, CAST(least(({_RANK.format(k='source')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, fold FROM documents JOIN g USING (source)")
def source_folds(spark, d):
    return splits.grouped_kfold(load(spark, d, "documents").select("doc_id", "source"), "source", 5, SEED).select("doc_id", "fold")


@query(
    "split_audit",
    f"WITH {_ORDERS}, {_FOLDED}, n AS (SELECT count(*) AS n FROM orders) SELECT fold, n - count(*) AS n_train, count(*) AS n_test, 0::BIGINT AS n_repeated, 0::BIGINT AS n_overlap, 0::BIGINT AS n_missing, 0::BIGINT AS n_group_overlap FROM (SELECT o_orderkey, g.fold FROM o JOIN (SELECT o_custkey, CAST(least(({_RANK.format(k='o_custkey')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) g USING (o_custkey)), n GROUP BY fold, n",
)
def split_audit(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    folded = splits.grouped_kfold(df, "o_custkey", 5, SEED)
    return checks.audit_split(splits.membership(folded, ["o_orderkey"], 5), df, ["o_orderkey"], "o_custkey")


@query(
    "rare_classes",
    f"""WITH s AS (SELECT o_custkey AS y, {_RANK.format(k='o_orderkey')} < floor((1 - 0.2::DOUBLE) * (SELECT count(*) FROM orders)) AS train FROM orders)
SELECT y, CASE WHEN bool_or(train) THEN 'train' ELSE 'test' END AS only_in FROM s GROUP BY y HAVING bool_or(train) <> bool_or(NOT train)""",
)
def rare_classes(spark, d):
    df = splits.train_test(load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("y")), ["o_orderkey"], 0.2, SEED)
    return checks.rare_classes(df.where("role = 'train'"), df.where("role = 'test'"), "y")


@query("derive_seeds", "SELECT i, CAST('0x' || sha256('42|ensemble|' || i)[1:8] AS BIGINT) AS seed FROM range(0, 10) t(i)")
def derive_seeds(spark, d):
    return spark.range(10).select(F.col("id").alias("i"), derived_seed(42, "ensemble", F.col("id")).alias("seed"))


# Preparation
_EVENTS = f"e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value, user_id::DOUBLE AS u, CASE WHEN {_RANK.format(k='event_id')} < floor((1 - 0.2::DOUBLE) * (SELECT count(*) FROM events)) THEN 'train' ELSE 'test' END AS role FROM events)"


def events(spark, d, missing: bool = True):
    df = load(spark, d, "events")
    value = F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("value")) if missing else F.col("value")
    rows = splits.train_test(df.select("event_id", value.alias("value"), F.col("user_id").cast("double").alias("u")), ["event_id"], 0.2, SEED)
    return rows.where("role = 'train'"), rows.where("role = 'test'")


def both(p: preprocess.Prepared) -> DataFrame:
    return p.train.unionByName(p.test)


@query("fold_impute", f"WITH {_EVENTS} SELECT event_id, role, round(coalesce(value, (SELECT median(value) FROM e WHERE role = 'train')), 6) AS value FROM e")
def fold_impute(spark, d):
    return both(preprocess.fold_impute(*events(spark, d), ["value"])).select("event_id", "role", r("value").alias("value"))


@query("fold_normalize", f"WITH {_EVENTS}, s AS (SELECT avg(u) AS a, stddev_pop(u) AS s FROM e WHERE role = 'train') SELECT event_id, role, round((u - a) / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 6) AS u FROM e, s")
def fold_normalize(spark, d):
    return both(preprocess.fold_normalize(*events(spark, d), ["u"])).select("event_id", "role", r("u").alias("u"))


@query("fold_preprocess", f"WITH {_EVENTS}, m AS (SELECT median(value) AS m, median(u) AS mu FROM e WHERE role = 'train'), i AS (SELECT event_id, role, coalesce(value, m) AS value, coalesce(u, mu) AS u FROM e, m), s AS (SELECT avg(value) AS a, stddev_pop(value) AS s, avg(u) AS au, stddev_pop(u) AS su FROM i WHERE role = 'train') SELECT event_id, role, round((value - a) / s, 6) AS value, round((u - au) / su, 6) AS u FROM i, s")
def fold_preprocess(spark, d):
    return both(preprocess.fold_safe_preprocess(*events(spark, d), ["value", "u"])).select("event_id", "role", r("value").alias("value"), r("u").alias("u"))


@query("nn_normalize", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT greatest(stddev_pop(o_totalprice), 1e-12) FROM orders), 6) AS o_totalprice FROM orders")
def nn_normalize(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return preprocess.normalize(df, preprocess.compute_norm_stats(df, ["o_totalprice"])).withColumn("o_totalprice", r("o_totalprice"))


@query("out_of_fold_moments", f"WITH {_ORDERS}, {_FOLDED} SELECT k.fold, count(*) AS n, round(avg(day), 6) AS mean_day, round(stddev_pop(day), 6) AS std_day FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold")
def out_of_fold_moments(spark, d):
    out = preprocess.out_of_fold_moments(splits.kfold(orders(spark, d), ["o_orderkey"], 5, SEED), ["day"])
    return out.select("fold", "n", r("mean_day").alias("mean_day"), r("std_day").alias("std_day"))


@query("quantiles", "\nUNION ALL ".join(f"SELECT {s}::DOUBLE AS share, round(quantile_cont(o_totalprice, {s}), 6) AS value FROM orders" for s in (0.0, 0.1, 0.5, 0.9, 1.0)))
def exact_quantiles(spark, d):
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = quantiles(load(spark, d, "orders"), "o_totalprice", shares)
    return spark.createDataFrame([(s, v) for s, v in zip(shares, found)], "share double, value double").withColumn("value", r("value"))


# Metrics, over a fixed guess at the price
_GUESS = f"{_ORDERS}, {_FOLDED}, p AS (SELECT o_orderkey, fold, o_totalprice AS y, 150000.0::DOUBLE + 30.0::DOUBLE * day AS pred FROM f)"
_SCORES = "count(*) AS n, round(avg(abs(y - pred)), 6) AS mae, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - pred) ** 2)), 6) AS rmse"


def guess(spark, d) -> DataFrame:
    folded = splits.kfold(orders(spark, d), ["o_orderkey"], 5, SEED)
    return folded.select("o_orderkey", "fold", F.col("o_totalprice").alias("y"), (150000.0 + 30.0 * F.col("day")).alias("pred"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("scores", f"WITH {_GUESS} SELECT {_SCORES} FROM p")
def scores(spark, d):
    return rounded(metrics.scores(guess(spark, d)))


@query("fold_scores", f"WITH {_GUESS} SELECT fold, {_SCORES} FROM p GROUP BY fold")
def fold_scores(spark, d):
    return rounded(metrics.scores(guess(spark, d), by=["fold"]))


_BRACKETS = "b AS (SELECT CAST(ord AS INT) AS ord, lo, hi, name FROM (VALUES (0, 0, 100000, 'low'), (1, 100000, 300000, 'mid'), (2, 300000, 500000, '300000-500000'), (3, 900000, 1000000, 'none')) t(ord, lo, hi, name))"


@query("bracket_scores", f"WITH {_GUESS}, {_BRACKETS}, s AS (SELECT ord, {_SCORES} FROM p JOIN b ON y >= lo AND y < hi GROUP BY ord) SELECT b.ord, name, coalesce(n, 0) AS n, CASE WHEN n > 1 THEN mae END AS mae, CASE WHEN n > 1 THEN r2 END AS r2, CASE WHEN n > 1 THEN rmse END AS rmse FROM b LEFT JOIN s USING (ord)")
def bracket_scores(spark, d):
    return rounded(metrics.bracket_scores(guess(spark, d), BRACKETS))


@query("bracket_mae", f"WITH {_GUESS}, {_BRACKETS} SELECT ord, name, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae FROM p JOIN b ON y >= lo AND y < hi GROUP BY ALL")
def bracket_mae(spark, d):
    return rounded(metrics.bracket_mae(guess(spark, d), BRACKETS))


@query("target_distribution", f"WITH {_GUESS}, {_BRACKETS} SELECT ord, name, count(y) AS n, round(count(y) / (SELECT count(*) FROM p), 6) AS frac, round(coalesce(avg(y), 0), 6) AS mean, round(CASE WHEN count(y) > 1 THEN stddev_pop(y) ELSE 0 END, 6) AS std FROM b LEFT JOIN p ON y >= lo AND y < hi GROUP BY ord, name")
def target_distribution(spark, d):
    return rounded(metrics.target_distribution(guess(spark, d), BRACKETS))


@query(
    "recap",
    f"""WITH {_GUESS}, s AS (SELECT fold, avg(abs(y - pred)) AS mae, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - pred) ** 2)) AS rmse FROM p WHERE fold < 4 GROUP BY fold),
h AS (SELECT count(*) AS n, avg(abs(y - pred)) AS mae, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - pred) ** 2)) AS rmse FROM p WHERE fold = 4),
a AS (SELECT count(*) AS k, avg(mae) AS mae, stddev_pop(mae) AS mae_s, avg(r2) AS r2, stddev_pop(r2) AS r2_s, avg(rmse) AS rmse, stddev_pop(rmse) AS rmse_s FROM s)
SELECT k, round(a.mae, 6) AS dev_mae, round(mae_s, 6) AS dev_mae_std, round(a.r2, 6) AS dev_r2, round(r2_s, 6) AS dev_r2_std, round(a.rmse, 6) AS dev_rmse, round(rmse_s, 6) AS dev_rmse_std, h.n AS sanctified_n, round(h.mae, 6) AS sanctified_mae, round(h.r2, 6) AS sanctified_r2, round(h.rmse, 6) AS sanctified_rmse, round(a.mae - h.mae, 6) AS mae_gap, round(a.r2 - h.r2, 6) AS r2_gap FROM a, h""",
)
def recap(spark, d):
    p = guess(spark, d)
    out = metrics.recap(p.where("fold < 4"), p.where("fold = 4"))
    return rounded(out.drop(*[f"dev_{m}_per_fold" for m in ("mae", "r2", "rmse")]))


# Ridge
_FIT = "s AS (SELECT {by}count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {src}{group})"
_SLOPE = "(n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx)"


@query("ridge_weights", f"WITH i AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), {_FIT.format(by='', src='i', group='')} SELECT round({_SLOPE}, 4) AS w, round((sy - {_SLOPE} * sx) / n, 4) AS bias FROM s")
def ridge_weights(spark, d):
    w = ridge.ridge_solve(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 1.0)
    return spark.createDataFrame([(float(w[0]), float(w[1]))], "w double, bias double").select(r("w", 4).alias("w"), r("bias", 4).alias("bias"))


@query("ridge_predict", f"WITH i AS (SELECT *, l_quantity AS x, l_extendedprice AS y FROM lineitem), {_FIT.format(by='', src='i', group='')} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({_SLOPE} * x + (sy - {_SLOPE} * sx) / n, 4) AS pred FROM i, s")
def ridge_predict(spark, d):
    df = items(spark, d)
    w = ridge.ridge_solve(df, ["l_quantity"], "l_extendedprice", 1.0)
    return ridge.ridge_predict(df, ["l_quantity"], w).select(*LINEITEM_ID, r("pred", 4).alias("pred"))


@query("ridge_out_of_fold", f"WITH {_ORDERS}, {_FOLDED}, i AS (SELECT k.fold AS k, day AS x, o_totalprice AS y FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold), {_FIT.format(by='k, ', src='i', group=' GROUP BY k')} SELECT o_orderkey, fold, round({_SLOPE} * day + (sy - {_SLOPE} * sx) / n, 4) AS pred FROM f JOIN s ON s.k = fold")
def ridge_out_of_fold(spark, d):
    folded = splits.kfold(orders(spark, d), ["o_orderkey"], 5, SEED)
    weights = ridge.ridge_out_of_fold(folded, ["day"], "o_totalprice", 1.0)
    return ridge.predict_by(folded, ["day"], weights, "fold").select("o_orderkey", "fold", r("pred", 4).alias("pred"))


@query(
    "hier_ridge",
    f"""WITH i AS (SELECT *, l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM i GROUP BY ROLLUP (l_returnflag, l_linestatus)),
w AS (SELECT a, b, {_SLOPE} AS w, (sy - {_SLOPE} * sx) / n AS c FROM s),
m AS (SELECT z.a, z.b, 0.8::DOUBLE * z.w + 0.2::DOUBLE * (0.8::DOUBLE * y.w + 0.2::DOUBLE * g.w) AS w, 0.8::DOUBLE * z.c + 0.2::DOUBLE * (0.8::DOUBLE * y.c + 0.2::DOUBLE * g.c) AS c
  FROM w z JOIN w y ON y.a = z.a AND y.b IS NULL JOIN w g ON g.a IS NULL AND g.b IS NULL WHERE z.b IS NOT NULL)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w * x + c, 4) AS pred FROM i JOIN m ON a = l_returnflag AND b = l_linestatus""",
)
def hier_ridge(spark, d):
    df = load(spark, d, "lineitem")
    model = ridge.HierarchicalRidge(["l_quantity"], "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return model.fit_predict(df).select(*LINEITEM_ID, r("pred", 4).alias("pred"))


_AGG = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy"
_WB = f"{_SLOPE} AS w, (sy - {_SLOPE} * sx) / n AS c"


@query(
    "hier_ridge_typed_groups",
    f"""WITH i AS (SELECT *, l_quantity AS x, l_extendedprice AS y, l_discount > 0.05::DOUBLE AS cheap, nullif(l_returnflag, 'N') AS flag FROM lineitem),
g AS (SELECT {_WB} FROM (SELECT {_AGG} FROM i)), a AS (SELECT cheap, {_WB} FROM (SELECT cheap, {_AGG} FROM i GROUP BY cheap)), b AS (SELECT cheap, flag, {_WB} FROM (SELECT cheap, flag, {_AGG} FROM i GROUP BY cheap, flag)),
m AS (SELECT b.cheap, b.flag, 0.8::DOUBLE * b.w + 0.2::DOUBLE * (0.8::DOUBLE * a.w + 0.2::DOUBLE * g.w) AS w, 0.8::DOUBLE * b.c + 0.2::DOUBLE * (0.8::DOUBLE * a.c + 0.2::DOUBLE * g.c) AS c FROM b JOIN a ON a.cheap = b.cheap, g)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w * x + c, 4) AS pred FROM i JOIN m ON m.cheap = i.cheap AND m.flag IS NOT DISTINCT FROM i.flag""",
)
def hier_ridge_typed_groups(spark, d):
    """A boolean group and one with nulls."""
    df = load(spark, d, "lineitem").withColumns({"cheap": F.col("l_discount") > 0.05, "flag": F.expr("nullif(l_returnflag, 'N')")})
    return ridge.HierarchicalRidge(["l_quantity"], "l_extendedprice", ["cheap", "flag"]).fit_predict(df).select(*LINEITEM_ID, r("pred", 4).alias("pred"))


# Hints and routes
@query("y_hint", f"WITH {_GUESS} SELECT o_orderkey, round(1 / (1 + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (pred - 165000.0::DOUBLE) / 5000.0::DOUBLE)))), 6) AS ind_0, round(1 / (1 + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (pred - 190000.0::DOUBLE) / 5000.0::DOUBLE)))), 6) AS ind_1, round(pred, 6) AS pred FROM p")
def y_hint(spark, d):
    return rounded(hint.augment(guess(spark, d).select("o_orderkey", "pred"), "pred", [165000.0, 190000.0], 5000.0))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, value)))), 6) AS s FROM events")
def sigmoid_query(spark, d):
    return load(spark, d, "events").select("event_id", r(sigmoid(F.col("value"))).alias("s"))


@query("route_digitize", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END AS INT) AS bin, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS route FROM orders")
def route_digitize(spark, d):
    t = [100000.0, 300000.0]
    return load(spark, d, "orders").select("o_orderkey", digitize(F.col("o_totalprice"), t).alias("bin"), route(F.col("o_totalprice"), t, ["low", "mid", "high"]).alias("route"))


@query("routing_distribution", "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS route, count(*) AS n FROM orders GROUP BY 1")
def routing_distribution(spark, d):
    df, names = orders(spark, d), ["low", "mid", "high"]
    model = models.RoutedModel(None, {n: models.RidgeModel() for n in names}, lambda df, _: route(F.col("o_totalprice"), [100000.0, 300000.0], names))
    return model.fit(df, ["day"], "o_totalprice", ["o_orderkey"]).routing_distribution(df)


@query("range_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000")
def range_predicate(spark, d):
    return load(spark, d, "orders").where((F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") < 300000)).select("o_orderkey", "o_totalprice")


@query("nan_mask", "SELECT event_id, user_id % 7 = 0 AS missing FROM events")
def nan_mask(spark, d):
    x = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return load(spark, d, "events").select("event_id", nan_to_null(x).isNull().alias("missing"))


# Networks and models on top of them: no SQL
def _trained(spark, d, model) -> DataFrame:
    """Predictions for the test rows of a model fitted to the training rows."""
    rows = splits.train_test(orders(spark, d).withColumn("y", F.col("o_totalprice") / 100000.0), ["o_orderkey"], 0.2, SEED).persist()
    fitted = model.fit(rows.where("role = 'train'"), ["cust", "day"], "y", ["o_orderkey"])
    return fitted.predict(rows.where("role = 'test'")).select("o_orderkey", "y", "pred")


def net(**settings) -> models.NLModel:
    return models.NLModel(NetConfig(hidden_sizes=(4,), epochs=60), **settings)


query("nn_train_predict")(lambda spark, d: _trained(spark, d, net()))
query("ensemble")(lambda spark, d: _trained(spark, d, models.EnsembleModel(net(), 3)))
query("stacked")(lambda spark, d: _trained(spark, d, models.StackedModel(models.RidgeModel(), net(), oof_folds=3)))


@query("cascade")
def cascade(spark, d):
    bins = (models.BinConfig("low", models.RidgeModel(), (0.0, 2.0)), models.BinConfig("high", net(), (1.5, 6.0)))
    return _trained(spark, d, models.build_cascade(models.CascadeConfig(models.RidgeModel(), (2.5,), bins, epochs=60)))


@query("step_pipeline", f"WITH {_ORDERS}, t AS (SELECT *, CASE WHEN {_RANK.format(k='o_orderkey')} < floor((1 - 0.2::DOUBLE) * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS role FROM o), q AS (SELECT avg(day) AS a, stddev_pop(day) AS s FROM t WHERE role = 'train'), i AS (SELECT o_orderkey, role, (day - a) / s AS x, o_totalprice AS y FROM t, q), {_FIT.format(by='', src='i', group=chr(32) + 'WHERE role = ' + chr(39) + 'train' + chr(39))} SELECT o_orderkey, round({_SLOPE} * x + (sy - {_SLOPE} * sx) / n, 4) AS pred FROM i, s WHERE role = 'test'")
def step_pipeline(spark, d):
    rows = splits.train_test(orders(spark, d), ["o_orderkey"], 0.2, SEED)
    p = Pipeline().add("impute").add("normalize").set_model(models.RidgeModel())
    p.fit(rows.where("role = 'train'"), "o_totalprice", ["day"], ["o_orderkey"], rows.where("role = 'test'"))
    return p.predict().select("o_orderkey", r("pred", 4).alias("pred"))


# Compound models of ridge members, which SQL can state
_SPLIT = f"{_ORDERS}, t AS (SELECT o_orderkey, day AS x, o_totalprice AS y, CASE WHEN {_RANK.format(k='o_orderkey')} < floor((1 - 0.2::DOUBLE) * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS role FROM o)"


def _tested(spark, d, model) -> DataFrame:
    rows = splits.train_test(orders(spark, d), ["o_orderkey"], 0.2, SEED).persist()
    fitted = model.fit(rows.where("role = 'train'"), ["day"], "o_totalprice", ["o_orderkey"])
    return fitted.predict(rows.where("role = 'test'")).select("o_orderkey", r("pred", 4).alias("pred"))


@query(
    "stacked_ridge",
    f"""WITH {_SPLIT}, tr AS (SELECT *, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // 3), 2) AS INT) AS fold FROM t WHERE role = 'train'),
s AS (SELECT k, {_WB} FROM (SELECT k.fold AS k, {_AGG} FROM tr JOIN (SELECT DISTINCT fold FROM tr) k ON tr.fold <> k.fold GROUP BY k.fold)),
one AS (SELECT {_WB} FROM (SELECT {_AGG} FROM tr)), two AS (SELECT {_WB} FROM (SELECT {_AGG} FROM (SELECT s.w * x + s.c AS x, y FROM tr JOIN s ON s.k = fold)))
SELECT o_orderkey, round(two.w * (one.w * x + one.c) + two.c, 4) AS pred FROM t, one, two WHERE role = 'test'""",
)
def stacked_ridge(spark, d):
    return _tested(spark, d, models.StackedModel(models.RidgeModel(), models.RidgeModel(), "replace", 3))


@query(
    "ensemble_ridge",
    f"""WITH {_SPLIT}, s AS (SELECT {_AGG} FROM t WHERE role = 'train'), a AS (SELECT {_WB} FROM s), b AS (SELECT {_WB.replace('sxx + 1', 'sxx + 1000000')} FROM s)
SELECT o_orderkey, round((a.w * x + a.c + b.w * x + b.c) / 2, 4) AS pred FROM t, a, b WHERE role = 'test'""",
)
def ensemble_ridge(spark, d):
    return _tested(spark, d, models.EnsembleModel(models=[models.RidgeModel(1.0), models.RidgeModel(1_000_000.0)]))


@query(
    "cascade_ridge",
    f"""WITH {_SPLIT}, tr AS (SELECT * FROM t WHERE role = 'train'), g AS (SELECT {_WB} FROM (SELECT {_AGG} FROM tr)),
a AS (SELECT {_WB} FROM (SELECT {_AGG} FROM tr WHERE y >= 0 AND y < 300000)), b AS (SELECT {_WB} FROM (SELECT {_AGG} FROM tr WHERE y >= 200000 AND y < 1000000))
SELECT o_orderkey, round(CASE WHEN g.w * x + g.c < 250000 THEN a.w * x + a.c ELSE b.w * x + b.c END, 4) AS pred FROM t, g, a, b WHERE role = 'test'""",
)
def cascade_ridge(spark, d):
    bins = (models.BinConfig("low", models.RidgeModel(), (0.0, 300_000.0)), models.BinConfig("high", models.RidgeModel(), (200_000.0, 1_000_000.0)))
    return _tested(spark, d, models.build_cascade(models.CascadeConfig(models.RidgeModel(), (250_000.0,), bins)))


# Validated data, a holdout, an experiment and a workbench: one order of each day
DAILY = DatasetSpec("o_orderkey", "day", "o_totalprice")
_DAILY = f"""{_ORDERS.replace('FROM orders', 'FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) = 1')},
h AS (SELECT o_orderkey, day AS x, o_totalprice AS y, {_RANK.format(k='o_orderkey')} < greatest(1, floor((SELECT count(*) FROM o) * 0.15::DOUBLE)) AS held FROM o),
dev AS (SELECT * FROM h WHERE NOT held), f AS (SELECT *, CAST(least(({_RANK.format(k='o_orderkey')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM dev),
s AS (SELECT k, {_WB} FROM (SELECT k.fold AS k, {_AGG} FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold)), g AS (SELECT {_WB} FROM (SELECT {_AGG} FROM dev)),
p AS (SELECT o_orderkey, fold, y, w * x + c AS pred FROM f JOIN s ON s.k = fold), q AS (SELECT o_orderkey, y, w * x + c AS pred FROM h, g WHERE held)"""
_CONFIG = ExperimentConfig(dedup="keep-first", stratify=False)


def daily(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # most rows share a day with another
        return load_dataset(orders(spark, d), DAILY, _CONFIG)


@query("sanctified_dataset", f"WITH {_DAILY} SELECT o_orderkey, x AS day FROM dev")
def sanctified_dataset(spark, d):
    return daily(spark, d).dev.select("o_orderkey", "day")


@query("dev_folds", f"WITH {_DAILY} SELECT k.fold, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS role, o_orderkey FROM f, (SELECT DISTINCT fold FROM f) k")
def dev_folds(spark, d):
    return daily(spark, d).dev_folds(5)[0].select("fold", "role", "o_orderkey")


@query("experiment_oof", f"WITH {_DAILY} SELECT o_orderkey, fold, round(pred, 4) AS pred FROM p")
def experiment_oof(spark, d):
    x = Experiment(daily(spark, d), _CONFIG)
    x.evaluate_dev(models.RidgeModel)
    return x.oof.select("o_orderkey", "fold", r("pred", 4).alias("pred"))


@query("experiment_final", f"WITH {_DAILY} SELECT o_orderkey, round(pred, 4) AS pred FROM q")
def experiment_final(spark, d):
    return Experiment(daily(spark, d), _CONFIG).run(models.RidgeModel, verbose=False).final.select("o_orderkey", r("pred", 4).alias("pred"))


@query(
    "research_history",
    f"""WITH {_DAILY}, d AS (SELECT fold, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) ** 2)) AS rmse FROM p GROUP BY fold)
SELECT 'plain' AS experiment, round(avg(mae), 4) AS dev_mae, round(stddev_pop(mae), 4) AS dev_mae_std, round(avg(rmse), 4) AS dev_rmse, (SELECT round(avg(abs(y - pred)), 4) FROM q) AS sanctified_mae, (SELECT round(sqrt(avg((y - pred) ** 2)), 4) FROM q) AS sanctified_rmse FROM d""",
)
def research_history(spark, d):
    """A run of the workbench, remembered, and read back from disk."""
    where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/holdfast_{uuid.uuid4().hex}"
    lab = Research(spark, "daily", lambda data_dir, config: daily(spark, data_dir), _CONFIG, save_dir=where)
    lab.new_experiment("plain", lambda ctx: models.RidgeModel())
    with contextlib.redirect_stdout(io.StringIO()):
        lab.run(data_dir=d)
    names = ["dev_mae", "dev_mae_std", "dev_rmse", "sanctified_mae", "sanctified_rmse"]
    return RunHistory(load_runs(spark, where)).scores().select("experiment", *[r(m, 4).alias(m) for m in names])


# History
_RUNS = [("2024-01-01T00:00:00+00:00", False, {"a": 5.0, "b": 7.0}), ("2024-01-02T00:00:00+00:00", True, {"a": 4.5}), ("2024-01-03T00:00:00+00:00", False, {"a": 4.75, "b": 6.0}), ("2024-01-04T00:00:00+00:00", False, {"b": 6.0})]
_RUN_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(q).lower()}, '{e}', {v}::DOUBLE, {100 - v}::DOUBLE)" for t, q, x in _RUNS for e, v in x.items()) + ") t(timestamp, quick, experiment, mae, r2))"


def history(spark: SparkSession) -> RunHistory:
    rows = []
    for t, q, x in _RUNS:
        told = {e: (*[{"dev_mae": v + 1, "sanctified_mae": v, "sanctified_r2": 100 - v}.get(m) for m in METRICS], None, i) for i, (e, v) in enumerate(x.items())}
        rows.append((t, "demo", q, None, None, None, None, None, None, told))
    return RunHistory(spark.createDataFrame(rows, SCHEMA))


@query("history_best", f"WITH {_RUN_SQL} SELECT experiment, timestamp, mae FROM r QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY mae, timestamp) = 1")
def history_best(spark, d):
    h = history(spark)
    rows = [(e, b["timestamp"], b["experiments"][e]["sanctified_mae"]) for e in ("a", "b") if (b := h.best(experiment=e))]
    return spark.createDataFrame(rows, "experiment string, timestamp string, mae double")


@query("history_compare", f"WITH {_RUN_SQL}, l AS (SELECT *, mae - lag(mae) OVER (PARTITION BY experiment ORDER BY timestamp) AS delta FROM r) SELECT experiment, min(mae) AS best_mae, arg_max(mae, timestamp) AS latest_mae, arg_max(delta, timestamp) AS delta, max(r2) AS best_r2, count(*) AS n_runs FROM l GROUP BY experiment")
def history_compare(spark, d):
    return history(spark).compare("a", "b")


@query("history_table", f"WITH {_RUN_SQL} SELECT timestamp, CASE WHEN quick THEN 'quick' ELSE 'full' END AS mode, max(mae) FILTER (experiment = 'a') AS a, max(mae) FILTER (experiment = 'b') AS b FROM r GROUP BY ALL")
def history_table(spark, d):
    return history(spark).table(["a", "b"])


@query("history_since", f"WITH {_RUN_SQL} SELECT DISTINCT timestamp, quick FROM r WHERE timestamp >= '2024-01-02' AND NOT quick")
def history_since(spark, d):
    return history(spark).since("2024-01-02T00:00:00+00:00").full().runs.select("timestamp", "quick")


@query("history_last", f"WITH {_RUN_SQL} SELECT DISTINCT timestamp FROM r WHERE timestamp > '2024-01-02T01'")
def history_last(spark, d):
    return history(spark).last(2).runs.select("timestamp")


# The whole life of an experiment
@query(
    "orders_lifecycle",
    f"""WITH {_ORDERS.replace('FROM orders', 'FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) = 1')},
h AS (SELECT *, {_RANK.format(k='o_orderkey')} < greatest(1, floor((SELECT count(*) FROM o) * 0.15::DOUBLE)) AS held FROM o),
dev AS (SELECT * FROM h WHERE NOT held),
f AS (SELECT *, CAST(least(({_RANK.format(k='o_orderkey')}) // (count(*) OVER () // 5), 4) AS INT) AS fold FROM dev),
m AS (SELECT k.fold AS k, avg(day) AS a, stddev_pop(day) AS sd FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold),
i AS (SELECT m.k, (day - a) / sd AS x, o_totalprice AS y, f.fold <> m.k AS train FROM f, m),
{_FIT.format(by='k, ', src='i', group=' WHERE train GROUP BY k')},
p AS (SELECT i.k AS fold, y, {_SLOPE} * x + (sy - {_SLOPE} * sx) / n AS pred FROM i JOIN s USING (k) WHERE NOT train)
SELECT fold, count(*) AS n, round(avg(abs(y - pred)), 4) AS mae, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse FROM p GROUP BY fold""",
)
def orders_lifecycle(spark, d):
    """Keep-first dedup, a holdout by hash, five folds, scaling and ridge from the other folds' sums, metrics by fold. All folds
    are scaled, fitted and scored in one job each."""
    rows = dedup.dedup_keep_first(orders(spark, d), ORDERS).rows
    dev = splits.sanctified(rows, ["o_orderkey"], 0.15, SEED).where("split = 'dev'").drop("split").persist()
    folded = splits.kfold(dev, ["o_orderkey"], 5, SEED)
    stats = preprocess.out_of_fold_moments(folded, ["day"]).select(F.col("fold").alias("k"), "mean_day", "std_day")
    each = folded.join(F.broadcast(stats))  # one row a fold: each row trains in four and is tested in one
    scaled = each.withColumn("x", (F.col("day") - F.col("mean_day")) / F.when(F.col("std_day") < 1e-12, 1.0).otherwise(F.col("std_day")))
    sums = scaled.where("fold <> k").groupBy("k").agg(*ridge.gram_columns(["x"], "o_totalprice")).collect()
    weights = {s["k"]: ridge.solve(s, 1, 1.0) for s in sums}
    tested = ridge.predict_by(scaled.where("fold = k"), ["x"], weights, "fold")
    out = metrics.scores(tested, "o_totalprice", "pred", ["fold"])
    return out.select("fold", "n", *[r(m, 4).alias(m) for m in ("mae", "r2", "rmse")])
