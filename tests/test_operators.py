"""Hand-computed edge cases, and what must hold whatever the data."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import derive_seeds, digitize, hash_key, sigmoid
from holdfast.operators import checks, dedup, ensembles, metrics, preprocess, ridge, splits
from holdfast.operators.holdout import SanctifiedDataset, ValidatedDataset, load_dataset
from holdfast.operators.models import BinConfig, CascadeConfig, EnsembleModel, NLModel, RidgeModel, RoutedModel, StackedModel, build_cascade
from holdfast.operators import nn
from holdfast.operators.nn import NetConfig, run_network, train_stack
from holdfast.operators.ranks import hash_ranked, ordered, permuted, quantiles
from holdfast.plans.experiment import Experiment
from holdfast.plans.pipeline import Pipeline, Step, register_step_type
from holdfast.plans.research import Research
from holdfast.spec import DataError, DatasetSpec, ExperimentConfig, HoldoutError

XY = DatasetSpec("id", "x", "y")


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 20.0), (2, 1.0, 30.0), (3, 3.0, 5.0)], "id long, x double, y double")


@pytest.fixture(scope="module")
def planted(spark):
    """y = 3 x1 - 2 x2 + 5 and a little noise, x from hashes."""
    u = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(name), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    df = spark.range(400).withColumns({"x1": u("a"), "x2": u("b")})
    return df.withColumns({"y": 3 * F.col("x1") - 2 * F.col("x2") + 5 + 0.01 * u("c"), "g": (F.col("id") % 7).cast("string")}).cache()


PLANTED = DatasetSpec("id", ("x1", "x2"), "y", group="g")


def test_dedup(copies):
    a = dedup.dedup_exact(copies, XY)
    assert sorted(map(tuple, a.rows.collect())) == [(1, 2.0, 20.0), (3, 3.0, 5.0)] and a.report() == {"n_dropped": 2, "n_groups": 1}
    b = dedup.dedup_average(copies, XY)
    assert sorted(map(tuple, b.rows.collect())) == [(0, 1.0, 20.0), (1, 2.0, 20.0), (3, 3.0, 5.0)] and b.report()["n_merged"] == 1
    c = dedup.dedup_keep_first(copies, XY)
    assert sorted(map(tuple, c.rows.collect())) == [(0, 1.0, 10.0), (1, 2.0, 20.0), (3, 3.0, 5.0)] and c.report()["n_dropped"] == 1
    assert [tuple(r) for r in dedup.duplicate_pairs(copies, XY).collect()] == [(0, 2)]
    with pytest.warns(UserWarning):
        dedup.apply_dedup(copies, XY, "exact")
    with pytest.raises(ValueError):
        dedup.apply_dedup(copies, XY, "other")
    assert dedup.apply_dedup(copies, XY, None).count() == 4


def test_signed_zero_and_nan(spark):
    df = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, float("nan")), (3, float("nan"))], "id long, x double")
    spec = DatasetSpec("id", "x")
    assert dedup.dedup_keep_first(df, spec).rows.count() == 2
    assert dedup.dedup_keep_first(df, spec, bits=True).rows.count() == 3
    assert [tuple(r) for r in dedup.duplicate_pairs(df, spec, bits=True).collect()] == [(2, 3)]


def test_degenerate(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, 1.0), (float("nan"), 1.0, None, 2.0)], "a double, b double, c double, d double")
    assert {r["column"]: r["status"] for r in checks.column_profile(df, list("abcd")).collect()} == {"a": "all_nan", "b": "zero_variance", "c": "zero_variance", "d": "ok"}
    with pytest.raises(DataError, match="all_nan"):
        checks.check_degenerate_columns(df, list("abcd"))
    with pytest.raises(DataError, match="zero"):
        checks.check_degenerate_columns(df, list("bcd"))


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.RandomState(1)
    x = rng.rand(120, 3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {(r["id_a"]["id"], r["id_b"]["id"]) for r in checks.near_duplicate_pairs(df, DatasetSpec("id", ("a", "b", "c")), 0.15).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(x[i] - x[j]) <= 0.15} and got


def test_near_conflicts_with_copies(spark, monkeypatch):
    """Copies, missing values and targets, values beyond a long's cells; lists of ids of any length."""
    rng = np.random.RandomState(2)
    x = [[1e300, 0.0], [1e300, 0.0], [float("inf"), 0.0], [None, 0.1], *np.repeat(rng.rand(40, 2), 5, axis=0).tolist()]
    y = [None if i % 50 == 7 else float("nan") if i % 50 == 9 else float(i % 3) for i in range(len(x))]
    df = spark.createDataFrame([(i * 7919 % 1009, *v, t) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    spec, rows = DatasetSpec("id", ("a", "b"), "y"), sorted(tuple(r) for r in df.collect())
    far = lambda p, q: float(np.hypot(*[(u or 0.0) - (v or 0.0) for u, v in zip(p[1:3], q[1:3])]))
    with np.errstate(invalid="ignore"):
        near = [(p, q) for i, p in enumerate(rows) for q in rows[i + 1 :] if far(p, q) <= 0.1]
    want, apart = [(p[0], q[0]) for p, q in near], [(p[0], q[0]) for p, q in near if p[3] is None or p[3] != q[3]]
    monkeypatch.setattr(checks, "MEMBERS", 2)
    pairs = checks.near_duplicate_pairs(df, spec, 0.1)
    ids = lambda found: sorted((r["id_a"]["id"], r["id_b"]["id"]) for r in found.collect())
    assert ids(pairs) == want and len(apart) < len(want)
    assert ids(checks.label_conflicts(pairs, df, spec)) == ids(checks.near_label_conflicts(df, spec, 0.1)) == apart
    at = {r[0]: r[3] for r in rows}
    assert all(repr(r["y_a"]) == repr(at[r["id_a"]["id"]]) and repr(r["y_b"]) == repr(at[r["id_b"]["id"]]) for r in checks.near_label_conflicts(df, spec, 0.1).collect())


def test_near_conflicts_of_one_large_point(spark):
    """Pairs of equal targets aren't made: these would be 2e10."""
    df = spark.range(200_000).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), (F.col("id") == 77).cast("int").alias("y"))
    assert checks.near_label_conflicts(df, DatasetSpec("id", ("a", "b"), "y"), 0.5).count() == 199_999


def test_fingerprint(spark):
    few = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "id long, x double, g string")
    assert checks.fingerprint_check(few, DatasetSpec("id", "x", group="g")).first()["risk"] == "skip"
    three = spark.createDataFrame([(i, 100.0 * (i % 3) + i / 1000, "abc"[i % 3]) for i in range(60)], "id long, x double, g string")
    found = checks.fingerprint_check(three, DatasetSpec("id", "x", group="g")).first()
    assert found["accuracy"] == 1 and found["ratio"] <= 3 and found["risk"] == "medium"


def sizes(df, column="fold"):
    return [r["count"] for r in df.groupBy(column).count().orderBy(column).collect()]


def test_folds(spark):
    df = spark.range(13)
    a = splits.kfold(df, ["id"], 5)
    assert sizes(a) == [2, 2, 2, 2, 5]
    again = splits.kfold(df.repartition(7), ["id"], 5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, again.collect()))
    assert sizes(splits.contiguous_folds(spark.range(10), ["id"], 3)) == [3, 3, 4]
    for k in (1, 14):
        with pytest.raises(DataError):
            splits.kfold(df, ["id"], k)
    grouped = splits.grouped_kfold(spark.range(60).withColumn("g", F.col("id") % 11), "g", 5)
    assert grouped.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty()
    member = splits.membership(a, ["id"], 5)
    checks.check_split(member, df)
    with pytest.raises(DataError):
        checks.check_split(member.unionByName(member.limit(1)), df)


def test_expanding_window(spark):
    def ends(**kw):
        rows = splits.expanding_window(spark.range(10), ["id"], **kw).groupBy("fold", "role").agg(F.min("id"), F.max("id")).collect()
        return {(r[0], r[1]): (r[2], r[3] + 1) for r in rows}

    assert ends(k=3, gap=1) == {(0, "train"): (0, 2), (0, "test"): (3, 4), (1, "train"): (0, 4), (1, "test"): (5, 6), (2, "train"): (0, 6), (2, "test"): (7, 10)}
    assert ends(k=3, gap=2) == {(2, "train"): (0, 6), (2, "test"): (8, 10)}
    for n, gap in ((10, 4), (3, 0)):
        with pytest.raises(DataError):
            splits.expanding_window(spark.range(n), ["id"], 3, gap)


def test_holdouts(spark):
    assert sizes(splits.temporal_split(spark.range(20), ["id"], 0.15), "split") == [17, 3]
    assert sizes(splits.temporal_split(spark.range(2), ["id"], 0.9), "split") == [1, 1]
    assert sizes(splits.sanctified(spark.range(20), ["id"], 0.15), "split") == [17, 3]
    groups = splits.sanctified(spark.range(14).withColumn("g", F.col("id") % 7), ["id"], 0.15, group="g")
    assert groups.where("split = 'sanctified'").select("g").distinct().count() == 1
    labels = spark.createDataFrame([(i, 0 if i < 6 else 1 if i < 10 else 2) for i in range(11)], "id long, y int")
    held = splits.sanctified(labels, ["id"], 0.25, stratify="y").where("split = 'sanctified'")
    assert sorted(r["y"] for r in held.collect()) == [0, 1]
    with pytest.raises(DataError):
        splits.sanctified(spark.range(5).withColumn("g", F.lit(1)), ["id"], 0.2, group="g")


def test_mersenne_twister_order(spark):
    order = lambda df: [r[0] for r in df.orderBy("rank").collect()]
    assert order(permuted(spark.range(10).repartition(3), ["id"], 42)) == [8, 1, 5, 0, 7, 2, 9, 4, 3, 6]
    assert order(permuted(spark.range(13), ["id"], 42)) == [11, 9, 0, 8, 5, 2, 1, 12, 4, 7, 10, 3, 6]
    letters = spark.createDataFrame([(i, "abcdefg"[i % 7]) for i in range(21)], "id long, g string")
    folds = {r["g"]: r["fold"] for r in splits.grouped_kfold(letters, "g", 3, compat_rng=True).collect()}
    assert folds == {"a": 0, "b": 0, "f": 1, "c": 1, "e": 2, "d": 2, "g": 2}
    held = lambda df: sorted(r["id"] for r in df.where("split = 'sanctified'").collect())
    assert held(splits.sanctified(spark.range(20), ["id"], 0.15, compat_rng=True)) == [0, 15, 17]
    labels = spark.createDataFrame([(i, 0 if i < 6 else 1 if i < 10 else 2) for i in range(11)], "id long, y int")
    assert held(splits.sanctified(labels, ["id"], 0.25, stratify="y", compat_rng=True)) == [0, 7]
    tests = splits.kfold(spark.range(13), ["id"], 5, compat_rng=True).where("fold = 1")
    assert sorted(r["id"] for r in tests.collect()) == [0, 8]
    assert sorted(r["id"] for r in splits.train_test(spark.range(10), ["id"], 0.2, compat_rng=True).where("role = 'test'").collect()) == [3, 6]


def test_ranks_and_quantiles(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"))
    assert ordered(df, ["id"]).where("rank <> id").isEmpty()
    ranked = hash_ranked(df, ["id"], 42)
    want = [r["id"] for r in df.orderBy(hash_key(["id"], 42), "id").collect()]
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == want
    x = spark.createDataFrame([(v,) for v in (1.0, 5.5, 2.25, 9.0, 7.75, 3.0, float("nan"), None)], "x double")
    assert quantiles(x, "x", [0.5]) == [4.25]
    assert quantiles(x, "x", [i / 10 for i in range(11)]) == pytest.approx([1, 1.625, 2.25, 2.625, 3, 4.25, 5.5, 6.625, 7.75, 8.375, 9])
    assert quantiles(x.where("x is null"), "x", [0.5]) == []


def test_preprocess(spark):
    train = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "x double, z double")
    test = spark.createDataFrame([(None, 7.0)], "x double, z double")
    p = preprocess.fold_impute(train, test, ["x", "z"])
    assert sorted(r["x"] for r in p.train.collect()) == [1, 2, 3] and p.test.first()["x"] == 2
    assert all(r["z"] is None for r in p.train.collect())
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    q = preprocess.fold_normalize(flat, spark.createDataFrame([(6.0,)], "x double"), ["x"])
    assert [r["x"] for r in q.train.collect()] == [0, 0] and q.test.first()["x"] == 2
    stats = preprocess.compute_norm_stats(flat, ["x"])
    assert preprocess.normalize(spark.createDataFrame([(6.0,)], "x double"), stats).first()["x"] == pytest.approx(2e12)


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], "y double, pred double")
    got = [tuple(r) for r in metrics.bracket_scores(df, [(0, 1), (1, 2), (2, 3), (5, 6)]).orderBy("ord").collect()]
    assert [g[2] for g in got] == [1, 2, 1, 0]
    assert got[1][3:] == pytest.approx((0.5, 0.0, 0.5**0.5)) and got[0][3:] == (None, None, None)
    assert [r["mae"] for r in metrics.bracket_mae(df, [(0, 1), (1, 2), (2, 3), (5, 6)]).orderBy("ord").collect()] == [0, 0.5, 0]
    assert metrics.scores(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "y double, pred double")).first()["r2"] == -809
    assert metrics.target_distribution(df, [(5, 6)]).first()[2:] == (0, 0.0, 0.0, 0.0)


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 10.0, 49.9, 50.0, 60.0, float("nan"))], "x double")
    assert [r[0] for r in df.select(digitize(F.col("x"), [10, 50])).collect()] == [0, 1, 1, 2, 2, 2]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-100.0, -1.0, 0.0, 1.0, 100.0)], "x double").select(sigmoid(F.col("x"))).collect()]
    assert got == pytest.approx([2.0611536181902037e-09, 0.26894142, 0.5, 0.73105858, 0.9999999979388463])
    assert derive_seeds(42, 3, "ensemble") == [1200667537, 3632213663, 3802671349] and derive_seeds(42, 2, "init") == [1803747366, 4209647510]


def test_ridge(spark, planted):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 2.0), (3.0, 4.0, 3.0), (4.0, 3.0, 4.0)], "a double, b double, y double")
    assert ridge.ridge_solve(df, ["a", "b"], "y") == pytest.approx([7 / 9, 1 / 9, 5 / 18])
    w = ridge.ridge_solve(planted, ["x1", "x2"], "y", 1e-6)
    assert w == pytest.approx([3, -2, 5.005], abs=0.01)
    with pytest.raises(np.linalg.LinAlgError):
        ridge.ridge_solve(df.limit(0).unionByName(df.limit(1)).withColumn("b", F.col("a")), ["a", "b"], "y", 0.0)
    sub = planted.withColumn("h", F.when(F.col("id") < 5, "few").otherwise("many"))
    model = ridge.HierarchicalRidge(["x1", "x2"], "y", ["h", "g"], 1.0, 0.2, [10, 1]).fit(sub)
    few = model.predict(sub.where("h = 'few'")).orderBy("id").collect()
    whole = ridge.ridge_predict(sub.where("h = 'few'"), ["x1", "x2"], model.levels[0].first()["w"]).orderBy("id").collect()
    assert [r["pred"] for r in few] == pytest.approx([r["pred"] for r in whole])


def test_network_matches_its_trainer(spark, planted):
    c = NetConfig(hidden_sizes=(3,), epochs=30)
    model = NLModel(c).fit(planted.repartition(5), ["x1", "x2"], "y", ["id"])
    rows = planted.orderBy("id").toPandas()
    x = (rows[["x1", "x2"]] - rows[["x1", "x2"]].mean()) / rows[["x1", "x2"]].std(ddof=0)
    want = run_network(x.to_numpy(), train_stack(x.to_numpy(), rows["y"].to_numpy(), [c])[0])
    got = [r["pred"] for r in model.predict(planted).orderBy("id").collect()]
    assert got == pytest.approx(want, rel=1e-6)
    with pytest.raises(RuntimeError):
        model.clone().predict(planted)
    assert model.analyze()["n_params"] == 13


def test_network_follows_the_gradient():
    """Steps against derivatives of the loss found by finite differences, of two networks at once."""
    r = np.random.RandomState(5)
    x, y = r.randn(40, 3), 10 * r.randn(40)
    configs = [NetConfig(hidden_sizes=(4, 2), epochs=3, seed=s, huber_delta=d, clip_grad=g) for s, d, g in ((1, 2.0, 0.05), (2, 100.0, 50.0))]
    for c, got in zip(configs, train_stack(x, y, configs)):
        draw = np.random.RandomState(c.seed)
        net = [p for a, b in ((3, 4), (4, 2), (2, 1)) for p in (draw.randn(a, b) * np.sqrt(2 / a), np.zeros(b))]
        pace = [np.zeros_like(p) for p in net]

        def loss():
            miss = np.abs(run_network(x, net) - y)
            return np.where(miss <= c.huber_delta, miss**2 / 2, c.huber_delta * (miss - c.huber_delta / 2)).mean()

        for _ in range(c.epochs):
            slopes = []
            for k, p in enumerate(net):
                slope = np.zeros_like(p)
                for at in np.ndindex(p.shape):
                    kept, values = p[at], []
                    for p[at] in (kept + 1e-5, kept - 1e-5):
                        values.append(loss())
                    p[at] = kept
                    slope[at] = (values[0] - values[1]) / 2e-5
                slopes.append(slope + c.l2 * p if k % 2 == 0 else slope / len(y))
            for p, v, slope in zip(net, pace, slopes):
                v *= c.momentum
                v -= c.lr * np.clip(slope, -c.clip_grad, c.clip_grad)
                p += v
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, net))


def test_network_of_many_rows(planted, monkeypatch):
    """A fold beyond a worker's bound trains over all partitions to the same network."""
    configs = [NetConfig(hidden_sizes=(3,), epochs=6, seed=s) for s in (1, 2)]
    rows = planted.withColumn("fold", F.lit(0)).repartition(3)
    want = nn.train_many(rows, ["x1", "x2"], "y", ["id"], configs)
    monkeypatch.setattr(nn, "LOCAL_ROWS", 10)
    got = nn.train_many(rows, ["x1", "x2"], "y", ["id"], configs)
    assert want.keys() == got.keys() and all(np.allclose(a, b) for k in want for a, b in zip(want[k], got[k]))


def test_network_steps_take_few_tasks(planted):
    """However many partitions the rows have, a step's tasks are as many as the cores; the dealing changes nothing."""
    sc, rows, n = planted.sparkSession.sparkContext, planted.repartition(40, "id"), planted.count()
    sc.setJobGroup("steps", "steps of a network")
    try:
        first, second = (nn.train_spread(rows, ["x1", "x2"], "y", [NetConfig(hidden_sizes=(3,), epochs=6, seed=s) for s in (1, 2)], n) for _ in range(2))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    results = [max(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("steps")]
    wide = sum(tracker.getStageInfo(s).numTasks > sc.defaultParallelism for s in results)
    assert len(results) >= 12 and wide <= 2  # once a training, to keep the rows
    assert all(np.array_equal(a, b) for one, two in zip(first, second) for a, b in zip(one, two))


def test_folds_sort_few_rows(spark):
    """contiguous_folds() numbers no row outside the stretches of its cuts; ties, nulls and other types are numbered as before."""
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("id"), F.lit("x").alias("s"), F.timestamp_seconds("id").alias("t"))
    for order in (["id"], ["id", "s"], ["t"]):
        got = splits.contiguous_folds(df, order, 7)
        assert got.schema["fold"].dataType.typeName() == "integer"
        assert ("Window" in got._jdf.queryExecution().toString()) == (order == ["t"])
        want = {r["id"]: min(i // (5000 // 7), 6) for i, r in enumerate(df.orderBy(*order).select("id").collect())}
        assert {r["id"]: r["fold"] for r in got.collect()} == want
    same = spark.range(100).select("id", F.when(F.col("id") > 4, F.col("id") % 2).alias("k"))
    assert sorted(r["count"] for r in splits.contiguous_folds(same, ["k"], 3).groupBy("fold").count().collect()) == [33, 33, 34]


def test_ridge_about_a_large_mean(spark):
    """Weights are exact to ten digits where plain sums of squares lose most of them."""
    rng = np.random.RandomState(3)
    x = 2.5e7 + rng.rand(4000)
    y = 3.0 * x + rng.rand(4000)
    got = ridge.ridge_solve(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x"], "y", 1.0)
    dx, dy = x - x.mean(), y - y.mean()
    assert np.isclose(got[0], dx @ dy / (dx @ dx + 1.0), rtol=1e-8)


def test_ridge_out_of_fold_in_one_plan(planted):
    """The rows are read once, and the predictions are those of fold by fold fits."""
    folded, cols = splits.contiguous_folds(planted, ["id"], 3), ["x1", "x2"]
    got = {r["id"]: r["p"] for r in RidgeModel().predict_out_of_fold(folded, 3, cols, "y", ["id"], "p").collect()}
    assert "Union" not in RidgeModel().predict_out_of_fold(folded, 3, cols, "y", ["id"], "p")._jdf.queryExecution().toString()
    for i in range(3):
        m = RidgeModel().fit(folded.where(F.col("fold") != i), cols, "y", ["id"])
        assert all(np.isclose(got[r["id"]], r["q"]) for r in m.predict(folded.where(F.col("fold") == i), "q").collect())


def test_columns_of_any_name_pass(spark):
    df = spark.range(20).select("id", *[F.lit(7).alias(c) for c in ("rank", "_bucket", "_count", "_g", "stratum", "_m", "_x", "hash")], (F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("y"))
    for out, more in ((splits.kfold(df, ["id"], 4, 1), ["fold"]), (splits.grouped_kfold(df, "g", 2, 1), ["fold"]), (splits.contiguous_folds(df, ["id"], 4), ["fold"]), (splits.sanctified(df, ["id"], 0.3, 1, stratify="g"), ["split"]), (splits.temporal_split(df, ["id"], 0.3), ["split"])):
        assert out.columns == [*df.columns, *more] and out.count() == 20 and out.select("rank", "_bucket", "_g", "stratum").distinct().count() == 1


def test_ensembles_without_models(planted):
    cols = ["x1", "x2"]
    nets, stats = ensembles.fit_ensemble(planted.repartition(3), cols, "y", ["id"], (3,), 20, [1, 2])
    assert len(nets) == 2 and stats["x1"][1] > 0
    got = [r["pred"] for r in ensembles.predict_ensemble(planted, cols, nets, stats).orderBy("id").collect()]
    scaled = preprocess.normalize(planted, stats)
    one = [[r["pred"] for r in ensembles.predict_nl(scaled, cols, n).orderBy("id").collect()] for n in nets]
    assert got == pytest.approx(np.mean(one, axis=0))
    again = ensembles.train_nl(scaled, cols, "y", ["id"], (3,), 20, 2)
    assert all(np.allclose(a, b) for a, b in zip(again, nets[1]))
    with pytest.raises(DataError):
        ensembles.train_nl(planted.limit(0), cols, "y", ["id"], (3,), 5, 1)


def test_iter_folds(spark):
    members = splits.membership(splits.kfold(spark.range(13), ["id"], 3), ["id"], 3)
    folds = list(splits.iter_folds(members))
    assert [f.fold for f in folds] == [0, 1, 2] and folds[0].n_folds == 3
    assert sorted(r["id"] for f in folds for r in f.test.collect()) == list(range(13))
    assert all(f.train.join(f.test, "id").isEmpty() and f.train.count() + f.test.count() == 13 for f in folds)


def test_public_names_and_example(spark, tmp_path, monkeypatch, capsys):
    from examples import shipments_walkthrough
    from holdfast import api

    assert {"ValidatedDataset", "iter_folds", "fit_ensemble", "Research", "HierarchicalRidge"} <= set(api.__all__)
    monkeypatch.chdir(tmp_path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        recaps = shipments_walkthrough.main(["--quick", "--exp", "plain"])
    assert recaps["plain"]["sanctified"]["n"] > 0 and "sanctified MAE" in capsys.readouterr().out


def test_compound_models(planted):
    cols, ids = ["x1", "x2"], ["id"]
    one = EnsembleModel(RidgeModel(), 2).fit(planted, cols, "y", ids)
    assert one.score(planted, "y") > 0.95
    with pytest.raises(ValueError):
        EnsembleModel()
    stacked = StackedModel(RidgeModel(), RidgeModel(), oof_folds=2).fit(planted, cols, "y", ids)
    assert stacked.score(planted, "y") > 0.95
    with pytest.raises(ValueError):
        StackedModel(RidgeModel(), RidgeModel(), augment=True).fit(planted, cols, "y", ids)
    lost = RoutedModel(None, {"a": RidgeModel()}, lambda df, p: F.when(F.col("x1") < 0.5, "a").otherwise("b")).fit(planted, cols, "y", ids)
    assert {r["pred"] for r in lost.predict(planted.where("x1 >= 0.5")).collect()} == {0.0}
    assert sum(r["n"] for r in lost.routing_distribution(planted).collect()) == 400
    bins = (BinConfig("low", RidgeModel(), (0, 6)), BinConfig("high", RidgeModel(), (5, 9)))
    cascade = build_cascade(CascadeConfig(RidgeModel(), (5.5,), bins, epochs=5)).fit(planted, cols, "y", ids)
    assert cascade.score(planted, "y") > 0.95


def test_validation_and_one_shot(spark, planted, copies, tmp_path):
    with pytest.raises(DataError, match="duplicate"):
        ValidatedDataset.validate(copies, XY)
    with pytest.raises(TypeError):
        ValidatedDataset(object(), copies, XY)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        data = SanctifiedDataset((planted, PLANTED), seed=1, ledger=str(tmp_path / "ledger"))
        with pytest.raises(HoldoutError):
            data.sanctified
        n = data.n_sanctified
        assert data.final_evaluate(lambda held: (held.count(), data.sanctified.count())) == (n, n)
        assert data.n_sanctified == 0
        for read in (lambda: data.sanctified, data.final_evaluate):
            with pytest.raises(HoldoutError):
                read()
        other = SanctifiedDataset((planted, PLANTED), seed=1, ledger=str(tmp_path / "ledger"))
        with pytest.raises(HoldoutError, match="another run"):
            other.final_evaluate()


def test_experiment_never_sees_the_holdout(planted):
    def dev(df):
        data = SanctifiedDataset((df, PLANTED), stratify=False, skip_validation=True)
        x = Experiment(data, ExperimentConfig(k=3, brackets=((0, 5), (5, 9))))
        result = x.run(RidgeModel, verbose=False)
        with pytest.raises(HoldoutError):
            next(x.folds())
        return result, data

    result, data = dev(planted)
    assert result.recap["dev"]["r2"]["mean"] > 0.95 and result.recap["sanctified"]["r2"] > 0.95
    held = [r["id"] for r in result.final.select("id").collect()]
    poisoned = planted.withColumn("y", F.when(F.col("id").isin(held), 1e30).otherwise(F.col("y")))
    assert dev(poisoned)[0].recap["dev"] == result.recap["dev"]
    fold = next(Experiment(SanctifiedDataset((planted, PLANTED), skip_validation=True)).folds(2))
    with pytest.raises(DataError):
        fold.record(fold.test.limit(3).withColumn("pred", F.lit(0.0)))


def test_pipeline(planted):
    class Square(Step):
        def execute(self, train, y, features, val=None):
            add = lambda df: None if df is None else df.withColumn("sq", F.col("x1") ** 2)
            return {"train": add(train), "val": add(val), "features": [*features, "sq"], "meta": {"history": [1]}}

    register_step_type("square", Square)
    p = Pipeline().add("normalize").add(Square())
    assert p.run(planted, "y", ["x1", "x2"]).names == ["x1", "x2", "sq"] and p.run(planted, "y", ["x1", "x2"]).history == [1]
    with pytest.raises(ValueError):
        p.fit(planted, "y", ["x1", "x2"], ["id"])
    p.set_model(RidgeModel()).fit(planted.where("id < 300"), "y", ["x1", "x2"], ["id"], planted.where("id >= 300"))
    assert metrics.scores(p.predict()).first()["r2"] > 0.95
    with pytest.raises(ValueError):
        p.predict(planted)
    with pytest.raises(ValueError):
        p.add("nothing")
    with pytest.raises(TypeError):
        p.add(Square(), x=1)
    assert p.analyze()["steps"][1]["type"] == "Square"


def test_research(spark, planted, tmp_path, capsys):
    def loader(data_dir, config):
        return load_dataset(planted, PLANTED, config)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        lab = Research(spark, "demo", loader, ExperimentConfig(k=3, dedup="average"), quick_k=2, save_dir=str(tmp_path), notes_path=str(tmp_path / "notes.md"))
        seen = []
        first = lab.new_experiment("plain", lambda ctx: RidgeModel(), after=lambda model, held, ctx: seen.append(held.rows.count()))
        lab.new_experiment("strong", lambda ctx: RidgeModel(100.0))
        with pytest.raises(ValueError):
            lab.new_experiment("plain", lambda ctx: RidgeModel())
        lab.add_argument("--depth", type=int, default=2)
        lab.main(["--quick", "--depth", "3"])
        lab.rerun(first)
        assert len(seen) == 2 and lab._extra == {"depth": 3}
    runs = lab.runs()
    assert len(runs) == 2 and len(runs.quick()) == 1 and len(runs.last(0)) == 0 and len(runs.experiment("strong")) == 1
    assert runs.best(experiment="plain") is not None and runs.latest()["experiments"].keys() == {"plain"}
    assert {r["experiment"]: r["n_runs"] for r in runs.compare().collect()} == {"plain": 2, "strong": 1}
    assert runs.table().count() == 2
    snap = lab.load_snapshot("plain")
    again = snap["model"].predict(snap["sanctified"].drop("pred"))
    assert snap["sanctified"].select("id", F.round("pred", 6)).exceptAll(again.select("id", F.round("pred", 6))).isEmpty()
    assert snap["oof"].count() and snap["learned"]["weights"].keys() == {"x1", "x2"}
    with pytest.raises(FileNotFoundError):
        lab.load_snapshot("none")
    with pytest.raises(KeyError):
        lab.experiment("none")
    lab.note("a first look")
    assert "| plain |" in lab.notes.read()
