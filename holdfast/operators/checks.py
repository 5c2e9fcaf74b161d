"""Checks of a dataset: degenerate columns, near duplicates, label conflicts, entity fingerprints, split audits."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import nan_to_null
from holdfast.operators.dedup import duplicate_pairs
from holdfast.operators.ranks import hash_ranked
from holdfast.spec import DataError, DatasetSpec

#: Centroids of a block that test rows are compared with.
CENTROIDS = 256
#: Ids in a list of rows with equal features.
MEMBERS = 256


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, n, low, high, status) in one pass; status: all_nan, zero_variance or ok. NaN counts as missing."""
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n_{c}"), F.min(x).alias(f"low_{c}"), F.max(x).alias(f"high_{c}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in columns])
    status = F.when(F.col("n") == 0, "all_nan").when(F.col("low") == F.col("high"), "zero_variance").otherwise("ok")
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("status", status)


def check_degenerate_columns(df: DataFrame, columns: Sequence[str]) -> None:
    found = column_profile(df, columns).collect()
    for status in ("all_nan", "zero_variance"):
        if bad := [r["column"] for r in found if r["status"] == status]:
            raise DataError(f"{status} columns: {bad}")


def check_exact_duplicates(df: DataFrame, spec: DatasetSpec, bits: bool = True) -> None:
    pairs = duplicate_pairs(df, spec, bits)
    n = pairs.count()
    if n:
        shown = [tuple(r) for r in pairs.orderBy(*pairs.columns).limit(5).collect()]
        raise DataError(f"{n} duplicate rows: {shown}" + (f" and {n - 5} more" if n > 5 else ""))


def _directions(d: int) -> list[list[float]]:
    """One fixed unit vector, or two at right angles if d is over 1."""
    roots = [math.sqrt(p) % 1 + 0.5 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)]
    u = [roots[i % 16] * (1 + i // 16) for i in range(d)]
    norm = math.sqrt(sum(w * w for w in u))
    out = [[w / norm for w in u]]
    if d > 1:
        v = [roots[(5 * i + 3) % 16] * (-1) ** i for i in range(d)]
        along = sum(p * q for p, q in zip(out[0], v))
        v = [q - along * p for p, q in zip(out[0], v)]
        norm = math.sqrt(sum(w * w for w in v))
        out.append([w / norm for w in v])
    return out


def _near(df: DataFrame, spec: DatasetSpec, tol: float, y: str | None = None, differ: bool = False) -> DataFrame:
    """Rows (id_a, id_b, distance) or, with y, (id_a, id_b, distance, y_a, y_b). differ: only pairs whose y differ."""
    d = len(spec.features)
    xs = [F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(spec.features)]
    keys = [f"x{i}" for i in range(d)] + (["y"] if y else [])
    rows = df.select(F.struct(*spec.id_cols).alias("id"), *xs, *([F.col(y).alias("y")] if y else []))
    points = rows.groupBy(*keys).agg(F.collect_list("id").alias("ids"))
    part = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MEMBERS).cast("int")), lambda i: F.slice("ids", i * MEMBERS + 1, MEMBERS))
    points = points.select(*keys, F.posexplode(part).alias("part", "ids"))
    width = tol * 1.01 if tol > 0 else 1e-12
    cell = lambda u: F.floor(F.greatest(F.least(sum(F.col(f"x{i}") * w for i, w in enumerate(u)) / width, F.lit(4e18)), F.lit(-4e18)))  # noqa: E731  within a long
    cells = [cell(u) for u in _directions(d)]
    near = [(0,), (1,)] if d == 1 else [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # one of two opposite neighbours, so no pair comes twice
    visits = F.explode(F.array(*[F.struct(*[(c + step).alias(f"c{j}") for j, (c, step) in enumerate(zip(cells, steps))], F.lit(i == 0).alias("own")) for i, steps in enumerate(near)]))
    me = F.struct(*keys, "part")
    side = lambda s: [me.alias(f"p{s}"), F.col("ids").alias(f"ids{s}"), *[F.col(f"x{i}").alias(f"x{i}{s}") for i in range(d)], *([F.col("y").alias(f"y{s}")] if y else [])]
    a = points.select(*side("a"), visits.alias("v")).select("*", "v.*").drop("v")
    b = points.select(*side("b"), *[c.alias(f"c{j}") for j, c in enumerate(cells)])
    far = F.sqrt(sum((F.col(f"x{i}a") - F.col(f"x{i}b")) * (F.col(f"x{i}a") - F.col(f"x{i}b")) for i in range(d)))
    met = a.join(b, [f"c{j}" for j in range(len(cells))]).where((~F.col("own")) | (F.col("pa") <= F.col("pb"))).withColumn("distance", far).where(F.col("distance") <= tol)
    if differ:
        met = met.where(_differ(df, y, "ya", "yb"))
    told = ["ya", "yb"] if y else []
    met = met.select("idsa", "idsb", "distance", (F.col("own") & (F.col("pa") == F.col("pb"))).alias("same"), *told)
    met = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few of them may hold most of the pairs
    each = met.select("*", F.posexplode("idsa").alias("ia", "ida")).drop("idsa").select("*", F.posexplode("idsb").alias("ib", "idb")).drop("idsb")
    each = each.where((~F.col("same") | (F.col("ia") < F.col("ib"))) & (F.col("ida") != F.col("idb")))
    first = F.col("ida") < F.col("idb")
    turned = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
    ends = [turned("ida", "idb", "id_a"), turned("idb", "ida", "id_b"), F.col("distance")]
    return each.select(*ends, *([turned("ya", "yb", "y_a"), turned("yb", "ya", "y_b")] if y else []))


def near_duplicate_pairs(df: DataFrame, spec: DatasetSpec, tol: float = 1e-8) -> DataFrame:
    """Rows (id_a, id_b, distance) of rows within L2 distance tol, the smaller id first. Missing values count as 0.

    Rows with equal features are one point, in lists of MEMBERS ids at most. Points are projected on one or two fixed unit
    vectors at right angles, which never lengthens a distance: a pair within tol lies in one cell of width just over tol or
    in two that touch. Lists whose points are near are dealt evenly before their ids are paired, so the work grows with the
    points and with the pairs that come out, which equal rows alone make quadratic.
    """
    return _near(df, spec, tol)


def near_label_conflicts(df: DataFrame, spec: DatasetSpec, tol: float = 1e-8) -> DataFrame:
    """label_conflicts() of near_duplicate_pairs(), rows (id_a, id_b, distance, y_a, y_b). Targets stay with the points, so pairs
    aren't joined with the rows, and those of equal targets aren't made."""
    return _near(df, spec, tol, spec.target, differ=True)


def _differ(df: DataFrame, target: str, a: str, b: str) -> Column:
    """Missing differs from everything, itself included."""
    missing = F.col(a).isNull() | F.col(b).isNull()
    if df.schema[target].dataType.typeName() in ("double", "float"):
        missing = missing | F.isnan(a) | F.isnan(b)
    return missing | (F.col(a) != F.col(b))


def label_conflicts(pairs: DataFrame, df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Of near-duplicate pairs, those whose targets differ; missing differs from everything, itself included."""
    y = df.select(F.struct(*spec.id_cols).alias("id"), F.col(spec.target).alias("y"))
    both = pairs.join(y.withColumnsRenamed({"id": "id_a", "y": "y_a"}), "id_a").join(y.withColumnsRenamed({"id": "id_b", "y": "y_b"}), "id_b")
    return both.where(_differ(df, spec.target, "y_a", "y_b"))


def warn_pairs(pairs: DataFrame, what: str) -> int:
    n = pairs.count()
    if n:
        warnings.warn(f"{n} {what}, such as {[(tuple(r[0]), tuple(r[1])) for r in pairs.orderBy('id_a', 'id_b').limit(5).collect()]}", stacklevel=2)
    return n


def fingerprint_check(df: DataFrame, spec: DatasetSpec, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """One row (n_groups, n_test, accuracy, chance, ratio, risk): how well the nearest centroid tells a row's group.

    Within a group of at least two rows, max(1, floor(m * test_fraction)) rows are held out by hash order. Features are
    scaled by the training rows (a deviation of 0 becomes 1; missing is 0 after centring). Ties go to the smaller group.
    Risk: skip with under 3 groups, 3 test rows or 2 centroids; else low under a ratio of 3, medium under 10, high. A test
    row meets blocks of about CENTROIDS centroids, and its nearest one is a minimum over the blocks; a single block is
    broadcast, of more Spark chooses how to bring them to the rows.
    """
    g = spec.group
    rows = df.where(F.col(g).isNotNull()).select(*spec.id_cols, F.col(g).alias("g"), *[nan_to_null(F.col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(spec.features)])
    d = len(spec.features)
    sizes = rows.groupBy("g").agg(F.count("*").alias("m"))
    ranked = hash_ranked(rows, spec.id_cols, seed, "r", ["g"]).join(sizes, "g")
    ranked = ranked.withColumn("test", (F.col("m") > 1) & (F.col("r") < F.greatest(F.lit(1), F.floor(F.col("m") * F.lit(float(test_fraction))))))
    train, test = ranked.where("not test"), ranked.where("test")
    stats = train.agg(*[F.avg(f"f{i}").alias(f"a{i}") for i in range(d)], *[F.stddev_pop(f"f{i}").alias(f"s{i}") for i in range(d)])
    z = [F.coalesce((F.col(f"f{i}") - F.col(f"a{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")), F.lit(0.0)).alias(f"z{i}") for i in range(d)]
    scaled = lambda x: x.crossJoin(F.broadcast(stats)).select(*spec.id_cols, "g", *z)  # noqa: E731  one row of statistics
    centroids = scaled(train).groupBy(F.col("g").alias("c")).agg(F.array(*[F.avg(f"z{i}") for i in range(d)]).alias("centre"))
    parts = -(-sizes.count() // CENTROIDS) or 1
    blocks = centroids.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(parts))).groupBy("b").agg(F.collect_list(F.struct("c", "centre")).alias("all"))
    at = F.array(*[F.col(f"z{i}") for i in range(d)])
    far = F.transform("all", lambda e: F.struct(F.aggregate(F.zip_with(e["centre"], at, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v).alias("far"), e["c"].alias("c")))
    met = scaled(test).crossJoin(F.broadcast(blocks) if parts == 1 else blocks).select(*spec.id_cols, "g", F.array_min(far).alias("best"))
    hit = met.groupBy(*spec.id_cols).agg(F.first("g").alias("g"), F.min("best")["c"].alias("guess"))
    scored = hit.agg(F.count("*").alias("n_test"), F.avg((F.col("guess") == F.col("g")).cast("double")).alias("accuracy"))
    out = scored.crossJoin(sizes.agg(F.count("*").alias("n_groups"))).crossJoin(centroids.agg(F.count("*").alias("n_centroids")))  # one row each
    skip = (F.col("n_groups") < 3) | (F.col("n_test") < 3) | (F.col("n_centroids") < 2)
    ratio = F.col("accuracy") * F.col("n_groups")
    risk = F.when(skip, "skip").when(ratio < 3, "low").when(ratio < 10, "medium").otherwise("high")
    return out.select("n_groups", F.when(F.col("n_groups") < 3, F.lit(0)).otherwise(F.col("n_test")).alias("n_test"), F.when(~skip, F.col("accuracy")).alias("accuracy"), F.when(~skip, F.try_divide(F.lit(1.0), F.col("n_groups"))).alias("chance"), F.when(~skip, ratio).alias("ratio"), risk.alias("risk"))


def audit_split(membership: DataFrame, df: DataFrame | None = None, id_cols: Sequence[str] = ("id",), group: str | None = None) -> DataFrame:
    """One row for each fold of a membership table (fold, *ids, role): rows of either role, repeated rows, rows in both roles,
    rows of df in neither, and groups on both sides. A sound split has 0 in all but the first two."""
    ids = list(id_cols)
    each = membership.groupBy("fold", *ids).agg(F.sum((F.col("role") == "train").cast("long")).alias("tr"), F.sum((F.col("role") == "test").cast("long")).alias("te"))
    out = each.groupBy("fold").agg(F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"), F.sum(F.greatest(F.col("tr") - 1, F.lit(0)) + F.greatest(F.col("te") - 1, F.lit(0))).alias("n_repeated"), F.sum(((F.col("tr") > 0) & (F.col("te") > 0)).cast("long")).alias("n_overlap"), F.count("*").alias("_seen"))
    if df is None:
        out = out.withColumn("n_missing", F.lit(0).cast("long"))
    else:
        total = df.select(*ids).distinct().agg(F.count("*").alias("_all"))
        out = out.crossJoin(F.broadcast(total)).withColumn("n_missing", F.col("_all") - F.col("_seen")).drop("_all")
    if group is not None:
        sides = membership.join(df.select(*ids, F.col(group).alias("_g")), ids).groupBy("fold", "_g").agg(F.count_distinct("role").alias("k"))
        out = out.join(sides.groupBy("fold").agg(F.sum((F.col("k") > 1).cast("long")).alias("n_group_overlap")), "fold")
    else:
        out = out.withColumn("n_group_overlap", F.lit(0).cast("long"))
    return out.drop("_seen")


def check_split(membership: DataFrame, df: DataFrame | None = None, id_cols: Sequence[str] = ("id",), group: str | None = None) -> None:
    for r in audit_split(membership, df, id_cols, group).collect():
        bad = {k: r[k] for k in ("n_repeated", "n_overlap", "n_missing", "n_group_overlap") if r[k]}
        if bad:
            raise DataError(f"fold {r['fold']}: {bad}")


def rare_classes(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Rows (y, only_in) of classes that one side lacks."""
    a, b = train.select(y).distinct(), test.select(y).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("train")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("test")))
