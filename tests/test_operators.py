"""Filters, joins, groups, statistics and linear operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import filters, groups, joins, linear, stats
from quern.operators.groups import Part

INF = math.inf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3, 5, 0])], "_rid long, x double")


@pytest.mark.parametrize(
    ("lower", "upper", "want"),
    [(1, 3, (1, 3)), (None, 3, (-INF, 3)), (math.nan, INF, (-INF, INF)), (-9, 3, (-INF, 3)), (10, 3, (-INF, 3)), (2, 99, (2, INF)), (2, 1, (2, INF)), (2, -1, (2, INF)), ("*", "*", (0, 10)), (10, 5, (-INF, 5))],
)
def test_bounds(lower, upper, want):
    assert filters.normalise_bounds(lower, upper, 0, 10) == want


def test_strict_bounds_are_empty(numbers):
    assert filters.range_query(numbers, "x", 3, 2, strict=True).count() == 0
    assert filters.range_query(numbers, "x", 3, 2).count() == 4
    assert filters.range_query(numbers.limit(0), "x", 1, 2).count() == 0


def test_range_reaches_the_scan(spark, tmp_path, numbers):
    numbers.write.parquet(str(tmp_path / "n"))
    plan = filters.range_query(spark.read.parquet(str(tmp_path / "n")), "x", 1, 3).select("x")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,1.0)" in plan and "LessThan(x,3.0)" in plan and "ReadSchema: struct<x:double>" in plan


def test_filters(spark, numbers):
    assert [r["_rid"] for r in filters.where(numbers, "(x > 1) & (x < 4)").orderBy("_rid").collect()] == [3, 4]
    assert filters.evaluate(numbers, "y = x * 2").columns == ["_rid", "x", "y"]
    assert filters.evaluate(numbers, "x == 5").count() == 2
    assert filters.compare(numbers, "x", "!=", 5).count() == 5
    two = numbers.withColumn("z", 5 - F.col("x"))
    last = spark.createDataFrame([(0, 9.0, 9.0), (1, 3.0, 3.0)], "_rid long, x double, z double")
    assert [filters.compare_last(two, last, ">", how).count() for how in ("and", "or", "xor")] == [0, 5, 5]
    assert filters.categories(numbers, "x", [5.0, 0.0]).count() == 3
    assert rows(filters.rows_at(numbers, slice(1, 3), ["x"])) == [(1, 1.0), (2, 4.0), (3, 2.0)]
    assert filters.rows_at(numbers, [0, 6]).count() == 2 and filters.rows_at(numbers, 2).count() == 1 and filters.rows_at(numbers, slice(0, 6, 2)).count() == 4
    origin, width = filters.bin_width(numbers, "x", 2.0)
    near = filters.approximate_range(numbers, "x", 1.0, 3.0, origin, width)
    assert {r["x"] for r in near.collect()} >= {1.0, 2.0}
    assert sum(r["n"] for r in filters.bins(numbers, "x", 2.0).collect()) == 7
    assert filters.bins_by_column(two, ["x", "z"], 2.0).count() == 6


def test_joins(spark):
    related = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 9, "c"), (3, None, "d")], "_rid long, fk long, v string")
    primary = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "pk long, v string")
    with pytest.raises(ValueError):
        joins.join(related, primary, primary_on="pk", related_on="fk")
    inner = joins.join(related, primary, primary_on="pk", related_on="fk", suffix="_p", check=True)
    assert rows(inner) == [(0, 1, "a", "one"), (1, 2, "b", "two")]
    outer = joins.join(related, primary, primary_on="pk", related_on="fk", suffix="_p", how="outer", fillna="-")
    assert [r["v_p"] for r in outer.orderBy("_rid").collect()] == ["one", "two", "-", "-"]
    assert rows(joins.primary_outer(related, primary, primary_on="pk", related_on="fk")) == [(3, "three")]
    with pytest.raises(ValueError):
        joins.unique_index(primary.unionAll(primary), "pk")
    with pytest.raises(ValueError):
        joins.join(related, primary, primary_on="pk", related_on="fk", how="cross")


def test_joins_by_id(spark):
    a = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, None)], "_rid long, x double")
    b = spark.createDataFrame([(1, 7.0), (2, 8.0), (3, 9.0)], "_rid long, x double")
    assert rows(joins.combine_first(a, b)) == [(0, 1.0), (1, 7.0), (2, 8.0), (3, 9.0)]
    assert joins.merge(a, b).columns == ["_rid", "x_x", "x_y"] and joins.merge(a, b).count() == 2
    assert joins.join_by_id(a, b, lsuffix="_l", rsuffix="_r", how="right").count() == 3
    with pytest.raises(ValueError):
        joins.join_by_id(a, b)
    ids = lambda df: [r[0] for r in df.select("_rid").orderBy("_rid").collect()]
    assert ids(joins.intersection(a, b)) == [1, 2] and ids(joins.union_ids(a, b)) == [0, 1, 2, 3]
    assert ids(joins.difference(a, b)) == [0] and ids(joins.symmetric_difference(a, b)) == [0, 3] and ids(joins.flip(a, 1, 5)) == [0, 3, 4]
    assert joins.append(a, b).count() == 6


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0, [1, 2, 3]), ("a", 3.0, [1, 2, 4]), ("b", 5.0, [1, 9, 9])], "k string, v double, d array<int>")
    got = rows(groups.aggregate(df, "k", [("v", "mean"), ("v", "variance"), ("", "count"), ("v", "uniq")]))
    assert got == [("a", 2.0, 1.0, 2, 2), ("b", 5.0, 0.0, 1, 1)]
    assert groups.aggregate(df, Part("d").ix[0:2], [("v", "sum")]).columns == ["d_ix", "v_sum"]
    assert groups.aggregate(df, [Part("d").ix[[0, 2]]], [("v", "sum")]).count() == 3
    assert groups.aggregate(df, "d", [("v", "sum")]).count() == 3
    groups.register("range", lambda c: F.max(c) - F.min(c))
    assert rows(groups.aggregate(df, "k", [("v", "range")])) == [("a", 2.0), ("b", 0.0)]
    constant = df.withColumn("one", F.lit(1.0))
    assert [r["value"] for r in groups.covariance_matrix(constant, ["v", "one"], "corr").filter("first <> second").collect()] == [0.0]


def test_statistics(spark, numbers):
    odd = spark.createDataFrame([(0, math.nan), (1, 2.0), (2, None), (3, -1.0), (4, 2.0)], "_rid long, x double")
    assert rows(stats.extrema(odd, ["x"])) == [(2.0,)] and rows(stats.extrema(odd, ["x"], "min")) == [(-1.0,)]
    assert rows(stats.index_of_extrema(odd, ["x"])) == [(1, 2.0)] and rows(stats.index_of_extrema(odd, ["x"], "min")) == [(3, -1.0)]
    assert rows(stats.min_max(numbers, "x")) == [(0.0, 5.0)]
    assert abs(stats.variance(numbers, ["x"]).first()[0] - np.var([5, 1, 4, 2, 3, 5, 0])) < 1e-12
    assert stats.variance(numbers.limit(0), ["x"]).first()[0] == 0
    assert stats.count(numbers).first()[0] == 7
    assert [r["x"] for r in stats.reducers(numbers, ["x"], ("any", "all", "min", "sum")).collect()] == [1.0, 0.0, 0.0, 20.0]
    assert stats.distinct(numbers, ["x"], 10).first()["x"] == ["0.0", "1.0", "2.0", "3.0", "4.0", "5.0"]
    assert stats.distinct(numbers, ["x"], 3).first()["x"] is None
    assert stats.sample(numbers, 3).count() == 3 and rows(stats.sample(numbers, 3)) == rows(stats.sample(numbers.repartition(3), 3))
    assert abs(stats.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-8 and abs(stats.t_quantile(0.95, 2) - 2.919985580353726) < 1e-8
    mean, half = stats.mean_interval(numbers, "x").first()
    assert mean == 20 / 7 and half > 0


def test_histograms(spark, numbers):
    values = np.random.default_rng(1).normal(size=500).round(2)
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double")
    lo, hi = stats.bounds(df, "x")
    assert [r["n"] for r in stats.histogram(df, "x", 16).orderBy("bin").collect()] == np.histogram(values, 16, (lo, hi))[0].tolist()
    edge = stats.histogram(df, "x", 8, extent=(float(values.min()), float(values.max()))).agg(F.sum("n")).first()[0]
    assert edge == 500
    cells = stats.histogram_2d(df, "x", "y", 4, 4)
    assert cells.agg(F.sum("n")).first()[0] == 500
    m = stats.histogram_matrix(cells, 4, 4)
    assert sum(map(sum, m)) == 500 and m[0][0] >= m[0][3]
    assert stats.histogram_2d_classes(df.withColumn("c", F.col("x") > 0), "x", "y", "c", xbins=2, ybins=2).agg(F.sum("n")).first()[0] == 500
    hot = stats.heat(cells).agg(F.min("heat"), F.max("heat")).first()
    assert tuple(hot) == (0, 65535)
    h = stats.histogram(df, "x", 16)
    assert tuple(stats.histogram_change(h, h).first()) == (0.0, 0.0)
    with pytest.raises(TypeError):
        stats.histogram_categorical(numbers, "x")
    assert stats.histogram(df.limit(0), "x").count() == 0


def test_quantiles_and_sketches(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    assert [r["x"] for r in stats.quantiles(df, ["x"], [0.25, 0.5]).collect()] == [2500.0, 5000.0]
    skewed = df.select(F.when(F.col("x") < 9000, F.lit(5.0)).otherwise(F.col("x") * F.col("x")).alias("x"))
    for q in (0.0, 0.013, 0.5, 0.9123, 1.0):
        for t in (df, skewed):
            want = stats.quantiles(t, ["x"], [q]).first()["x"]
            assert abs(stats.quantile_by_counting(t, "x", q, bins=16, few=50) - want) < 1e-6
    assert stats.quantile_by_counting(df.limit(0), "x", 0.5) is None
    s = stats.sketch(df, "x")
    assert abs(stats.sketch_quantiles(s, [0.5]).first()["value"] - 5000) < 300
    shares = [r["share"] for r in stats.sketch_pmf(s, [2500.0, 7500.0]).collect()]
    assert abs(sum(shares) - 1) < 1e-9 and abs(shares[1] - 0.5) < 0.05


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "a"), (None, None), (5.0, "b")], "x double, s string")
    assert [r["x"] for r in stats.imputed(df, {"x": "mean"}).collect()] == [1.0, 3.0, 3.0, 5.0]
    assert [r["s"] for r in stats.imputed(df, {"s": "most_frequent", "x": ("constant", 0.0)}).collect()] == ["a", "a", "a", "b"]
    scaled = stats.min_max_scaled(df.na.drop(), ["x"], {"x": (0.0, 4.0)})
    assert sorted(r["x"] for r in scaled.collect())[:1] == [0.25]
    assert stats.min_max_scaled(df.na.drop(), ["x"], {"x": (0.0, 4.0)}, "ignore").count() == 1
    assert stats.profile(df, ["s"], ("count", "distinct")).first()["distinct"] == 2
    assert stats.shape(df) == {"x": "double", "s": "string"}


def test_linear(spark):
    v = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "_rid long, a double, b double")
    m = spark.createDataFrame([(0, 1.0, 0.0, 2.0), (1, 0.0, 1.0, 3.0)], "_rid long, p double, q double, r double")
    assert rows(linear.linear_map(v, m)) == [(0, 1.0, 2.0, 8.0), (1, 3.0, 4.0, 18.0)]
    with pytest.raises(ValueError):
        linear.linear_map(v, m.limit(1))
    assert rows(linear.expressions({"f": v, "g": v}, {"s": "f.a + g.b"})) == [(0, 3.0), (1, 7.0)]
    assert rows(linear.functions({"f": v}, {"s": ("hypot", "f.a", "f.b")}))[0] == (0, math.hypot(1, 2))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ np.diag([5, 1, 0.1])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    _, parts, var = linear.principal_components(df, ["a", "b", "c"], 2)
    assert abs(parts[0][0]) > 0.99 and abs(var[0] - np.var(x[:, 0], ddof=1)) < 0.5
    assert linear.project(df, ["a", "b", "c"]).columns[-2:] == ["_pc1", "_pc2"]


def test_clusters_and_density(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, size=(60, 2)) for c in ([0, 0], [6, 6], [0, 6])])
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    out, centres = linear.k_means(df, ["a", "b"], 3, centres=[[1, 1], [5, 5], [1, 5]])
    assert sorted(r["count"] for r in out.groupBy("label").count().collect()) == [60, 60, 60]
    assert linear.inertia(df, ["a", "b"], centres) < 60 and linear.cluster_rows(out, 0).count() == 60
    at = spark.createDataFrame([(0.0, 0.0), (3.0, 3.0)], "a double, b double")
    d = {r["point"]: r["density"] for r in linear.kernel_density(df, at, ["a", "b"], k=20).collect()}
    near = np.sort(np.hypot(*x.T))[:20]
    assert abs(d[0] - np.exp(-0.5 * (near / 0.2) ** 2).sum() / (0.2 * math.sqrt(2 * math.pi) * 20)) < 1e-9 and d[0] > d[1]
    y = linear.tsne(x[::6], perplexity=5, steps=150)
    assert y.shape == (30, 2) and np.isfinite(y).all()
