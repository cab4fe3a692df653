"""Computed columns, composed views, archives, surviving extrema."""

import lzma
import zipfile

import numpy as np
from pyspark.sql import functions as F

from quern.operators.computed import UNCHANGED, Computed, if_else
from quern.plans import visual
from quern.sources import readers
from quern.streaming import progressive


def test_computed(spark):
    df = spark.createDataFrame([(0, -4.0, 2), (1, 9.0, 3)], "_rid long, x double, n int").coalesce(1)
    c = Computed().add_function("root", np.sqrt, "x").add_function("sum", "add", ["x", "n"]).add_function("up", F.ceil, "x")
    c.add_function("slow", lambda x, n: x * n, ["x", "n"], "double").add_function("clip", if_else("<", 0, 0.0, UNCHANGED), "x").add_expression("e", "x * 2 + n", "int")
    r = c.repeat(df).collect()
    assert np.isnan(r[0]["root"]) and r[1]["root"] == 3.0
    assert [(x["sum"], x["up"], x["slow"], x["clip"], x["e"]) for x in r] == [(-2.0, -4, -8.0, 0.0, -6), (12.0, 9, 27.0, 9.0, 21)]


def test_views(spark):
    df = spark.range(500).select(F.col("id").alias("_rid"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit("s").alias("s"))
    cells, points = visual.scatter_plot({"one": (df, "a", "b"), "two": (df.filter("a > 25"), "a", "b")}, bins=8, points=10, ranges=((0, 40), (0, 5)))
    assert points.groupBy("class").count().collect()[0]["count"] == 10 and cells.select("class").distinct().count() == 2
    assert visual.histogram_pattern(df, "a", 10, 20)["histogram"].agg(F.sum("n")).first()[0] == 100
    assert visual.histogram_2d_pattern(df, "a", "b")["extent"].count() == 2
    m = visual.statistics_matrix(df, {"a": ["min", "var", "hist"], "s": ["hide"], "b": ["max"]})
    assert set(m) == {"profile", "hist_a"} and m["profile"].count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "1,x\n2,y\n")
        z.writestr("b.csv", "3,z\n")
    with lzma.open(tmp_path / "c.xz", "wt") as f:
        f.write("4,w\n")
    df = readers.read_csv_archived(spark, [str(tmp_path / "a.zip"), str(tmp_path / "c.xz")], "i int, s string")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_extremum(spark):
    schema = "_rid long, _op string, x double"
    table = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 3.0)], "_rid long, x double")
    m = progressive.Extremum("x")
    assert m.changed(spark.createDataFrame([(0, "C", 1.0)], schema), table) == (5.0, 1)
    assert m.changed(spark.createDataFrame([(0, "D", None), (2, "U", 4.0)], schema), table) == (5.0, 1)
    assert m.changed(spark.createDataFrame([(3, "C", 7.0)], schema), table) == (7.0, 3)
    assert m.changed(spark.createDataFrame([(3, "D", None)], schema), table) == (5.0, 1)
