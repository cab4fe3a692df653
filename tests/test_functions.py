"""Element-wise functions against NumPy, expression strings, dates."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import dates
from quern.functions.elementwise import BINARY, FREE_REDUCE, UNARY, combine_tables, map_columns, reduce_columns, zip_columns
from quern.functions.expressions import translate

VALUES = [-2.5, -1.0, -0.5, 0.0, 0.3, 0.5, 1.0, 1.5, 2.5, math.nan, math.inf, -math.inf]
OTHERS = [-2.0, -0.5, 0.0, 0.5, 3.0, math.nan]
SPECIAL = {"bitwise_not", "invert", "frexp", "modf", "isnat"}
INTEGER = {"bitwise_and", "bitwise_or", "bitwise_xor", "gcd", "lcm", "left_shift", "right_shift"}


def same(got, want):
    if isinstance(want, bool | np.bool_):
        return bool(got) == bool(want)
    if got is None:
        return False
    return (math.isnan(got) and math.isnan(want)) or got == want or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


def test_inventory():
    assert len(UNARY) == 50 and len(BINARY) == 40


def test_unary(spark):
    names = [n for n in UNARY if n not in SPECIAL]
    df = spark.createDataFrame([(v,) for v in VALUES], "a double").coalesce(1)
    rows = df.select("a", *(UNARY[n](F.col("a")).alias(n) for n in names)).collect()
    with np.errstate(all="ignore"):
        for n in names:
            f = getattr(np, "absolute" if n == "abs" else n)
            for v, r in zip(VALUES, rows, strict=True):
                assert same(r[n], f(np.float64(v))), (n, v, r[n], f(np.float64(v)))


def test_unary_special(spark):
    df = spark.createDataFrame([(5, 2.75, None), (-8, -2.75, datetime.datetime(2020, 1, 1))], "i long, x double, t timestamp_ntz").coalesce(1)
    got = df.select(*(UNARY[n](F.col(c)).alias(n) for n, c in (("bitwise_not", "i"), ("invert", "i"), ("frexp", "x"), ("modf", "x"), ("isnat", "t")))).collect()
    assert [r["bitwise_not"] for r in got] == [~5, 7] == [r["invert"] for r in got]
    assert [tuple(r["frexp"]) for r in got] == [math.frexp(2.75), math.frexp(-2.75)]
    assert [tuple(r["modf"]) for r in got] == [math.modf(2.75), math.modf(-2.75)]
    assert [r["isnat"] for r in got] == [True, False]


def test_binary(spark):
    names = [n for n in BINARY if n not in INTEGER | {"divmod", "ldexp"}]
    pairs = [(a, b) for a in VALUES for b in OTHERS]
    df = spark.createDataFrame(pairs, "a double, b double").coalesce(1)
    rows = df.select(*(BINARY[n](F.col("a"), F.col("b")).alias(n) for n in names)).collect()
    with np.errstate(all="ignore"):
        for n in names:
            for (a, b), r in zip(pairs, rows, strict=True):
                if n in ("power", "float_power") and a == -math.inf or n == "copysign" and math.isnan(b) or n in ("hypot", "logaddexp", "logaddexp2") and math.inf in (abs(a), abs(b)):
                    continue
                want = getattr(np, n)(np.float64(a), np.float64(b))
                assert same(r[n], want), (n, a, b, r[n], want)


def test_integer_binary(spark):
    pairs = [(a, b) for a in (0, 1, 5, 12, -7) for b in range(4)]
    df = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    rows = df.select(*(BINARY[n](F.col("a"), F.col("b")).alias(n) for n in INTEGER)).collect()
    for n in INTEGER:
        for (a, b), r in zip(pairs, rows, strict=True):
            assert r[n] == getattr(np, n)(a, b), (n, a, b)


def test_two_part_results(spark):
    r = spark.createDataFrame([(7.0, -2.0)], "a double, b double").select(BINARY["divmod"](F.col("a"), F.col("b")).alias("d"), BINARY["ldexp"](F.col("a"), F.lit(3)).alias("l")).first()
    assert tuple(r["d"]) == tuple(np.divmod(7.0, -2.0)) and r["l"] == 56


@pytest.mark.parametrize("name", [n for n in BINARY if n not in {"divmod", "gcd", "lcm", "left_shift", "right_shift", "nextafter"}])
def test_reduce(spark, name):
    values = [3, 1, 2, 5]
    kind = "long" if name in INTEGER else "double"
    df = spark.createDataFrame([(i, int(v) if kind == "long" else float(v)) for i, v in enumerate(values)], f"_rid long, x {kind}")
    got = reduce_columns(df, name, ["x"], order="_rid").first()[0]
    if name in FREE_REDUCE or name in ("logaddexp", "logaddexp2"):
        want = getattr(np, name).reduce(np.array(values, int if kind == "long" else float))
    else:
        want = float(values[0])
        for v in values[1:]:
            want = want * 2.0**v if name == "ldexp" else float(getattr(np, name)(want, float(v)))
    assert same(float(got), float(want)), (got, want)


def test_integer_folds(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([12, 18, 30])], "_rid long, x long")
    assert reduce_columns(df, "gcd", ["x"]).first()[0] == 6 and reduce_columns(df, "lcm", ["x"]).first()[0] == 180
    with pytest.raises(ValueError):
        reduce_columns(df, "subtract", ["x"])


def test_tables(spark):
    a = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "_rid long, x double, y double")
    b = spark.createDataFrame([(1, 10.0, 20.0), (2, 5.0, 5.0)], "_rid long, u double, v double")
    assert [tuple(r) for r in combine_tables(a, b, "add").collect()] == [(1, 13.0, 24.0)]
    assert [tuple(r) for r in combine_tables(a, {"x": 2.0, "y": 3.0}, "multiply").orderBy("_rid").collect()] == [(0, 2.0, 6.0), (1, 6.0, 12.0)]
    assert [tuple(r) for r in zip_columns(a, "subtract", ["x"], ["y"], ["d"]).collect()] == [(-1.0,), (-1.0,)]
    assert [r["x"] for r in map_columns(a, "square", ["x"]).orderBy("_rid").collect()] == [1.0, 9.0]


@pytest.mark.parametrize("text", ["a + 2 * b ** 2", "where(a > 1, a, -b)", "(a > 0) & ~(b > 1)", "a // 2 + a % 2", "sqrt(abs(a)) / 2", "0 < a < 2", "not (a > 1) or b == 0.5", "arctan2(a, b)"])
def test_expressions(spark, text):
    rows = [(1.5, 0.5), (-2.0, 3.0), (0.5, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").coalesce(1).select(translate(text)[1]).collect()]
    for (a, b), g in zip(rows, got, strict=True):
        scope = {"a": a, "b": b, "where": lambda c, x, y: x if c else y, "sqrt": np.sqrt, "abs": abs, "arctan2": np.arctan2}
        assert same(g, eval(text.replace("~", "1 - "), scope)), text


def test_expression_errors():
    for text in ("a; b", "import os", "f(a)", "a[0]", "lambda: 1"):
        with pytest.raises(SyntaxError):
            translate(text, lambda n: n)


def test_dates(spark):
    r = spark.createDataFrame([(datetime.datetime(2024, 3, 9, 5, 6, 7),)], "t timestamp_ntz").select(dates.week_day_int("t"), dates.year_day_int("t"), dates.week_day("t"), dates.ymd_string("t"), dates.is_weekend("t"), dates.masked("t", "YMD", keepdims=True), dates.as_vector("t"), dates.masked("t", "YMDhms")).first()
    assert tuple(r)[:5] == (5, 69, "Saturday", "2024-3-9", True)
    assert tuple(r[5]) == (2024, 3, 9, 0, 0, 0) and r[6] == [2024, 3, 9, 5, 6, 7] and tuple(r[7]) == (2024, 3, 9, 5, 6, 7)
    with pytest.raises(ValueError):
        dates.masked("t", "YX")


EDGES = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 2.5, -2.5, 1e300, -1e300, 1.0, -1.0]


def alike(got, want):
    return (np.isnan(got) and np.isnan(want)) or (got == want and np.signbit(got) == np.signbit(want)) or np.isclose(got, want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("name", ["ceil", "floor", "trunc", "signbit", "reciprocal", "isinf", "negative"])
def test_unary_at_edges(spark, name):
    rows = spark.createDataFrame([(v,) for v in EDGES], "a double").coalesce(1).select("a", UNARY[name](F.col("a")).alias("v")).collect()
    with np.errstate(all="ignore"):
        assert all(alike(float(r["v"]), float(getattr(np, name)(r["a"]))) for r in rows)


@pytest.mark.parametrize("name", ["divide", "true_divide", "floor_divide", "copysign", "power", "float_power", "arctan2"])
def test_binary_at_edges(spark, name):
    rows = spark.createDataFrame([(a, b) for a in EDGES for b in EDGES], "a double, b double").coalesce(1).select("a", "b", BINARY[name](F.col("a"), F.col("b")).alias("v")).collect()
    with np.errstate(all="ignore"):
        bad = [(r["a"], r["b"], r["v"], getattr(np, name)(r["a"], r["b"])) for r in rows if not alike(float(r["v"]), float(getattr(np, name)(r["a"], r["b"])))]
    assert not bad


def test_parts_at_edges(spark):
    rows = spark.createDataFrame([(v,) for v in EDGES], "a double").coalesce(1).select("a", UNARY["modf"](F.col("a")).alias("v")).collect()
    assert all(alike(r["v"]["fraction"], np.modf(r["a"])[0]) and alike(r["v"]["whole"], np.modf(r["a"])[1]) for r in rows)
    rows = spark.createDataFrame([(0.0, 2000.0), (1e-300, 2000.0), (1.5, -3.0), (float("inf"), 2.0)], "a double, b double").coalesce(1).select("a", "b", BINARY["ldexp"](F.col("a"), F.col("b")).alias("v")).collect()
    assert all(alike(r["v"], np.ldexp(r["a"], int(r["b"]))) for r in rows)
