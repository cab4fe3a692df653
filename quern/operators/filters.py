"""Row filters: expressions, comparisons, ranges, categories, id sets and binned indexes."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.expressions import translate

OPERATORS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def where(df: DataFrame, expression: str, ids: DataFrame | None = None, rid: str = "_rid") -> DataFrame:
    """Rows for which an expression string holds, among the rows of ``ids`` if given."""
    out = df.filter(translate(expression)[1])
    return out if ids is None else select_ids(out, ids, rid)


def evaluate(df: DataFrame, expression: str, name: str | None = None) -> DataFrame:
    """A conditional filters rows; an assignment adds or replaces a column."""
    target, column = translate(expression)
    if target or name:
        return df.withColumn(name or target, column)
    return df.filter(column)


def compare(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows whose column compares with a value."""
    return df.filter(OPERATORS[op](F.col(column), F.lit(value)))


def compare_last(df: DataFrame, cmp: DataFrame, op: str, combine: str = "and", order: str = "_rid") -> DataFrame:
    """Rows that compare with the last row of ``cmp`` in all (and), any (or) or an odd number (xor) of the shared columns."""
    shared = [c for c in df.columns if c in cmp.columns and c != order]
    last = cmp.agg(F.max_by(F.struct(*shared), order).alias("_last"))
    tests = [OPERATORS[op](F.col(c), F.col(f"_last.{c}")) for c in shared]
    out = tests[0]
    for t in tests[1:]:
        out = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[combine](out, t)
    return df.crossJoin(F.broadcast(last)).filter(out).drop("_last")


def categories(df: DataFrame, column: str, choice: Iterable | DataFrame) -> DataFrame:
    """Rows whose column is one of the chosen values (a list, or a table of one column)."""
    if isinstance(choice, DataFrame):
        one = choice.select(F.col(choice.columns[0]).alias("_choice"))
        return df.join(one, df[column] == one["_choice"], "left_semi")
    return df.filter(F.col(column).isin(*choice))


def normalise_bounds(lower: object, upper: object, least: float, most: float, strict: bool = False) -> tuple[float, float]:
    """Bounds as the range query reads them.

    Missing, NaN or infinite bounds, and bounds outside the data, are open; ``"*"`` is the
    least or the largest value.  An upper bound not above the lower one is open too,
    unless ``strict``, which makes the range empty.
    """
    lo, hi = (least if lower == "*" else lower), (most if upper == "*" else upper)
    if strict and all(isinstance(x, int | float) and math.isfinite(x) for x in (lo, hi)) and hi <= lo:
        return math.inf, -math.inf
    if lo is None or not math.isfinite(lo) or lo < least or lo >= most:
        lo = -math.inf
    if hi is None or not math.isfinite(hi) or hi > most or hi <= least or hi <= lo:
        hi = math.inf
    return lo, hi


def _between(column: str, lo: float, hi: float) -> Column:
    test = F.lit(True)
    if lo > -math.inf:
        test = test & (F.col(column) >= lo)
    return test & (F.col(column) < hi) if hi < math.inf else test


def range_query(df: DataFrame, column: str, lower: object = None, upper: object = None, strict: bool = False) -> DataFrame:
    """Rows with lower <= column < upper; the bounds reach the scan as pushed filters."""
    least, most = df.agg(F.min(column), F.max(column)).first() if needs_extent(lower, upper) else (-math.inf, math.inf)
    if least is None:
        return df.limit(0)
    return df.filter(_between(column, *normalise_bounds(lower, upper, least, most, strict)))


def needs_extent(lower: object, upper: object) -> bool:
    """Bounds are judged by the data unless both are open."""
    return not (lower is None and upper is None)


def range_query_2d(df: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple, strict: bool = False) -> DataFrame:
    """Rows within two half-open ranges."""
    return range_query(range_query(df, x, *x_range, strict=strict), y, *y_range, strict=strict)


def select_ids(df: DataFrame, ids: DataFrame, rid: str = "_rid") -> DataFrame:
    """Rows whose id is in a table of ids."""
    return df.join(ids.select(rid).distinct(), rid, "left_semi")


def rows_at(df: DataFrame, ids: int | slice | Iterable[int], columns: list[str] | None = None, rid: str = "_rid") -> DataFrame:
    """Rows by id, list of ids or slice (its end included), and some of the columns."""
    if isinstance(ids, slice):
        test = F.lit(True)
        if ids.start is not None:
            test = test & (F.col(rid) >= ids.start)
        if ids.stop is not None:
            test = test & (F.col(rid) <= ids.stop)
        if ids.step not in (None, 1):
            test = test & ((F.col(rid) - (ids.start or 0)) % ids.step == 0)
    else:
        test = F.col(rid).isin(*([ids] if isinstance(ids, int) else list(ids)))
    out = df.filter(test)
    return out.select(*dict.fromkeys([rid, *columns])) if columns else out


# Binned index: a derived column that clusters a table for range queries.


def bin_width(df: DataFrame, column: str, tolerance: float = -1) -> tuple[float, float]:
    """Origin and width of bins: the tolerance, or if negative that percentage of the 5-95 % extent."""
    low, q5, q95 = df.agg(F.min(column), F.percentile(column, F.lit(0.05)), F.percentile(column, F.lit(0.95))).first()
    if low is None:
        return 0.0, 1.0
    return float(low), float(tolerance if tolerance > 0 else (q95 - q5) * abs(tolerance) / 100 or 1.0)


def with_bin(df: DataFrame, column: str, origin: float, width: float, name: str = "bin") -> DataFrame:
    return df.withColumn(name, F.floor((F.col(column) - origin) / width))


def bins(df: DataFrame, column: str, tolerance: float = -1) -> DataFrame:
    """The index: rows, least and largest value of each bin."""
    origin, width = bin_width(df, column, tolerance)
    return with_bin(df.filter(F.col(column).isNotNull()), column, origin, width).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


def bins_by_column(df: DataFrame, columns: list[str], tolerance: float = -1) -> DataFrame:
    """One index for each column, told apart by ``column``."""
    out = None
    for c in columns:
        one = bins(df, c, tolerance).select(F.lit(c).alias("column"), "bin", "n", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
        out = one if out is None else out.unionAll(one)
    return out


def approximate_range(df: DataFrame, column: str, lower: float, upper: float, origin: float, width: float) -> DataFrame:
    """All rows of the bins that a range touches: a superset by two edge bins at most."""
    at = F.floor((F.col(column) - origin) / width)
    return df.filter((at >= math.floor((lower - origin) / width)) & (at <= math.floor((upper - origin) / width)))
