"""Data sides of composed views: scatter plots of several classes, profiles, histogram patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import filters, stats


def scatter_plot(classes: dict[str, tuple[DataFrame, str, str]], bins: int = 64, ranges: tuple | None = None, points: int = 100, key: str = "_rid") -> tuple[DataFrame, DataFrame]:
    """2-D histogram cells and sample points of several classes (table, x column, y column) over their joint extent.

    ``ranges``: ((x low, x high), (y low, y high)) limits all classes first.
    """
    both = None
    for name, (df, x, y) in classes.items():
        one = df.select(F.lit(name).alias("class"), F.col(key).alias(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        both = one if both is None else both.unionAll(one)
    if ranges:
        both = filters.range_query_2d(both, "x", "y", *ranges)
    cells = stats.histogram_2d_classes(both, "x", "y", "class", xbins=bins, ybins=bins)
    shown = None
    for name in classes:
        some = stats.sample(both.filter(F.col("class") == name), points, key=key)
        shown = some if shown is None else shown.unionAll(some)
    return cells, shown


def histogram_pattern(df: DataFrame, column: str, lower: object = None, upper: object = None, bins: int = 128) -> dict[str, DataFrame]:
    """Quantile sketch of a column, and the histogram of the rows in a range of it."""
    return {"sketch": stats.sketch(df, column), "histogram": stats.histogram(filters.range_query(df, column, lower, upper), column, bins)}


def histogram_2d_pattern(df: DataFrame, x: str, y: str, bins: int = 64) -> dict[str, DataFrame]:
    return {"extent": stats.extrema(df, [x, y], "min").unionByName(stats.extrema(df, [x, y], "max")), "histogram": stats.histogram_2d(df, x, y, bins, bins)}


def statistics_matrix(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The statistics chosen for each column: one profile of all simple ones, and a table for each other.

    Functions: hide (none), min, max, var, distinct, count, hist.
    """
    shown = {c: [f for f in fs if f != "hide"] for c, fs in wanted.items()}
    simple = sorted({f for fs in shown.values() for f in fs} - {"hist"})
    columns = [c for c, fs in shown.items() if set(fs) - {"hist"}]
    out = {"profile": stats.profile(df, columns, tuple(simple))} if columns and simple else {}
    kinds = dict(df.dtypes)
    for c, fs in shown.items():
        if "hist" in fs:
            out[f"hist_{c}"] = stats.histogram_categorical(df, c) if kinds[c] == "string" else stats.histogram(df, c)
    return out
