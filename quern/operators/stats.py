"""Statistics of columns: extrema, moments, sketches, histograms, samples, scaling, imputation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def clean(df: DataFrame, column: str) -> Column:
    """The column without NaN."""
    return F.when(~F.isnan(column), F.col(column)) if _kind(df, column) in ("double", "float") else F.col(column)


def numeric(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]


def extrema(df: DataFrame, columns: list[str] | None = None, which: str = "max") -> DataFrame:
    """One row: the largest (or least) value of each column, NaN skipped."""
    f = {"max": F.max, "min": F.min}[which]
    return df.agg(*(f(clean(df, c)).alias(c) for c in columns or df.columns))


def index_of_extrema(df: DataFrame, columns: list[str], which: str = "max", rid: str = "_rid") -> DataFrame:
    """One row: for each column the id of its extremum (the smallest id of equal ones) and the value."""
    sign = -1 if which == "max" else 1
    cells = []
    for c in columns:
        best = F.min(F.when(clean(df, c).isNotNull(), F.struct((sign * clean(df, c)).alias("v"), F.col(rid).alias("i"))))
        cells += [best["i"].alias(f"{c}_id"), (sign * best["v"]).alias(c)]
    return df.agg(*cells)


def min_max(df: DataFrame, column: str, min_column: str | None = None, max_column: str | None = None) -> DataFrame:
    return df.agg(F.min(clean(df, column)).alias(min_column or f"_{column}_min"), F.max(clean(df, column)).alias(max_column or f"_{column}_max"))


def variance(df: DataFrame, columns: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """One row: the variance of each numeric column, 0 for too few rows."""
    f = F.var_pop if ddof == 0 else F.var_samp
    return df.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(c) for c in columns or numeric(df)))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def reducers(df: DataFrame, columns: list[str], which: tuple[str, ...] = ("any", "all", "min", "max", "var")) -> DataFrame:
    """One row for each function: ``function`` and its value for each column, as doubles."""
    f = {
        "any": lambda c: F.max((F.col(c) != 0).cast("double")),
        "all": lambda c: F.min((F.col(c) != 0).cast("double")),
        "min": lambda c: F.min(clean(df, c)).cast("double"),
        "max": lambda c: F.max(clean(df, c)).cast("double"),
        "var": lambda c: F.var_pop(c),
        "sum": lambda c: F.sum(c).cast("double"),
        "mean": F.avg,
    }
    rows = F.array(*(F.struct(F.lit(w).alias("function"), *(f[w](c).alias(c) for c in columns)) for w in which))
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def t_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's distribution by bisection of its incomplete beta integral."""

    def cdf(t: float) -> float:
        x = freedom / (freedom + t * t)
        a, b = freedom / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        tail = front * _beta_fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(1 - x, b, a) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or tiny)
            c = (1 + n / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def mean_interval(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Mean, and half its one-sided confidence interval by the central limit theorem."""
    n, mean, var = df.agg(F.count(column), F.avg(column), F.var_pop(column)).first()
    half = t_quantile(1 - alpha, n - 1) * math.sqrt(var / n) if n and n > 1 else None
    return df.sparkSession.createDataFrame([(mean, half)], "mean double, half double")


def distinct(df: DataFrame, columns: list[str] | None = None, threshold: int = 56) -> DataFrame:
    """One row: the sorted distinct values of each column as text, or null beyond the threshold.

    Values are first reduced to at most ``threshold`` + 1 for each column, so no task holds more.
    """
    columns = columns or df.columns
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))).filter("value is not null").distinct()
    few = long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= threshold).select("column")
    sets = long.join(F.broadcast(few), "column", "left_semi").groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return sets.groupBy().pivot("column", columns).agg(F.first("values"))


def sample(df: DataFrame, k: int = 50, key: str = "_rid", seed: int = 42) -> DataFrame:
    """A uniform sample of exactly k rows (all, if there are fewer): those with the least hashes of their keys."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


# Histograms.


def bounds(df: DataFrame, column: str, delta: float = -5) -> tuple[float, float] | None:
    """Least and largest value, widened by ``delta`` (if negative that percentage of the extent)."""
    lo, hi = df.agg(F.min(clean(df, column)), F.max(clean(df, column))).first()
    if lo is None:
        return None
    d = delta if delta >= 0 else (hi - lo) * -delta / 100
    return float(lo) - d, float(hi) + d


def bucket(column: str, lo: float, hi: float, bins: int) -> Column:
    """Bin 0 .. bins-1 of equal width; the last includes its upper end; null outside."""
    b = F.width_bucket(F.col(column).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)) - 1
    b = F.when(F.col(column) == hi, F.lit(bins - 1).cast("long")).otherwise(b)
    return F.when((b >= 0) & (b < bins), b)


def histogram(df: DataFrame, column: str, bins: int = 128, delta: float = -5, extent: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high and n of equal-width bins; empty ones too."""
    extent = extent or bounds(df, column, delta)
    if extent is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    lo, hi = extent
    hi = hi if hi > lo else lo + 1
    counts = df.select(bucket(column, lo, hi, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").alias("bin"), (lo + F.col("id") * ((hi - lo) / bins)).alias("low"), (lo + (F.col("id") + 1) * ((hi - lo) / bins)).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_categorical(df: DataFrame, column: str) -> DataFrame:
    if _kind(df, column) != "string":
        raise TypeError(f"{column} is no string column")
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, xbins: int = 64, ybins: int = 64, xdelta: float = -5, ydelta: float = -5, extent: tuple | None = None, by: list[str] | None = None) -> DataFrame:
    """bx, by and n of the cells that have rows; rows outside the extent are not counted."""
    (xlo, xhi), (ylo, yhi) = extent or (bounds(df, x, xdelta), bounds(df, y, ydelta))
    cells = df.select(*(by or []), bucket(x, xlo, xhi, xbins).alias("bx"), bucket(y, ylo, yhi, ybins).alias("by")).filter("bx is not null and by is not null")
    return cells.groupBy(*(by or []), "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def histogram_matrix(cells: DataFrame, xbins: int = 64, ybins: int = 64) -> list[list[int]]:
    """The cells as rows of y, largest y first."""
    out = [[0] * xbins for _ in range(ybins)]
    for r in cells.collect():  # at most xbins * ybins rows
        out[ybins - 1 - r["by"]][r["bx"]] = r["n"]
    return out


def histogram_2d_classes(df: DataFrame, x: str, y: str, classes: str, **options) -> DataFrame:
    """Cells of each class over the joint extent of all classes."""
    return histogram_2d(df, x, y, by=[classes], **options)


def heat(cells: DataFrame, transform: str = "log", low: int = 0, high: int = 65535) -> DataFrame:
    """Counts scaled to whole numbers between low and high."""
    f = {"none": lambda c: c.cast("double"), "sqrt": F.sqrt, "cbrt": F.cbrt, "log": F.log1p}[transform]
    v = cells.withColumn("_v", f(F.col("n")))
    ends = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    scaled = F.floor((F.col("_v") - F.col("_lo")) * (high - low) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) + 0.499) + low
    return v.crossJoin(F.broadcast(ends)).withColumn("heat", scaled).drop("_v", "_lo", "_hi")


def histogram_change(a: DataFrame, b: DataFrame, key: str = "bin") -> DataFrame:
    """How much two histograms differ: the sum of absolute, and the root of squared, differences of their shares."""
    share = lambda h, n: h.select(key, (F.col("n") / F.sum("n").over(_all())).alias(n))
    both = share(a, "p").join(share(b, "q"), key, "full").select(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))).alias("d"))
    return both.agg(F.sum("d").alias("l1"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


# Quantiles.


#: Different values of a column that one task may hold with their counts.
DISTINCT = 1_000_000


def quantiles(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """quantile, and its exact value in each column.

    Values are counted first, so that a column of few different ones takes one pass with
    partial sums; columns with more than ``DISTINCT`` of them go by :func:`quantile_by_counting`.
    """
    few = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first().asDict()
    small = [c for c in columns if few[c] <= DISTINCT]
    found = df.agg(F.lit(0).alias("_all"), *(F.percentile(clean(df, c), F.array(*map(F.lit, at))).alias(c) for c in small))
    large = {c: [quantile_by_counting(df, c, q) for q in at] for c in columns if c not in small}
    value = lambda c, i: F.get(F.col(c), F.lit(i)) if c in small else F.lit(large[c][i]).cast("double")
    cells = F.array(*(F.struct(F.lit(q).alias("quantile"), *(value(c, i).alias(c) for c in columns)) for i, q in enumerate(at)))
    return found.select(F.inline(cells))


def quantile_by_counting(df: DataFrame, column: str, q: float, bins: int = 4096, few: int = 10_000) -> float | None:
    """An exact quantile (linear between neighbours) of a column of any size.

    Each round counts the values in equal bins of the interval that holds the wanted
    ranks, and goes on in the bins of those ranks until they hold few values.
    """
    values = df.select(clean(df, column).cast("double").alias("v")).filter("v is not null")
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = (n - 1) * q
    low, high, before = math.floor(rank), math.ceil(rank), 0
    while n > few and hi > lo and math.isfinite(hi - lo):
        b = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).alias("b")
        counts = values.filter(F.col("v").between(lo, hi)).groupBy(b).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        seen, kept, start = before, [], before
        for r in counts:
            if seen + r["n"] > low and seen <= high:
                if not kept:
                    start = seen
                kept.append(r)
            seen += r["n"]
        new = (kept[0]["lo"], kept[-1]["hi"])
        if new == (lo, hi):
            break
        (lo, hi), n, before = new, sum(r["n"] for r in kept), start
    if hi == lo:
        return lo
    inside = [r[0] for r in values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("v").alias("k")).orderBy("v").select(F.explode(F.array_repeat("v", F.least("k", F.lit(high - before + 1)).cast("int")))).limit(high - before + 1).collect()]
    a, b = inside[low - before], inside[high - before]
    return a + (b - a) * (rank - low)


def sketch(df: DataFrame, column: str, k: int = 200) -> DataFrame:
    """One row: a KLL sketch of a column, mergeable and small."""
    return df.agg(F.expr(f"kll_sketch_agg_double(cast(`{column}` as double), {k})").alias("sketch"), F.min(column).alias("min"), F.max(column).alias("max"))


def sketch_quantiles(sketched: DataFrame, at: list[float]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(q).alias("quantile"), F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)").alias("value")) for q in at))
    return sketched.select(F.inline(cells))


def sketch_pmf(sketched: DataFrame, splits: list[float]) -> DataFrame:
    """Share of the values in each interval between the split points."""
    rank = lambda x: F.expr(f"kll_sketch_get_rank_double(sketch, {x!r}D)")
    ends = [F.lit(0.0), *map(rank, splits), F.lit(1.0)]
    return sketched.select(F.inline(F.array(*(F.struct(F.lit(i).alias("interval"), (b - a).alias("share")) for i, (a, b) in enumerate(zip(ends, ends[1:]))))))


# Preparation.


def imputed(df: DataFrame, strategies: dict[str, str | tuple[str, object]]) -> DataFrame:
    """Missing and NaN cells replaced by the mean, median, most_frequent value or a constant of their column."""
    f = {"mean": F.avg, "most_frequent": lambda c: F.mode(c, True)}
    learnt = {c: s for c, s in strategies.items() if s in f}
    row = df.agg(*(f[s](clean(df, c)).alias(c) for c, s in learnt.items())).first().asDict() if learnt else {}
    row |= {c: quantile_by_counting(df, c, 0.5) for c, s in strategies.items() if s == "median"}
    fills = {c: row[c] if isinstance(s, str) else s[1] for c, s in strategies.items()}
    return df.withColumns({c: F.coalesce(clean(df, c), F.lit(v)) for c, v in fills.items()})


def min_max_scaled(df: DataFrame, columns: list[str], extent: dict[str, tuple[float, float]] | None = None, outside: str = "clip") -> DataFrame:
    """Columns moved to [0, 1] by their own or a given extent; values outside are clipped, or their rows ignored."""
    if extent is None:
        row = df.agg(*(f(clean(df, c)).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
        extent = {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in columns}
    if outside == "ignore":
        for c, (lo, hi) in extent.items():
            df = df.filter(F.col(c).between(lo, hi))
    scale = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo) if hi != lo else F.lit(0.0)
    return df.withColumns({c: F.least(F.greatest(scale(c, *extent[c]), F.lit(0.0)), F.lit(1.0)) for c in columns})


def profile(df: DataFrame, columns: list[str], functions: tuple[str, ...] = ("min", "max", "var", "distinct")) -> DataFrame:
    """column, and the chosen statistics of it, in one pass."""
    f = {"min": lambda c: F.min(clean(df, c)).cast("string"), "max": lambda c: F.max(clean(df, c)).cast("string"), "var": lambda c: F.var_pop(c) if c in numeric(df) else F.lit(None).cast("double"), "distinct": F.count_distinct, "count": F.count}
    cells = F.array(*(F.struct(F.lit(c).alias("column"), *(f[n](c).alias(n) for n in functions)) for c in columns))
    return df.agg(cells.alias("_p")).select(F.inline("_p"))


def shape(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)
