"""Grouping by columns, parts of dates, positions of arrays or functions, and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import check_mask, masked


@dataclass(frozen=True)
class Part:
    """A key made of part of a column: ``Part("ts").dt["YMD"]`` or ``Part("v").ix[0:2]``."""

    column: str
    kind: str = ""
    which: object = None

    @property
    def dt(self) -> _At:
        return _At(self, "dt")

    @property
    def ix(self) -> _At:
        return _At(self, "ix")

    @property
    def name(self) -> str:
        return f"{self.column}_{self.which}" if isinstance(self.which, str) else f"{self.column}_ix"

    def key(self, keepdims: bool = False) -> Column:
        if self.kind == "dt":
            return masked(self.column, self.which, keepdims)
        at = self.which
        if isinstance(at, str):
            at = ["YMDhms".index(p) for p in check_mask(at)]
        if isinstance(at, slice):
            start = at.start or 0
            return F.slice(self.column, start + 1, (F.lit(at.stop) if at.stop is not None else F.size(self.column)) - start)
        return F.array(*(F.get(F.col(self.column), F.lit(i)) for i in ([at] if isinstance(at, int) else at)))


@dataclass(frozen=True)
class _At:
    part: Part
    kind: str

    def __getitem__(self, which: object) -> Part:
        return Part(self.part.column, self.kind, which)


_deviation = lambda f: lambda c: F.coalesce(f(c), F.lit(0.0))
#: Aggregates by name; register more with :func:`register`.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": lambda c: F.count(F.lit(1)),
    "nunique": F.count_distinct,
    "uniq": F.count_distinct,
    "mean": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "sum": F.sum,
    "variance": _deviation(F.var_pop),
    "stddev": _deviation(F.stddev_pop),
    "min": F.min,
    "max": F.max,
}


def register(name: str, aggregate: Callable[[Column], Column]) -> None:
    """Add an aggregate: a function from column to aggregate column (a grouped pandas UDF is one)."""
    AGGREGATES[name] = aggregate


def key_columns(by, keepdims: bool = False) -> list[Column]:
    out = []
    for k in by if isinstance(by, list | tuple) else [by]:
        if isinstance(k, str):
            out.append(F.col(k))
        elif isinstance(k, Part):
            out.append(k.key(keepdims).alias(k.name))
        elif isinstance(k, Column):
            out.append(k)
        else:
            out.append(k().alias("by_col"))
    return out


def aggregate(df: DataFrame, by, compute: list[tuple[str, str]], keepdims: bool = False) -> DataFrame:
    """A row for each group: its keys, and ``{column}_{function}`` for each of ``compute``.

    An empty column stands for the first one, and gives a name that begins with a dash below.
    """
    first = df.columns[0]
    cells = [AGGREGATES[f](F.col(c or first)).alias(f"{c}_{f}") for c, f in compute]
    return df.groupBy(*key_columns(by, keepdims)).agg(*cells)


def covariance_matrix(df: DataFrame, columns: list[str], mode: str = "cov", by: list[str] | None = None) -> DataFrame:
    """Long form (first, second, value) of the sample covariances or correlations of all pairs; 0 where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    f = F.covar_samp if mode == "cov" else lambda a, b: F.coalesce(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)), F.lit(0.0))
    cells = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), f(a, b).alias("value")) for a, b in pairs))
    grouped = df.groupBy(*(by or [])).agg(cells.alias("_c"))
    return grouped.select(*(by or []), F.inline("_c"))
