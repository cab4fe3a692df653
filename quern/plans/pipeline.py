"""Operators by name, fluent pipelines and on-demand statistics of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.elementwise import map_columns
from quern.operators import stats

REGISTRY: dict[str, Callable] = {}


def operator(name: str) -> Callable:
    """Register a function from DataFrame to DataFrame under a name."""

    def put(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return put


class Pipe:
    """A step of a pipeline: ``load | step(f, ...) | step(g)``; run with :meth:`fetch`."""

    def __init__(self, f: Callable[[DataFrame], DataFrame]) -> None:
        self.f = f

    def __or__(self, other: Pipe) -> Pipe:
        return Pipe(lambda df: other.f(self.f(df)))

    def __ror__(self, df: DataFrame) -> DataFrame:
        return self.f(df)

    def fetch(self, df: DataFrame) -> list:
        return self.f(df).collect()


def step(f: Callable | str, *args, **kw) -> Pipe:
    f = REGISTRY[f] if isinstance(f, str) else f
    return Pipe(lambda df: f(df, *args, **kw))


def tee(*pipes: Pipe) -> Callable[[DataFrame], list[DataFrame]]:
    """Several pipelines over one table."""
    return lambda df: [p.f(df) for p in pipes]


class Facade:
    """Named statistics of a table, built when they are asked for; each object has its own registry."""

    DEFAULTS = {
        "min": lambda df, **k: stats.extrema(df, k.get("columns"), "min"),
        "max": lambda df, **k: stats.extrema(df, k.get("columns"), "max"),
        "var": lambda df, **k: stats.variance(df, k.get("columns")),
        "percentiles": lambda df, **k: stats.quantiles(df, k.get("columns") or stats.numeric(df), k.get("at", [0.25, 0.5, 0.75])),
        "histogram": lambda df, **k: stats.histogram(df, **k),
        "histogram2d": lambda df, **k: stats.histogram_2d(df, **k),
        "distinct": lambda df, **k: stats.distinct(df, k.get("columns")),
        "log": lambda df, **k: map_columns(df, "log", k.get("columns") or stats.numeric(df)),
        "sample": lambda df, **k: stats.sample(df, **k),
    }

    def __init__(self, df: DataFrame) -> None:
        self.df, self.known, self.options, self.made = df, dict(self.DEFAULTS), {}, {}

    def configure(self, base: str, name: str | None = None, **options) -> None:
        """A statistic with other options, under its own or another name."""
        name = name or base
        self.known[name], self.options[name] = self.known[base], options
        self.made.pop(name, None)

    def register(self, name: str, f: Callable) -> None:
        self.known[name] = f

    def forget(self, name: str) -> None:
        self.made.pop(name, None)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.__dict__["known"]:
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = self.known[name](self.df, **self.options.get(name, {}))
        return self.made[name]


# Small tables, pages and flow control.


def last_row(df: DataFrame, order: str = "_rid") -> DataFrame:
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def paste(a: DataFrame, b: DataFrame, order: str = "_rid") -> DataFrame:
    """One row: the last value of the first column of each table."""
    one = lambda df: df.agg(F.max_by(next(c for c in df.columns if c != order), order).alias(next(c for c in df.columns if c != order)))
    return one(a).crossJoin(one(b))


def merge_rows(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side; of equal names the last one counts."""
    out = rows[0]
    for r in rows[1:]:
        out = out.drop(*r.columns).crossJoin(r)
    return out


def page(df: DataFrame, start: int, end: int, order: str = "_rid") -> DataFrame:
    return df.orderBy(order).offset(start).limit(end - start)


def switch(df: DataFrame, condition: Callable[[DataFrame], bool]) -> tuple[DataFrame, DataFrame]:
    """The table as ``result`` or as ``result_else``; the other is empty.  Decided once."""
    return (df, df.limit(0)) if condition(df) else (df.limit(0), df)


def expand(f: Callable[[DataFrame, DataFrame], DataFrame], *tables: DataFrame) -> DataFrame:
    """A function of two tables over any number of them, from the left."""
    out = tables[0]
    for t in tables[1:]:
        out = f(out, t)
    return out


def to_dict(df: DataFrame, orient: str = "dict", rid: str = "_rid", limit: int = 100_000):
    """A table of at most ``limit`` rows as Python values: dict, list, split, rows, records, datatable or index."""
    rows = (df.orderBy(rid) if rid in df.columns else df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    columns = [c for c in df.columns if c != rid]
    ids = [r[rid] if rid in df.columns else i for i, r in enumerate(rows)]
    match orient:
        case "dict":
            return {c: {i: r[c] for i, r in zip(ids, rows, strict=True)} for c in columns}
        case "list":
            return {c: [r[c] for r in rows] for c in columns}
        case "split":
            return {"index": ids, "columns": columns, "data": [[r[c] for c in columns] for r in rows]}
        case "rows" | "records":
            return [{c: r[c] for c in columns} for r in rows]
        case "datatable":
            return [[i, *(r[c] for c in columns)] for i, r in zip(ids, rows, strict=True)]
        case "index":
            return {i: {c: r[c] for c in columns} for i, r in zip(ids, rows, strict=True)}
    raise ValueError(f"unknown orient {orient!r}")


def write_csv(df: DataFrame, path: str, **options) -> None:
    df.write.options(**options).csv(path)
