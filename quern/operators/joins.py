"""Joins: related rows with their primary rows, and tables by row id."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import masked


def unique_index(df: DataFrame, on: str | list[str]) -> DataFrame:
    """The table, after a check that no key occurs twice."""
    keys = [on] if isinstance(on, str) else list(on)
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {tuple(twice[0])[:-1]} of {keys} is not unique")
    return df


def _condition(related: DataFrame, primary: DataFrame, related_on: list[str], primary_on: list[str], inv_mask: str | None) -> Column:
    part = (lambda c: masked(c, inv_mask)) if inv_mask else (lambda c: c)
    return fold(lambda a, b: a & b, [part(related[r]) == part(primary[p]) for r, p in zip(related_on, primary_on, strict=True)])


def _keys(on, primary_on, related_on) -> tuple[list[str], list[str]]:
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    return as_list(primary_on or on), as_list(related_on or on)


def join(related: DataFrame, primary: DataFrame, on: str | list[str] | None = None, primary_on=None, related_on=None, related_cols: list[str] | None = None, primary_cols: list[str] | None = None, how: str = "inner", fillna: object = None, suffix: str = "", inv_mask: str | None = None, check: bool = False) -> DataFrame:
    """Related rows (foreign key) with columns of their primary rows (primary key).

    ``outer`` keeps related rows without a primary row and fills its columns.  Keys may be
    composite, and with ``inv_mask`` dates are compared by the named parts.
    """
    if how not in ("inner", "outer"):
        raise ValueError("how must be inner or outer")
    p, r = _keys(on, primary_on, related_on)
    if check:
        unique_index(primary, p)
    out = related.join(primary, _condition(related, primary, r, p, inv_mask), "inner" if how == "inner" else "left")
    left = related_cols or related.columns
    right = primary_cols or [c for c in primary.columns if c not in p]
    taken = set(left)
    if not suffix and taken & set(right):
        raise ValueError(f"columns {sorted(taken & set(right))} are in both tables; give a suffix")
    fill = lambda c: F.coalesce(primary[c], F.lit(fillna)) if how == "outer" and fillna is not None else primary[c]
    return out.select(*(related[c] for c in left), *(fill(c).alias(c + suffix if c in taken else c) for c in right))


def primary_outer(related: DataFrame, primary: DataFrame, on=None, primary_on=None, related_on=None, inv_mask: str | None = None) -> DataFrame:
    """Primary rows that no related row names."""
    p, r = _keys(on, primary_on, related_on)
    return primary.join(related, _condition(related, primary, r, p, inv_mask), "left_anti")


def join_by_id(first: DataFrame, *others: DataFrame, how: str = "left", lsuffix: str = "", rsuffix: str = "", rid: str = "_rid") -> DataFrame:
    """Tables side by side by row id: left, right or inner."""
    if how not in ("left", "right", "inner"):
        raise ValueError("how must be left, right or inner")
    for other in others:
        both = (set(first.columns) & set(other.columns)) - {rid}
        if both and lsuffix == rsuffix:
            raise ValueError(f"columns {sorted(both)} are in both tables; give suffixes")
        a = first.select(rid, *(F.col(c).alias(c + lsuffix if c in both else c) for c in first.columns if c != rid))
        b = other.select(rid, *(F.col(c).alias(c + rsuffix if c in both else c) for c in other.columns if c != rid))
        first = a.join(b, rid, how)
    return first


def merge(first: DataFrame, *others: DataFrame, suffixes: tuple[str, str] = ("_x", "_y"), rid: str = "_rid") -> DataFrame:
    """Rows whose id is in all tables, with the columns of all."""
    return join_by_id(first, *others, how="inner", lsuffix=suffixes[0], rsuffix=suffixes[1], rid=rid)


def combine_first(first: DataFrame, second: DataFrame, rid: str = "_rid") -> DataFrame:
    """All ids and columns of both; the first table's value unless it is missing or NaN."""
    a, b = first.alias("a"), second.alias("b")
    out = a.join(b, F.col(f"a.{rid}") == F.col(f"b.{rid}"), "full")
    kinds = dict(first.dtypes)
    clean = lambda c: F.when(~F.isnan(F.col(f"a.{c}")), F.col(f"a.{c}")) if kinds[c] in ("double", "float") else F.col(f"a.{c}")
    columns = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c != rid]
    value = lambda c: F.coalesce(clean(c), F.col(f"b.{c}")) if c in first.columns and c in second.columns else F.col(f"a.{c}") if c in first.columns else F.col(f"b.{c}")
    return out.select(F.coalesce(F.col(f"a.{rid}"), F.col(f"b.{rid}")).alias(rid), *(value(c).alias(c) for c in columns))


# Id sets.


def intersection(*ids: DataFrame, rid: str = "_rid") -> DataFrame:
    return fold(lambda a, b: a.join(b.select(rid).distinct(), rid, "left_semi"), ids)


def union_ids(*ids: DataFrame, rid: str = "_rid") -> DataFrame:
    return fold(lambda a, b: a.unionAll(b), [i.select(rid) for i in ids]).distinct()


def difference(a: DataFrame, b: DataFrame, rid: str = "_rid") -> DataFrame:
    return a.join(b.select(rid).distinct(), rid, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, rid: str = "_rid") -> DataFrame:
    return difference(a, b, rid).select(rid).unionAll(difference(b, a, rid).select(rid))


def flip(ids: DataFrame, start: int, stop: int, rid: str = "_rid") -> DataFrame:
    """Ids of [start, stop) that are not in the set, and those outside that are."""
    return symmetric_difference(ids, ids.sparkSession.range(start, stop).select(F.col("id").alias(rid)), rid)


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name."""
    return fold(lambda a, b: a.unionByName(b), [first, *others])
