"""Change logs: rows (_rid, _op in C, U, D, _run, values), compacted, applied and made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame, values: list[str]) -> DataFrame:
    """One change for each id.

    Created then deleted cancels out, deleted then created is an update, an update of a
    created row is absorbed.  Only each id's first and last change matter, so partial
    aggregation does the work.
    """
    first = F.min(F.struct("_run", "_op"))
    last = F.max(F.struct("_run", "_op", *values))
    both = log.groupBy("_rid").agg(first.alias("f"), last.alias("l"))
    op = F.when(F.col("f._op") == "C", F.when(F.col("l._op") != "D", F.lit("C"))).otherwise(F.when(F.col("l._op") == "D", F.lit("D")).otherwise(F.lit("U")))
    return both.select("_rid", op.alias("_op"), F.col("l._run").alias("_run"), *(F.col(f"l.{v}").alias(v) for v in values)).filter("_op is not null")


def apply(table: DataFrame, changes: DataFrame, values: list[str]) -> DataFrame:
    """The table after compacted changes."""
    kept = table.join(changes.select("_rid"), "_rid", "left_anti").select("_rid", *values)
    return kept.unionByName(changes.filter("_op <> 'D'").select("_rid", *values))


def diff(before: DataFrame, after: DataFrame, values: list[str], run: int = 0) -> DataFrame:
    """The changes that make one table of the other."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a._rid") == F.col("b._rid"), "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    op = F.when(F.col("a._rid").isNull(), "C").when(F.col("b._rid").isNull(), "D").when(~same, "U")
    return both.select(F.coalesce("a._rid", "b._rid").alias("_rid"), op.alias("_op"), F.lit(run).alias("_run"), *(F.col(f"b.{v}").alias(v) for v in values)).filter("_op is not null")


def signed(changes: DataFrame, before: DataFrame, values: list[str]) -> DataFrame:
    """Rows to add (+1) and to take away (-1): sums and counts follow by adding signs."""
    old = before.join(changes.filter("_op <> 'C'").select("_rid"), "_rid", "left_semi").select(*values, F.lit(-1).alias("_sign"))
    return old.unionByName(changes.filter("_op <> 'D'").select(*values, F.lit(1).alias("_sign")))


def stir(table: DataFrame, delete: int | list[int] | str | None = None, update: tuple[list[int], dict] | None = None, rid: str = "_rid") -> DataFrame:
    """Test mutations: delete the n rows of least hashes, given ids, ``half`` or ``all``; update cells of ids."""
    if delete == "all":
        return table.limit(0)
    if delete == "half":
        table = table.filter(F.pmod(F.xxhash64(rid), F.lit(2)) == 0)
    elif isinstance(delete, int):
        table = table.join(table.select(rid).orderBy(F.xxhash64(rid), rid).limit(delete), rid, "left_anti")
    elif delete:
        table = table.filter(~F.col(rid).isin(*delete))
    if update:
        ids, cells = update
        table = table.withColumns({c: F.when(F.col(rid).isin(*ids), F.lit(v)).otherwise(F.col(c)) for c, v in cells.items()})
    return table
