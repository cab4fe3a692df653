"""Computed columns: from native functions, Python functions over Arrow batches, or expression strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.elementwise import BINARY, UNARY
from quern.functions.expressions import translate
from quern.operators.filters import OPERATORS

#: Stands for the value itself in :func:`if_else`.
UNCHANGED = object()


def if_else(op: str, test: object, if_true: object, if_false: object) -> Callable[[Column], Column]:
    """A function of a column: one value where it compares with ``test``, another elsewhere."""

    def made(c: Column) -> Column:
        value = lambda v: c if v is UNCHANGED else F.lit(v)
        return F.when(OPERATORS[op](c, F.lit(test)), value(if_true)).otherwise(value(if_false))

    return made


def _applied(f, columns: list[str], dtype: str | None) -> Column:
    args = [F.col(c) for c in columns]
    if isinstance(f, str):
        return (UNARY if len(args) == 1 else BINARY)[f](*args)
    if isinstance(f, np.ufunc):
        known = (UNARY if f.nin == 1 else BINARY).get(f.__name__)
        if known:
            return known(*args)
    if dtype is None:
        return f(*args)  # a function of columns

    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series(f(*series))

    batch.__annotations__ = {}
    return F.pandas_udf(batch, dtype, F.PandasUDFType.SCALAR)(*args)


class Computed:
    """Named computed columns that :meth:`repeat` adds to a table.

    A function is the name of an element-wise function, a NumPy universal function, a
    function of columns, or (with ``dtype``) a Python function of whole batches.
    """

    def __init__(self) -> None:
        self.columns: dict[str, Callable[[], Column]] = {}

    def add_function(self, name: str, f, columns: str | list[str], dtype: str | None = None) -> Computed:
        names = [columns] if isinstance(columns, str) else list(columns)
        self.columns[name] = lambda: _applied(f, names, dtype)
        return self

    def add_expression(self, name: str, expression: str, dtype: str | None = None) -> Computed:
        def made() -> Column:
            c = translate(expression)[1]
            return c.cast(dtype) if dtype else c

        self.columns[name] = made
        return self

    def repeat(self, df: DataFrame) -> DataFrame:
        """The table with the computed columns."""
        return df.withColumns({n: made() for n, made in self.columns.items()})
