"""Element-wise functions and reductions with the semantics of NumPy's universal functions.

Every function is a native expression, so it stays in generated code; only those without a
counterpart (``frexp``, ``spacing``, ``nextafter``) use Arrow-batched pandas UDFs.  Guards
make division by zero, signed zeros, infinities, numbers too large for a long, logarithms
of zero and NaN behave as IEEE arithmetic does.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def _wild(a: Column) -> Column:
    return F.isnan(a) | (F.abs(a) == inf())


def _log(f, pivot: float = 0.0):
    return lambda a: F.when((a > pivot) | F.isnan(a), F.when(F.isnan(a), nan()).otherwise(f(F.when(a > pivot, a)))).when(a == pivot, -inf()).when(a < pivot, nan())


def _whole(f):
    # From 2^52 on every double is whole, and beyond 2^63 none fits the long that Spark rounds to.
    return lambda a: F.when(_wild(a.cast("double")) | (F.abs(a.cast("double")) >= 2.0**52), a.cast("double")).otherwise(f(a).cast("double"))


def _minus(a: Column) -> Column:
    """True for negative numbers and for the negative zero, which compares as zero."""
    return F.when(a == 0, a.cast("double").cast("string") == "-0.0").otherwise(a < 0)


def _signed(value: Column, *signs: Column) -> Column:
    """A value that is negated once for each negative number."""
    odd = _minus(signs[0]) if len(signs) == 1 else _minus(signs[0]) != _minus(signs[1])
    return F.when(odd, -value).otherwise(value)


def _not(a: Column) -> Column:
    return ~(a != 0)


def _frexp(a: Column) -> Column:
    @F.pandas_udf("struct<mantissa:double,exponent:int>")
    def made(x: pd.Series) -> pd.DataFrame:
        m, e = np.frexp(x.to_numpy(float))
        return pd.DataFrame({"mantissa": m, "exponent": e})

    return made(a)


def _spacing(a: Column) -> Column:
    @F.pandas_udf("double")
    def made(x: pd.Series) -> pd.Series:
        return pd.Series(np.spacing(x.to_numpy(float)))

    return F.coalesce(made(a), F.when(a.isNotNull(), nan()))


def _nextafter(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))

    return F.coalesce(made(a, b), F.when(a.isNotNull() & b.isNotNull(), nan()))


def _trunc(a: Column) -> Column:
    return F.when(_wild(a.cast("double")), a.cast("double")).otherwise(a - a % 1)


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(F.isnan(a) | F.isnan(b) | ((a == 0) & (b == 0)), nan()).when(b == 0, _signed(inf(), a, b)).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a == 0, nan()).otherwise(_signed(inf(), a, b))
    far = F.when(a == 0, _signed(F.lit(0.0), a, b)).when(_minus(a) != _minus(b), F.lit(-1.0)).otherwise(F.lit(0.0))
    plain = _whole(F.floor)(F.try_divide(a, b))
    return F.when(F.isnan(a) | F.isnan(b), nan()).when(b == 0, at_zero).when(F.abs(a) == inf(), nan()).when(F.abs(b) == inf(), far).otherwise(plain)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = F.try_mod(a, b)
    return F.when(b == 0, nan()).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def _power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | ((a == -1) & (F.abs(b.cast("double")) == inf())), F.lit(1.0)).otherwise(F.pow(a, b))


def _arctan2(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when((a == 0) & ~F.isnan(b), F.when(_minus(b), _signed(F.lit(np.pi), a)).otherwise(a)).otherwise(F.atan2(a, b))


def _modf(a: Column) -> Column:
    a = a.cast("double")
    endless = F.abs(a) == inf()
    return F.struct(F.when(endless | (a == 0), _signed(F.lit(0.0), a)).otherwise(a % 1).alias("fraction"), F.when(endless, a).otherwise(a - a % 1).alias("whole"))


def _ldexp(a: Column, b: Column) -> Column:
    """In two steps, as 2^b alone may be out of range where the result is not."""
    half = F.floor(b / 2)
    return F.when(a == 0, a).otherwise(a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), b - half))


def _logaddexp(a: Column, b: Column, base: float | None = None) -> Column:
    one = F.lit(np.log(base) if base else 1.0)
    same = F.lit(1.0) if base else F.lit(np.log(2.0))
    grow = F.log1p(F.exp(-F.abs(a - b) * one)) / one
    return F.when(a == b, a + same).otherwise(F.greatest(a, b) + grow)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps over a native fold; 93 steps are enough for 64 bits."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a * b).cast("long") / F.when(g != 0, g)).cast("long")


#: The 50 functions of one argument.
UNARY = {
    "bitwise_not": lambda a: F.bitwise_not(a),
    "absolute": F.abs,
    "arccos": F.acos,
    "arccosh": F.acosh,
    "arcsin": F.asin,
    "arcsinh": F.asinh,
    "arctan": F.atan,
    "arctanh": F.atanh,
    "cbrt": F.cbrt,
    "ceil": _whole(F.ceil),
    "conj": lambda a: a,
    "conjugate": lambda a: a,
    "cos": F.cos,
    "cosh": F.cosh,
    "deg2rad": F.radians,
    "degrees": F.degrees,
    "exp": F.exp,
    "exp2": lambda a: F.pow(F.lit(2.0), a),
    "expm1": F.expm1,
    "fabs": lambda a: F.abs(a.cast("double")),
    "floor": _whole(F.floor),
    "frexp": _frexp,
    "invert": lambda a: F.bitwise_not(a),
    "isfinite": lambda a: ~_wild(a.cast("double")),
    "isinf": lambda a: F.abs(a.cast("double")) == inf(),
    "isnan": lambda a: F.isnan(a.cast("double")),
    "isnat": lambda a: a.isNull(),
    "log": _log(F.ln),
    "log10": _log(F.log10),
    "log1p": _log(F.log1p, -1.0),
    "log2": _log(F.log2),
    "logical_not": _not,
    "modf": _modf,
    "negative": lambda a: -a,
    "positive": lambda a: a,
    "rad2deg": F.degrees,
    "radians": F.radians,
    "reciprocal": lambda a: F.when(a == 0, _signed(inf(), a)).otherwise(F.try_divide(F.lit(1.0), a)),
    "rint": F.rint,
    "sign": F.signum,
    "signbit": _minus,
    "sin": F.sin,
    "sinh": F.sinh,
    "spacing": _spacing,
    "sqrt": F.sqrt,
    "square": lambda a: a * a,
    "tan": F.tan,
    "tanh": F.tanh,
    "trunc": _trunc,
    "abs": F.abs,
}

#: The 40 functions of two arguments.
BINARY = {
    "add": lambda a, b: a + b,
    "arctan2": _arctan2,
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "copysign": lambda a, b: _signed(F.abs(a), b),
    "divide": divide,
    "divmod": lambda a, b: F.struct(floor_divide(a, b).alias("quotient"), mod(a, b).alias("remainder")),
    "equal": lambda a, b: (a == b) & ~F.isnan(a.cast("double")),
    "floor_divide": floor_divide,
    "float_power": _power,
    "fmax": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)),
    "fmin": lambda a, b: F.least(a, b),
    "fmod": lambda a, b: F.when(b == 0, nan()).otherwise(F.try_mod(a, b)),
    "gcd": gcd,
    "greater": lambda a, b: (a > b) & ~F.isnan(a.cast("double")),
    "greater_equal": lambda a, b: (a >= b) & ~F.isnan(a.cast("double")),
    "heaviside": lambda a, b: F.when(F.isnan(a), a).when(a < 0, F.lit(0.0)).when(a == 0, b).otherwise(F.lit(1.0)),
    "hypot": F.hypot,
    "lcm": lcm,
    "ldexp": _ldexp,
    "left_shift": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    "less": lambda a, b: (a < b) & ~F.isnan(b.cast("double")),
    "less_equal": lambda a, b: (a <= b) & ~F.isnan(b.cast("double")),
    "logaddexp": _logaddexp,
    "logaddexp2": lambda a, b: _logaddexp(a, b, 2.0),
    "logical_and": lambda a, b: (a != 0) & (b != 0),
    "logical_or": lambda a, b: (a != 0) | (b != 0),
    "logical_xor": lambda a, b: (a != 0) != (b != 0),
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": lambda a, b: F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b)),
    "mod": mod,
    "multiply": lambda a, b: a * b,
    "nextafter": _nextafter,
    "not_equal": lambda a, b: (a != b) | F.isnan(a.cast("double")) | F.isnan(b.cast("double")),
    "power": _power,
    "remainder": mod,
    "right_shift": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    "subtract": lambda a, b: a - b,
    "true_divide": divide,
}


def _sum_exp(base: float | None):
    def made(x: Column, m: Column) -> Column:
        e = F.exp(x - m) if base is None else F.pow(F.lit(base), x - m)
        total = F.sum(e)
        return F.first(m) + (F.ln(total) if base is None else F.log2(total))

    return made


#: Reductions whose result does not depend on the order, as aggregates.
FREE_REDUCE = {
    "add": F.sum,
    "bitwise_and": F.bit_and,
    "bitwise_or": F.bit_or,
    "bitwise_xor": F.bit_xor,
    "fmax": lambda x: F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x)),
    "fmin": F.min,
    "hypot": lambda x: F.sqrt(F.sum(x * x)),
    "logical_and": lambda x: F.bool_and(x != 0),
    "logical_or": lambda x: F.bool_or(x != 0),
    "logical_xor": lambda x: F.count_if(x != 0) % 2 == 1,
    "maximum": F.max,
    "minimum": lambda x: F.when(F.count_if(F.isnan(x)) > 0, nan()).otherwise(F.min(x)),
    "multiply": F.product,
}
_TWO_STEP = {"logaddexp": _sum_exp(None), "logaddexp2": _sum_exp(2.0)}
_INTEGER = {"gcd": (np.gcd, 0), "lcm": (np.lcm, 1)}
#: Folds that are the first value and a free reduction of the others.
_FIRST = {"subtract": (F.sum, lambda a, rest: a - F.coalesce(rest, F.lit(0.0))), "divide": (F.product, divide), "true_divide": (F.product, divide)}


def unary(name: str, a: Column | str) -> Column:
    return UNARY[name](F.col(a) if isinstance(a, str) else a)


def binary(name: str, a: Column | str, b: Column | str) -> Column:
    return BINARY[name](*(F.col(x) if isinstance(x, str) else x for x in (a, b)))


def map_columns(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Replace columns by a function of one argument."""
    return df.withColumns({c: unary(name, c) for c in columns or df.columns})


def zip_columns(df: DataFrame, name: str, first: list[str], second: list[str], out: list[str]) -> DataFrame:
    """A function of two arguments over pairs of columns of one table."""
    if not len(first) == len(second) == len(out):
        raise ValueError("the three column lists must have the same length")
    return df.select(*(binary(name, a, b).alias(o) for a, b, o in zip(first, second, out, strict=True)))


def combine_tables(first: DataFrame, second: DataFrame | dict, name: str, key: str = "_rid") -> DataFrame:
    """A function of two arguments over the like-placed columns of two tables joined on ``key``.

    ``second`` may be a dict of scalars by the column names of ``first``.
    """
    columns = [c for c in first.columns if c != key]
    if isinstance(second, dict):
        return first.select(*([key] if key in first.columns else []), *(binary(name, c, F.lit(second[c])).alias(c) for c in columns))
    others = [c for c in second.columns if c != key]
    a, b = first.alias("a"), second.alias("b")
    pairs = zip(columns, others, strict=True)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), *(binary(name, F.col(f"a.`{x}`"), F.col(f"b.`{y}`")).alias(x) for x, y in pairs))


def reduce_columns(df: DataFrame, name: str, columns: list[str], order: str | None = None) -> DataFrame:
    """One row: each column reduced by a function of two arguments.

    Free functions are plain aggregates with partial sums.  The others are left folds in
    the order of ``order`` and need all values of a column in one place, by definition.
    """
    if name in FREE_REDUCE:
        return df.agg(*(FREE_REDUCE[name](F.col(c)).alias(c) for c in columns))
    if name in _TWO_STEP:
        most = df.agg(*(F.max(c).alias(f"_m_{c}") for c in columns))
        return df.crossJoin(F.broadcast(most)).agg(*(_TWO_STEP[name](F.col(c), F.col(f"_m_{c}")).alias(c) for c in columns))
    if name in _INTEGER:
        parts = df.select(*(F.col(c).cast("long").alias(c) for c in columns))
        folded = _folding(*_INTEGER[name], columns)
        return parts.mapInArrow(folded, parts.schema).coalesce(1).mapInArrow(folded, parts.schema)
    if name not in BINARY:
        raise KeyError(name)
    if order is None:
        raise ValueError(f"{name} is a fold; name the column that orders it")
    if name in _FIRST:
        return _first_and_rest(df, name, columns, order)
    op = BINARY[name]
    step = lambda acc, y: F.when(acc.isNull(), y).otherwise(op(acc, y).cast("double"))
    values = {c: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).cast("double").alias("x")))), lambda s: s["x"]) for c in columns}
    return df.agg(*(F.aggregate(v, F.lit(None).cast("double"), step).alias(c) for c, v in values.items()))


def _folding(f: np.ufunc, start: int, columns: list[str]):
    """One row for each partition: its columns folded batch by batch, with 64 bits as NumPy does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full(len(columns), start, np.int64)
        for batch in batches:
            for k, c in enumerate(columns):
                held[k] = f(held[k], f.reduce(np.unique(np.asarray(batch.column(c).drop_null())), initial=start))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held], names=columns)

    return run


def _first_and_rest(df: DataFrame, name: str, columns: list[str], order: str) -> DataFrame:
    of_rest, joined = _FIRST[name]
    first = df.agg(F.min(order).alias("_least"), *(F.min_by(F.col(c).cast("double"), order).alias(f"_first_{c}") for c in columns))
    both = df.crossJoin(F.broadcast(first))
    rest = both.agg(*(F.first(f"_first_{c}").alias(f"_first_{c}") for c in columns), *(of_rest(F.when(F.col(order) > F.col("_least"), F.col(c).cast("double"))).alias(c) for c in columns))
    empty = F.lit(1.0) if of_rest is F.product else F.lit(0.0)
    return rest.select(*(joined(F.col(f"_first_{c}"), F.coalesce(F.col(c), empty)).alias(c) for c in columns))


def running(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Running sum of a column, for the folds that are sums."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{column}_running", F.sum(column).over(w))
