"""Parts of dates, and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = {"Y": F.year, "M": F.month, "D": F.dayofmonth, "h": F.hour, "m": F.minute, "s": F.second}
NAMES = {"Y": "year", "M": "month", "D": "day", "h": "hour", "m": "minute", "s": "second"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_day_int(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ts))


def year_day_int(ts: Column | str) -> Column:
    return F.dayofyear(_c(ts))


def week_day(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEEE")


def ymd_string(ts: Column | str) -> Column:
    """Year, month and day joined by dashes, without leading zeros."""
    return F.concat_ws("-", F.year(_c(ts)), F.month(_c(ts)), F.dayofmonth(_c(ts)))


def is_weekend(ts: Column | str) -> Column:
    return F.weekday(_c(ts)) >= 5


def check_mask(mask: str) -> str:
    if not mask or set(mask) - set(PARTS) or len(set(mask)) != len(mask):
        raise ValueError(f"date parts must be different letters of YMDhms: {mask!r}")
    return "".join(p for p in PARTS if p in mask)


def masked(ts: Column | str, mask: str, keepdims: bool = False) -> Column:
    """A struct of the named parts; with ``keepdims`` of all six, the others zero."""
    mask = check_mask(mask)
    return F.struct(*((f(_c(ts)) if p in mask else F.lit(0)).alias(NAMES[p]) for p, f in PARTS.items() if keepdims or p in mask))


def as_vector(ts: Column | str) -> Column:
    """The six parts as an array."""
    return F.array(*(f(_c(ts)) for f in PARTS.values()))
