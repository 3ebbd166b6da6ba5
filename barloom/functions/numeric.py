"""Rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: Column | str, places: int) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: the same value in any engine with IEEE doubles."""
    x, m = col(x), float(10**places)
    return F.floor(x * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def change(a: Column | str, b: Column | str) -> Column:
    """Percent change from b to a."""
    return (over(col(a), col(b)) - 1) * 100


def clean(x: Column | str, most: float = 1.79e308 * 0.99) -> Column:
    """A number out of text or doubles; null for what is none and for the 'no value' sentinel."""
    v = col(x).try_cast("double")
    return F.when(F.abs(v) < most, v)


def hhmm(x: Column | str) -> Column:
    """HH:MM of a time such as 93005; empty if there are fewer than four characters."""
    s = F.lpad(col(x).cast("string"), 6, "0")
    return F.when(F.length(col(x).cast("string")) < 4, "").otherwise(F.concat_ws(":", F.substring(s, 1, 2), F.substring(s, 3, 2)))


def signed(x: Column, places: int = 1) -> Column:
    """A number with its sign and a fixed number of places, such as +1.5."""
    return F.format_string(f"%+.{places}f", x)
