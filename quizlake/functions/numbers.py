"""Expressions over numbers: shares, rounding, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(k: Column, n: Column) -> Column:
    """k of n in percent, unrounded; 0 if n is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(k / n * 100)


def percent(k: Column, n: Column, digits: int = 2) -> Column:
    """``share``, rounded half to even."""
    return F.bround(share(k, n), digits)


def fraction(k: Column, n: Column) -> Column:
    """Written as k/n."""
    return F.concat_ws("/", k.cast("string"), n.cast("string"))


def one_decimal(x: Column) -> Column:
    """Written with one decimal, rounded half to even first."""
    return F.format_string("%.1f", F.bround(x, 1))


def signed(x: Column) -> Column:
    """A whole number written with its sign, 0 as +0. Null stays null."""
    return F.when(x >= 0, F.concat(F.lit("+"), x.cast("string"))).otherwise(x.cast("string"))


def minutes_seconds(seconds: Column) -> Column:
    """Written as mm:ss; minutes of more than two digits stay whole. Null stays null."""
    whole = F.floor(seconds)
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def hours(seconds: Column) -> Column:
    """Written as hours with one decimal, as in "2.0 horas"."""
    return F.concat(one_decimal(seconds / 3600), F.lit(" horas"))
