"""Accuracy metrics and interval formulas as Columns for use in agg(); rows with a missing operand don't count."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(*cols: Column) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out


def count_finite(y: Column, p: Column) -> Column:
    return F.count(F.when(_both(y, p), 1))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """Unclipped; null for fewer than 3 rows or constant y."""
    n = count_finite(y, p)
    own = F.when(_both(y, p), y)
    sst = F.var_pop(own) * n
    return F.when((n >= 3) & (sst > 0), 1 - F.try_divide(F.sum((y - p) * (y - p)), sst))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(F.when(_both(y, lo, hi), ((y >= lo) & (y <= hi)).cast("int")))


def fade_skill(now: Column, y: Column, p: Column) -> Column:
    """1 - MSE of p over MSE of persistence."""
    return 1 - F.try_divide(F.avg((y - p) * (y - p)), F.avg((y - now) * (y - now)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Limits of a share k/n; null for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series with positive terms up to 2, a continued fraction beyond."""
    twice = 2 * x * x
    first = F.struct(x.alias("term"), x.alias("total"))

    def more(held, k):
        term = held["term"] * twice / (2 * k + 3)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), first, more, lambda held: held["total"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda held, k: x + k / 2 / held)
    return F.when(x <= 2, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def arrhenius(t: Column, ea: float = 30e3) -> Column:
    """Rate factor at t degrees C against 24 degrees C."""
    return F.exp(ea / 8.314 * (1 / 297.15 - 1 / (t + 273.15)))
