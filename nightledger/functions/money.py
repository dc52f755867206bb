"""Exact arithmetic: money is whole paise, ratios are rounded integer quotients.

Half goes away from zero, as in SQL's numeric round. Ratios come as hundredths of
a percent (``_bp``), so equal inputs give equal results on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_div(n: Column, d: Column | int) -> Column:
    """n / d to the nearest whole number, halves away from zero; null for d = 0. d is not negative."""
    d = F.lit(d) if isinstance(d, int) else d
    d = d.cast("long")
    n = n.cast("long")
    return F.when(d != 0, F.signum(n).cast("long") * int_div(2 * F.abs(n) + d, 2 * d)).otherwise(F.lit(None).cast("long"))


def int_div(n: Column, d: Column | int) -> Column:
    """Whole quotient of longs, towards zero."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.call_function("div", n.cast("long"), d.cast("long"))


def bp(part: Column, whole: Column) -> Column:
    """100 * part / whole in percent, as hundredths of a percent; null if the whole is 0."""
    return rounded_div(part.cast("long") * 10000, whole)
