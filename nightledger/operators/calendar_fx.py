"""Holiday effects: each holiday-adjacent date against its own property, weekday and season."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_dow

#: Two-sided 95 % points of Student's t by the number of observations (2.09 below 30 and 1.96 from there on, in t_value).
T95 = {2: 12.71, 3: 4.30, 4: 3.18, 5: 2.78, 6: 2.57, 7: 2.45, 8: 2.36, 9: 2.31, 10: 2.26}


def paired_observations(kpi_calendar: DataFrame, as_of: dt.date | None = None, half_window: int = 56, least: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """Holiday-adjacent property-dates with the median occupancy of the same weekday nearby, none of it holiday-adjacent.

    A range window on the day number, so no self-join. ``as_of`` limits every
    input to dates before it. ``keys`` are further columns of which each value is
    taken by itself.
    """
    k = kpi_calendar.where(F.col("occupancy_bp").isNotNull())
    if as_of is not None:
        k = k.where(F.col("stay_date") < F.lit(as_of))
    w = Window.partitionBy(*keys, "property_key", iso_dow(F.col("stay_date"))).orderBy(F.datediff("stay_date", F.lit(dt.date(1970, 1, 1)))).rangeBetween(-half_window, half_window)
    plain = F.when(~F.col("is_holiday_adjacent"), F.col("occupancy_bp"))
    k = k.select("*", F.percentile(plain, 0.5).over(w).alias("baseline_bp"), F.count(plain).over(w).alias("baseline_obs"))
    return k.where(F.col("is_holiday_adjacent") & F.col("days_to_holiday").isNotNull() & (F.col("baseline_obs") >= least)).select(
        *keys, "property_key", "stay_date", F.col("days_to_holiday").alias("offset"), F.col("nearest_holiday").alias("holiday"), "occupancy_bp", "baseline_bp", "baseline_obs"
    )


def t_value(n: Column) -> Column:
    out = F.when(n < 30, 2.09).otherwise(1.96)
    for k in sorted(T95, reverse=True):
        out = F.when(n == k, T95[k]).otherwise(out)
    return out


def _effects(pairs: DataFrame, *by: str) -> DataFrame:
    d = F.col("occupancy_bp") - F.col("baseline_bp")
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(t_value(F.col("n")) * F.col("sd") / F.sqrt(F.col("n")))
    return s.select(*by, "n", F.round("mean", 3).alias("effect_bp"), F.round(F.col("mean") - half, 3).alias("ci_low_bp"), F.round(F.col("mean") + half, 3).alias("ci_high_bp"))


def offset_profile(pairs: DataFrame, lo: int = -7, hi: int = 10) -> DataFrame:
    """The effect and its 95 % interval at each signed offset."""
    return _effects(pairs.where(F.col("offset").between(lo, hi)), "offset")


def holiday_effects(pairs: DataFrame) -> DataFrame:
    """The effect of each holiday, the years seen and the offset where it is largest; the worst first."""
    by_offset = pairs.groupBy("holiday", "offset").agg(F.avg(F.col("occupancy_bp") - F.col("baseline_bp")).alias("m"))
    peak = by_offset.groupBy("holiday").agg(F.max(F.struct(F.abs(F.round("m", 3)).alias("a"), F.col("offset")))["offset"].alias("peak_offset"))
    years = pairs.groupBy("holiday").agg(F.countDistinct(F.year("stay_date")).alias("occurrences"))
    return _effects(pairs, "holiday").join(peak, "holiday").join(years, "holiday").orderBy("effect_bp", "holiday")


def holiday_multiplier(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(holiday, offset, multiplier): mean ratio to the baseline, for holidays whose interval excludes 0."""
    sure = holiday_effects(pairs).where((F.col("n") >= least) & ((F.col("ci_low_bp") > 0) | (F.col("ci_high_bp") < 0))).select("holiday")
    r = pairs.where(F.col("baseline_bp") > 0).join(F.broadcast(sure), "holiday", "left_semi")
    return r.groupBy("holiday", "offset").agg(F.round(F.avg(F.col("occupancy_bp") / F.col("baseline_bp")), 6).alias("multiplier"))


def generic_multiplier(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(offset, multiplier) pooled over holidays."""
    r = pairs.where(F.col("baseline_bp") > 0)
    return r.groupBy("offset").agg(F.count("*").alias("n"), F.round(F.avg(F.col("occupancy_bp") / F.col("baseline_bp")), 6).alias("multiplier")).where(F.col("n") >= least).select("offset", "multiplier")
