"""Business dates, parts of the day, the date dimension and calendar context."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def business_date(ts: Column, offset_minutes: int = 330) -> Column:
    """The calendar date at a fixed offset from UTC (by default +05:30) of a UTC instant."""
    return (ts.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(offset_minutes))).cast("date")


def local_hour(ts: Column, offset_minutes: int = 330) -> Column:
    return F.hour(ts.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(offset_minutes)))


def day_part(ts: Column, offset_minutes: int = 330) -> Column:
    """morning 6-11, afternoon 12-17, evening 18-23, else overnight, by local hour."""
    h = local_hour(ts, offset_minutes)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h >= 18, "evening").otherwise("overnight")


def iso_dow(d: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(d) + 1


def minutes_between(late: Column, early: Column) -> Column:
    return (F.unix_seconds(late.cast("timestamp")) - F.unix_seconds(early.cast("timestamp"))) / 60.0


def date_drift(df: DataFrame, stored: str, ts: str) -> DataFrame:
    """Rows whose stored date is not the business date of the instant: rows, stored days, from, to."""
    return df.where(F.col(stored) != business_date(F.col(ts))).agg(
        F.count("*").alias("drifted_rows"), F.countDistinct(stored).alias("days_affected"), F.min(stored).alias("from_date"), F.max(stored).alias("to_date")
    )


def dim_date(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day, from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"), iso_dow(d).alias("iso_dow"), F.weekofyear(d).alias("iso_week"),
        (iso_dow(d) >= 6).alias("is_weekend"), (iso_dow(d) <= 4).alias("is_business_night"), F.date_sub(d, 364).alias("same_day_last_year"),
    )


def calendar_context(dates: DataFrame, holidays: DataFrame, radius: int = 7) -> DataFrame:
    """``dates`` (full_date) with the nearest holiday and what follows from it.

    ``holidays`` has holiday_date and holiday_name (one row per date). The signed
    offset is negative before a holiday and a tie takes the earlier one. A bridge
    day is a working day between two non-working ones; a long weekend is a run of
    three or more non-working days. Dates are calendar-sized, so single-partition
    windows are safe here.
    """
    h = F.broadcast(holidays.select("holiday_date", "holiday_name"))
    # holidays outside the dates count as neighbours, so they join in until the nearest is known
    day = dates.select("full_date", F.lit(True).alias("asked")).unionByName(holidays.select(F.col("holiday_date").alias("full_date"), F.lit(False).alias("asked")))
    day = day.groupBy("full_date").agg(F.max("asked").alias("asked")).join(h, F.col("full_date") == F.col("holiday_date"), "left")
    order = Window.orderBy("full_date")
    found = F.when(F.col("holiday_date").isNotNull(), F.struct(F.col("holiday_date").alias("d"), F.col("holiday_name").alias("n")))
    day = day.withColumn("before", F.last(found, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    day = day.withColumn("after", F.first(found, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("asked")
    gap_before, gap_after = F.datediff("full_date", F.col("before.d")), F.datediff(F.col("after.d"), F.col("full_date"))
    take_before = F.col("after").isNull() | (gap_before <= gap_after)
    day = day.withColumn("nearest", F.when(F.col("before").isNotNull() & take_before, F.col("before")).otherwise(F.col("after")))
    off = (iso_dow(F.col("full_date")) >= 6) | F.col("holiday_date").isNotNull()
    day = day.withColumn("off", off)
    day = day.withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy("off").orderBy("full_date")))
    day = day.withColumn("run_days", F.count("*").over(Window.partitionBy("off", "run")))
    day = day.withColumn("is_bridge_day", ~F.col("off") & F.coalesce(F.lag("off").over(order), F.lit(False)) & F.coalesce(F.lead("off").over(order), F.lit(False)))
    offset = F.datediff(F.col("full_date"), F.col("nearest.d"))
    return day.select(
        "full_date", F.col("holiday_date").isNotNull().alias("is_public_holiday"), F.col("nearest.n").alias("nearest_holiday"), offset.alias("days_to_holiday"),
        F.coalesce(F.abs(offset) <= radius, F.lit(False)).alias("is_holiday_adjacent"), "is_bridge_day", (F.col("off") & (F.col("run_days") >= 3)).alias("is_long_weekend"),
    )
