"""The two grains: booking-nights (demand) and unit-nights (inventory), and their tax and identity columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import int_div, rounded_div

GONE = ("cancelled", "no_show")


def normalised_guests(guests: DataFrame) -> DataFrame:
    """Contact data in one form: lower-case email without dots in its local part, the last ten digits of the phone."""
    return guests.select(
        "*", F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10)).alias("phone_last10"), F.regexp_replace(F.lower("email"), r"\.(?=[^@]*@)", "").alias("email_normalised")
    )


def identity_key() -> Column:
    """Phone, else email, else the guest's key; blanks count as missing, so they cannot pile up on one key."""
    return F.coalesce(F.nullif(F.col("phone_last10"), F.lit("")), F.nullif(F.col("email_normalised"), F.lit("")), F.col("guest_key").cast("string"))


def booking_nights(bookings: DataFrame) -> DataFrame:
    """One row per night of [check_in, check_out), whatever the status; zero-night bookings have none."""
    nights = bookings.where(F.col("check_out_date") > F.col("check_in_date"))  # sequence() would count down
    out = nights.withColumn("stay_date", F.explode(F.sequence("check_in_date", F.date_sub("check_out_date", 1))))
    return out.select(
        "booking_key", "property_key", "unit_key", "channel_code", "guest_key", "stay_date", F.col("booking_date").alias("entered_on"), F.col("cancel_date").alias("left_on"), "status", "stay_type", "nights",
        F.datediff("stay_date", "booking_date").cast("long").alias("days_to_arrival"), (F.datediff("stay_date", "check_in_date") + 1).cast("long").alias("night_index"),
        int_div(F.col("net_paise"), F.col("nights")).alias("night_paise"), int_div(F.col("commission_paise"), F.col("nights")).alias("night_commission_paise"),
    )


def unit_nights(units: DataFrame, bookings: DataFrame, start: dt.date, end: dt.date, out_of_order: Column | None = None) -> DataFrame:
    """A dense unit x date grid with the first live booking (least key) of each unit-night placed on it.

    A microstay holds its arrival date. Revenue is split evenly over a booking's
    nights. An out-of-order night is not sellable and takes no booking.
    ``out_of_order`` is a condition on unit_key and stay_date. The placement is an
    aggregate (min of a struct), so it combines map-side, and the grid joins on
    the same key. The grid is hinted away from a broadcast: Spark reckons an
    exploded row as one, so it takes the grid for as small as ``units``.
    """
    live = bookings.where(~F.col("status").isin(*GONE))
    last = F.when(F.col("nights") > 0, F.date_sub("check_out_date", 1)).otherwise(F.col("check_in_date"))
    per_night = F.greatest("nights", F.lit(1))
    held = live.select(
        "unit_key", F.explode(F.sequence("check_in_date", last)).alias("stay_date"),
        F.struct("booking_key", "channel_code", "stay_type", int_div(F.col("net_paise"), per_night).alias("revenue_paise"), int_div(F.col("commission_paise"), per_night).alias("commission_paise")).alias("b"),
    )
    placed = held.groupBy("unit_key", "stay_date").agg(F.min("b").alias("b"))
    grid = units.select("unit_key", "property_key").withColumn("stay_date", F.explode(F.sequence(F.lit(start), F.lit(end))))
    ooo = F.coalesce(out_of_order, F.lit(False)) if out_of_order is not None else F.lit(False)
    grid = grid.withColumn("is_out_of_order", ooo)
    n = grid.hint("merge").join(placed, ["unit_key", "stay_date"], "left")
    free = ~F.col("is_out_of_order")
    keep = lambda c: F.when(free, F.col(f"b.{c}"))
    return n.select(
        "unit_key", "property_key", "stay_date", keep("booking_key").alias("booking_key"), keep("channel_code").alias("channel_code"), free.alias("is_sellable"),
        (free & F.col("b.booking_key").isNotNull()).alias("is_occupied"), "is_out_of_order", keep("stay_type").alias("stay_type"),
        F.coalesce(keep("revenue_paise"), F.lit(0)).alias("revenue_paise"), F.coalesce(keep("commission_paise"), F.lit(0)).alias("commission_paise"),
    )


def every_fiftieth_night_out(start: dt.date) -> Column:
    """The out-of-order rule of the adapted tables."""
    return (F.col("unit_key") * 31 + F.datediff("stay_date", F.lit(start))) % 50 == 0


def with_tax(df: DataFrame, day: str, amount: str, rates: DataFrame, threshold: int) -> DataFrame:
    """``df`` with gst_pct: by the rate in force on ``day`` and whether ``amount`` is above the threshold."""
    r = F.broadcast(rates)  # a row per change of the law
    d = F.col(day)
    joined = df.join(r, (d >= r["effective_from"]) & (r["effective_to"].isNull() | (d <= r["effective_to"])), "left")
    pct = F.when(F.col(amount) > threshold, F.col("rate_above")).otherwise(F.col("rate_at_or_below"))
    return joined.withColumn("gst_pct", pct).drop("effective_from", "effective_to", "rate_at_or_below", "rate_above")


def enriched(nights: DataFrame, rates: DataFrame, threshold: int) -> DataFrame:
    """Unit-nights with tax, gross revenue and revenue after commission."""
    out = with_tax(nights, "stay_date", "revenue_paise", rates, threshold)
    out = out.withColumn("gst_paise", rounded_div(F.col("revenue_paise") * F.col("gst_pct"), 100))
    return out.withColumn("gross_paise", F.col("revenue_paise") + F.col("gst_paise")).withColumn("net_after_commission_paise", F.col("revenue_paise") - F.col("commission_paise"))


def on_books_intervals(nights: DataFrame, max_horizon: int) -> DataFrame:
    """``nights`` with lo and hi: the horizons (days before the stay) at which each night is on the books.

    A night is on the books at horizon h if it was entered by stay - h and had not
    left by then, which is one interval of h. So an as-of count at every horizon
    is a count of intervals and needs no join with two inequalities.
    """
    lo = F.greatest(F.lit(0), F.coalesce(F.datediff("stay_date", "left_on") + 1, F.lit(0)))
    hi = F.least(F.lit(max_horizon), F.datediff("stay_date", "entered_on"))
    return nights.withColumn("lo", lo).withColumn("hi", hi).where(F.col("lo") <= F.col("hi"))


def books_by_horizon(nights: DataFrame, dates: DataFrame, max_horizon: int, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """(keys, stay_date, days_out, on_books) for every row of ``dates`` (keys, stay_date) and horizon 0..max, zeros included."""
    on = [*keys, "stay_date"]
    spans = on_books_intervals(nights.join(dates.select(*on), on, "left_semi"), max_horizon)
    counts = spans.select(*on, F.explode(F.sequence("lo", "hi")).alias("days_out")).groupBy(*on, "days_out").agg(F.count("*").alias("on_books"))
    grid = dates.select(*on, F.explode(F.sequence(F.lit(0), F.lit(max_horizon))).alias("days_out"))
    return grid.join(counts, [*on, "days_out"], "left").select(*on, "days_out", F.coalesce("on_books", F.lit(0)).alias("on_books"))
