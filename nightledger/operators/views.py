"""The semantic layer: governed views over the two grains."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import business_date, day_part, iso_dow, local_hour
from ..functions.money import bp, int_div, rounded_div
from .grain import books_by_horizon, identity_key, normalised_guests

STAYED = ("checked_out", "confirmed")


def _count(cond):
    return F.count_if(cond)


def daily_kpi(nights: DataFrame, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """Counts, sums and ratios by stay date and ``keys``; a ratio is null where its denominator is 0."""
    sums = nights.groupBy(*keys, "stay_date").agg(
        F.count("*").alias("physical"), _count(F.col("is_sellable")).alias("available"), _count(F.col("is_out_of_order")).alias("out_of_order"), _count(F.col("is_occupied")).alias("sold"),
        _count(F.col("is_occupied") & (F.col("stay_type") == "microstay")).alias("microstay_sold"), F.sum("revenue_paise").alias("revenue_paise"), F.sum("gross_paise").alias("gross_paise"),
        F.sum("gst_paise").alias("gst_paise"), F.sum("commission_paise").alias("commission_paise"), F.coalesce(F.sum(F.when(F.col("stay_type") != "microstay", F.col("revenue_paise"))), F.lit(0)).alias("nightly_revenue_paise"),
    )
    return with_rates(sums)


def with_rates(sums: DataFrame) -> DataFrame:
    """The ratios of summed counts: never an average of ratios."""
    sold, available, revenue = F.col("sold"), F.col("available"), F.col("revenue_paise")
    return sums.select(
        "*", bp(sold, available).alias("occupancy_bp"), bp(sold, F.col("physical")).alias("occupancy_benchmark_bp"), (bp(sold, available) - bp(sold, F.col("physical"))).alias("ooo_gap_bp"),
        rounded_div(revenue, sold).alias("adr_paise"), rounded_div(F.col("nightly_revenue_paise"), sold - F.col("microstay_sold")).alias("adr_excl_microstay_paise"), rounded_div(revenue, available).alias("revpar_paise"),
    )


def booking_kpi(bookings: DataFrame) -> DataFrame:
    """Bookings at their booking date, with the date derived again from the instant."""
    derived = business_date(F.col("booked_at"))
    return bookings.select(
        "booking_key", "property_key", "channel_code", "booking_date", derived.alias("derived_date"), (derived != F.col("booking_date")).alias("is_drifted"), (F.col("status") == "cancelled").alias("is_cancelled"),
        (F.col("net_paise") - F.col("commission_paise")).alias("net_after_commission_paise"), int_div(F.col("net_paise"), F.greatest("nights", F.lit(1))).alias("nightly_rate_paise"),
    )


def service_kpi(requests: DataFrame) -> DataFrame:
    """Requests with their local hour and part of the day."""
    return requests.withColumn("local_hour", local_hour(F.col("created_at"))).withColumn("day_part", day_part(F.col("created_at")))


def guest_repeat(bookings: DataFrame, guests: DataFrame) -> DataFrame:
    """Guests and those with two stays or more, by stored guest and by resolved identity."""
    stays = bookings.where(F.col("status").isin("checked_out", "checked_in")).select("guest_key")
    who = stays.join(normalised_guests(guests), "guest_key", "left").select("guest_key", identity_key().alias("identity_key"))

    def rate(basis, key):
        each = who.groupBy(key).agg(F.count("*").alias("stays"))
        return each.agg(F.count("*").alias("guests"), F.count_if(F.col("stays") >= 2).alias("repeat_guests")).select(F.lit(basis).alias("basis"), "guests", "repeat_guests", bp(F.col("repeat_guests"), F.col("guests")).alias("repeat_rate_bp"))

    return rate("raw", "guest_key").unionByName(rate("resolved", "identity_key"))


def on_the_books(nights: DataFrame, as_of: dt.date) -> DataFrame:
    """Nights entered by the date, not left by it, and still to come; by stay date, property and channel."""
    d = F.lit(as_of)
    held = nights.where((F.col("entered_on") <= d) & (F.col("stay_date") > d) & (F.col("left_on").isNull() | (F.col("left_on") > d)))
    return held.groupBy("stay_date", "property_key", "channel_code").agg(F.count("*").alias("nights_otb"), F.sum("night_paise").alias("revenue_otb_paise")).withColumn("days_out", F.datediff("stay_date", d).cast("long"))


def on_the_books_many(nights: DataFrame, as_of: DataFrame) -> DataFrame:
    """The same for every date of ``as_of`` (a column of that name), by property: one sweep, whatever the number of dates.

    A night is held from the day it was entered until it was left or came. Both
    events are added up by property and day, and the running sums are read off at
    the dates asked for.
    """
    end = F.least(F.coalesce("left_on", "stay_date"), "stay_date")
    event = F.explode(F.array(F.struct(F.col("entered_on").alias("d"), F.lit(1).alias("n")), F.struct(end.alias("d"), F.lit(-1).alias("n")))).alias("e")
    e = nights.where(F.col("entered_on") < end).select("property_key", "night_paise", event)
    daily = e.groupBy("property_key", F.col("e.d").alias("as_of")).agg(F.sum("e.n").alias("n"), F.sum(F.col("e.n") * F.col("night_paise")).alias("paise")).withColumn("asked", F.lit(False))
    asked = daily.select("property_key").distinct().crossJoin(F.broadcast(as_of.select("as_of").distinct())).select("property_key", "as_of", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("paise"), F.lit(True).alias("asked"))
    # a row a property and day; rows of one day count together
    upto = Window.partitionBy("property_key").orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = daily.unionByName(asked).withColumn("nights_otb", F.sum("n").over(upto)).withColumn("revenue_otb_paise", F.sum("paise").over(upto))
    return swept.where("asked and nights_otb > 0").select("as_of", "property_key", "nights_otb", "revenue_otb_paise")


def pickup_daily(nights: DataFrame) -> DataFrame:
    """Nights added and cancelled by activity date, stay date, property and channel: one aggregate over both events."""
    keys = ["activity_date", "stay_date", "property_key", "channel_code"]
    event = F.explode(F.array(F.struct(F.col("entered_on").alias("d"), F.lit(1).alias("add")), F.struct(F.col("left_on").alias("d"), F.lit(0).alias("add"))))
    e = nights.select("stay_date", "property_key", "channel_code", "night_paise", event.alias("e")).where("e.d is not null").withColumn("activity_date", F.col("e.d"))
    added = F.col("e.add") == 1
    out = e.groupBy(*keys).agg(
        F.count_if(added).alias("nights_added"), F.count_if(~added).alias("nights_cancelled"), F.coalesce(F.sum(F.when(added, F.col("night_paise"))), F.lit(0)).alias("revenue_added_paise"),
        F.coalesce(F.sum(F.when(~added, F.col("night_paise"))), F.lit(0)).alias("revenue_cancelled_paise"),
    )
    return out.withColumn("nights_net", F.col("nights_added") - F.col("nights_cancelled")).withColumn("days_before_stay", F.datediff("stay_date", "activity_date").cast("long"))


def books_with_final(nights: DataFrame, max_horizon: int = 60) -> DataFrame:
    """By property, stay date and days out: nights on the books then, and in the final book."""
    final = nights.where(F.col("status").isin(*STAYED)).groupBy("property_key", "stay_date").agg(F.count("*").alias("final_nights"))
    return books_by_horizon(nights, final, max_horizon).join(final, ["property_key", "stay_date"])


def booking_curve(nights: DataFrame, max_horizon: int = 60) -> DataFrame:
    """By property and days out: how much of the final book was sold, as average and quartiles."""
    books = books_with_final(nights, max_horizon)
    share = F.col("on_books") / F.col("final_nights")
    pct = lambda q: F.round(100 * F.percentile(share, q), 6)
    return books.groupBy("property_key", "days_out").agg(
        F.count("*").alias("stay_dates"), F.sum("on_books").alias("nights_on_books"), F.sum("final_nights").alias("final_nights"), pct(0.5).alias("median_pct_sold"), pct(0.25).alias("p25_pct_sold"), pct(0.75).alias("p75_pct_sold")
    )


def lead_time_profile(bookings: DataFrame, channels: DataFrame) -> DataFrame:
    """The distribution of lead time by channel."""
    lead = F.col("lead_days")
    out = bookings.join(F.broadcast(channels), "channel_code").groupBy("channel_code", "channel_type").agg(
        F.count("*").alias("bookings"), rounded_div(F.sum(lead) * 10, F.count("*")).alias("mean_tenth_days"), *[F.percentile(lead, q / 100).alias(f"p{q}_days") for q in (25, 50, 75, 90)],
        bp(F.count_if(lead == 0), F.count("*")).alias("same_day_bp"), bp(F.count_if(lead >= 30), F.count("*")).alias("month_ahead_bp"), bp(F.count_if(F.col("status") == "cancelled"), F.count("*")).alias("cancel_bp"),
    )
    return out


def cancellation_funnel(bookings: DataFrame) -> DataFrame:
    """Made, cancelled, no-show and stayed by month of stay, property and channel, with the median notice."""
    status, n = F.col("status"), F.count("*")
    return bookings.groupBy(F.trunc("check_in_date", "month").alias("stay_month"), "property_key", "channel_code").agg(
        n.alias("made"), F.count_if(status == "cancelled").alias("cancelled"), F.count_if(status == "no_show").alias("no_show"), F.count_if(status.isin(*STAYED)).alias("stayed"),
        bp(F.count_if(status == "cancelled"), n).alias("cancel_bp"), bp(F.count_if(status == "no_show"), n).alias("no_show_bp"), bp(F.count_if(status.isin("cancelled", "no_show")), n).alias("wash_bp"),
        F.percentile(F.when(F.col("cancel_date").isNotNull(), F.datediff("check_in_date", "cancel_date")), 0.5).alias("median_notice_days"),
    )


def wash_by_channel(funnel: DataFrame) -> DataFrame:
    """The funnel's sums by channel, rates taken anew from them."""
    s = funnel.groupBy("channel_code").agg(*[F.sum(c).alias(c) for c in ("made", "cancelled", "no_show", "stayed")])
    return s.withColumn("wash_bp", bp(F.col("cancelled") + F.col("no_show"), F.col("made")))


def microstay_impact(bookings: DataFrame, nights: DataFrame) -> DataFrame:
    """Zero-night bookings by channel; one that holds several unit-nights counts its money for each."""
    held = nights.where("is_occupied").select(F.col("booking_key").alias("held"), "unit_key")
    b = bookings.where(F.col("check_out_date") == F.col("check_in_date")).join(held, F.col("booking_key") == F.col("held"), "left")
    return b.groupBy("channel_code").agg(F.count("*").alias("bookings"), F.sum("net_paise").alias("revenue_paise"), F.count("held").alias("unit_nights"), rounded_div(F.sum("net_paise"), F.count("*")).alias("avg_value_paise"))


def grain_reconciliation(demand: DataFrame, inventory: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """exploded - unallocated + hourly = occupied, with all four terms."""
    e = demand.where(F.col("status").isin(*STAYED) & F.col("stay_date").between(start, end)).groupBy("booking_key").agg(F.count("*").alias("e"))
    m = inventory.where("is_occupied").groupBy("booking_key").agg(F.count("*").alias("m"))
    both = e.join(m, "booking_key", "full_outer")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        zero("e").alias("exploded"), zero("m").alias("occupied"), zero(F.when(F.col("e").isNotNull(), F.greatest(F.col("e") - F.coalesce("m", F.lit(0)), F.lit(0)))).alias("unallocated"), zero(F.when(F.col("e").isNull(), F.col("m"))).alias("hourly")
    )


def daily_kpi_calendar(kpi: DataFrame, context: DataFrame) -> DataFrame:
    """Daily KPI with the calendar's columns."""
    return kpi.join(F.broadcast(context), kpi["stay_date"] == context["full_date"]).drop("full_date").withColumn("iso_dow", iso_dow(F.col("stay_date")))


def buried_complaints(aspects: DataFrame, reviews: DataFrame, half_stars: int = 8) -> DataFrame:
    """Verified negative aspects in reviews that rate well, the severe first and then the newest."""
    rank = F.when(F.col("severity") == "severe", 0).when(F.col("severity") == "moderate", 1).otherwise(2)
    bad = aspects.where((F.col("polarity") == "negative") & F.col("evidence_verified"))
    good = reviews.where(F.col("half_stars") >= half_stars).select("review_id", "property_key", "review_date", "half_stars")
    return bad.join(good, "review_id").withColumn("severity_rank", rank).orderBy("severity_rank", F.desc("review_date"), "review_id", "category")
