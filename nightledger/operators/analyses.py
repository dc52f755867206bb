"""The curated analyses: variance and mix decomposition, concentration, channel economics, cohorts, reconciliation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import bp, rounded_div
from .grain import identity_key, normalised_guests


def revenue_variance(kpi: DataFrame) -> DataFrame:
    """Monthly RevPAR change split into rate and volume by the symmetric (Shapley) rule, which leaves no residual.

    RevPAR = revenue / available = ADR x occupancy; doubles, rounded to six places.
    """
    m = kpi.groupBy(F.date_format("stay_date", "yyyy-MM").alias("year_month")).agg(F.sum("sold").alias("sold"), F.sum("available").alias("available"), F.sum("revenue_paise").alias("revenue"))
    m = m.select("year_month", (F.col("sold") / F.col("available")).alias("occ"), F.coalesce(F.col("revenue") / F.nullif(F.col("sold"), F.lit(0)), F.lit(0.0)).alias("adr"), (F.col("revenue") / F.col("available")).alias("revpar"))
    w = Window.orderBy("year_month")  # a row per month
    m = m.select("*", *[F.lag(c).over(w).alias(f"{c}0") for c in ("occ", "adr", "revpar")])
    rate = (F.col("adr") - F.col("adr0")) * (F.col("occ") + F.col("occ0")) / 2
    volume = (F.col("occ") - F.col("occ0")) * (F.col("adr") + F.col("adr0")) / 2
    change = F.col("revpar") - F.col("revpar0")
    driver = F.when(change.isNull(), "baseline month").when(F.abs(F.round(rate, 4)) > F.abs(F.round(volume, 4)), "rate-driven").otherwise("volume-driven")
    return m.select("year_month", F.round("revpar", 4).alias("revpar"), F.round(change, 4).alias("change"), F.round(rate, 4).alias("rate_effect"), F.round(volume, 4).alias("volume_effect"), F.round(F.abs(change - rate - volume), 3).alias("residual"), driver.alias("primary_driver"))


def rate_or_mix(nights: DataFrame, start: dt.date, end: dt.date, before_days: int = 60) -> DataFrame:
    """ADR change by channel between a window and the days before it, with a total row."""
    n = nights.where(F.col("is_occupied") & F.col("stay_date").between(start - dt.timedelta(before_days), end))
    after = F.col("stay_date") >= F.lit(start)
    by = n.groupBy("channel_code").agg(*[x for w, era in (("before", ~after), ("after", after)) for x in (F.count_if(era).alias(f"n_{w}"), F.sum(F.when(era, F.col("revenue_paise"))).alias(f"r_{w}"))])
    total = F.broadcast(by.agg(F.sum("n_before").alias("t_before"), F.sum("n_after").alias("t_after")))
    by = by.crossJoin(total)
    share = {w: F.col(f"n_{w}") / F.nullif(F.col(f"t_{w}"), F.lit(0)) for w in ("before", "after")}
    adr = {w: F.coalesce(F.col(f"r_{w}") / F.nullif(F.col(f"n_{w}"), F.lit(0)), F.lit(0.0)) for w in ("before", "after")}
    by = by.select("channel_code", share["before"].alias("s0"), share["after"].alias("s1"), adr["before"].alias("a0"), adr["after"].alias("a1"))
    by = by.withColumn("rate", F.col("s0") * (F.col("a1") - F.col("a0"))).withColumn("mix", (F.col("s1") - F.col("s0")) * F.col("a0"))
    total = by.agg(F.lit("TOTAL").alias("channel_code"), *[F.sum(c).alias(c) for c in ("s0", "s1")], F.lit(None).cast("double").alias("a0"), F.lit(None).cast("double").alias("a1"), F.sum("rate").alias("rate"), F.sum("mix").alias("mix"))
    out = by.unionByName(total)
    r = lambda c, n: F.round(c, 3).alias(n)
    return out.select("channel_code", r(100 * F.col("s0"), "share_before_pct"), r(100 * F.col("s1"), "share_after_pct"), r("a0", "adr_before"), r("a1", "adr_after"), r("rate", "rate_effect"), r("mix", "mix_effect"))


def sla_concentration(service: DataFrame, least: int = 20, act: int = 40, gap_bp: int = 1500, top: int = 15) -> DataFrame:
    """Where breaches concentrate: cells against their team's baseline, ranked, with a verdict."""
    s = service.where("resolution_minutes is not null").groupBy("property_key", "owning_team", "day_part").agg(F.count("*").alias("requests"), F.count_if("is_sla_breached").alias("breaches")).where(F.col("requests") >= least)
    team = Window.partitionBy("owning_team")
    s = s.withColumn("breach_bp", bp(F.col("breaches"), F.col("requests"))).withColumn("team_bp", bp(F.sum("breaches").over(team), F.sum("requests").over(team)))
    s = s.withColumn("breach_rank", F.rank().over(Window.orderBy(F.desc("breach_bp")))).withColumn("vs_baseline_bp", F.col("breach_bp") - F.col("team_bp"))  # a row per cell
    far = F.col("vs_baseline_bp") >= gap_bp
    s = s.withColumn("verdict", F.when(far & (F.col("requests") >= act), "ACT").when(far, "WATCH").otherwise("normal"))
    return s.orderBy("breach_rank", "property_key", "owning_team", "day_part").limit(top)


def channel_economics(bookings: DataFrame, nights: DataFrame, payments: DataFrame) -> DataFrame:
    """Booking, stay and payment sides of each channel, each summed before they meet."""
    b = bookings.groupBy("channel_code").agg(F.count("*").alias("made"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), rounded_div(F.sum("lead_days") * 10, F.count("*")).alias("lead_tenths"))
    s = nights.where("is_occupied").groupBy("channel_code").agg(F.count("*").alias("room_nights"), F.sum("revenue_paise").alias("revenue_paise"), F.sum("commission_paise").alias("commission_paise"))
    paid = payments.where("booking_key is not null").join(bookings.select("booking_key", "channel_code"), "booking_key")
    f = paid.groupBy("channel_code").agg(F.sum(F.col("fee_paise") + F.col("gst_on_fee_paise")).alias("gateway_paise"))
    out = b.join(s, "channel_code").join(f, "channel_code", "left").withColumn("gateway_paise", F.coalesce("gateway_paise", F.lit(0)))
    out = out.crossJoin(F.broadcast(s.agg(F.sum("room_nights").alias("all_nights"))))
    tax = rounded_div(F.col("commission_paise") * 18, 100)
    cost = F.col("commission_paise") + tax + F.col("gateway_paise")
    return out.select(
        "channel_code", "made", bp(F.col("cancelled"), F.col("made")).alias("cancel_bp"), "lead_tenths", "room_nights", bp(F.col("room_nights"), F.col("all_nights")).alias("share_bp"), "revenue_paise",
        rounded_div(F.col("revenue_paise"), F.col("room_nights")).alias("adr_paise"), tax.alias("gst_on_commission_paise"), "gateway_paise", rounded_div(F.col("revenue_paise") - cost, F.col("room_nights")).alias("net_per_night_paise"),
        rounded_div(cost, F.col("made") - F.col("cancelled")).alias("cost_per_booking_paise"), bp(cost, F.col("revenue_paise")).alias("cost_bp"),
    )


def repeat_cohorts(bookings: DataFrame, guests: DataFrame, least: int = 30) -> DataFrame:
    """Guests by the channel of their first stay: how many return, how soon, and what they are worth.

    The gaps between an identity's stays, which are never negative, add up to the days
    from its first stay to its last, so aggregates that combine map-side are enough:
    an identity with thousands of stays is no task of its own.
    """
    who = normalised_guests(guests).select("guest_key", identity_key().alias("identity_key"))
    s = bookings.where(F.col("status").isin("checked_out", "checked_in")).join(who, "guest_key")
    dated = F.count("check_in_date")
    per = s.groupBy("identity_key").agg(
        F.min(F.struct("check_in_date", "booking_key", "channel_code"))["channel_code"].alias("acquiring_channel"), F.count("*").alias("stays"), F.sum("net_paise").alias("lifetime_paise"),
        F.when(dated > 1, rounded_div(F.datediff(F.max("check_in_date"), F.min("check_in_date")), F.nullif(dated - 1, F.lit(0)))).alias("gap_days"),
    )
    c = per.groupBy("acquiring_channel").agg(
        F.count("*").alias("guests"), F.count_if(F.col("stays") >= 2).alias("returned"), bp(F.count_if(F.col("stays") >= 2), F.count("*")).alias("repeat_bp"), rounded_div(F.sum("stays") * 100, F.count("*")).alias("stays_hundredths"),
        rounded_div(F.sum("gap_days"), F.count("gap_days")).alias("days_between"), rounded_div(F.sum("lifetime_paise"), F.count("*")).alias("lifetime_paise"),
    )
    return c.where(F.col("guests") >= least).withColumn("value_quartile", F.ntile(4).over(Window.orderBy("lifetime_paise", "acquiring_channel")))


def payment_reconciliation(payments: DataFrame, bookings: DataFrame) -> DataFrame:
    """Payments by reason of variance. Rows without a booking never meet the join, so nulls cannot pile up in one task."""
    known, lost = payments.where("booking_key is not null"), payments.where("booking_key is null")
    known = known.join(bookings.select("booking_key", F.col("net_paise").alias("folio_paise")), "booking_key", "left")
    typed = known.unionByName(lost.withColumn("folio_paise", F.lit(None).cast("long")))
    off = F.abs(F.col("gross_paise") - F.col("folio_paise")) > 100
    code = F.when(F.col("booking_key").isNull(), "UNRESOLVED_REFERENCE").when(off, "AMOUNT_MISMATCH").when(F.col("settlement_date").isNull(), "TIMING_UNSETTLED").otherwise("MATCHED")
    out = typed.groupBy(code.alias("variance_code")).agg(
        F.count("*").alias("payments"), F.sum("gross_paise").alias("gross_paise"), F.sum("folio_paise").alias("folio_paise"), F.sum("fee_paise").alias("fee_paise"), F.sum("gst_on_fee_paise").alias("gst_on_fee_paise"), F.sum("credited_paise").alias("credited_paise"),
        F.coalesce(F.sum(F.when(F.col("booking_key").isNotNull(), F.col("gross_paise") - F.col("folio_paise"))), F.lit(0)).alias("unexplained_paise"),
    )
    total = F.broadcast(out.agg(F.sum("payments").alias("total")))
    return out.crossJoin(total).withColumn("share_bp", bp(F.col("payments"), F.col("total"))).drop("total")


def unpaid_bookings(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Bookings with no payment."""
    return bookings.join(payments.where("booking_key is not null").select("booking_key"), "booking_key", "left_anti").select("booking_key", "status", "net_paise")
