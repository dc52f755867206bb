"""The governed metric registry: each metric is one aggregate over one source, with its grain and date basis."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import bp, rounded_div


@dataclass(frozen=True)
class Metric:
    """``value`` builds the aggregate; ``only`` is the stricter inclusion that ``filtered=True`` applies first."""

    key: str
    source: str
    value: Callable[[], Column]
    grain: str
    date_basis: str
    unit: str
    only: Callable[[], Column] | None = None


def _if(c) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c)


def _sum_if(cond: Column, c: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))


_nightly = lambda: F.coalesce(F.col("stay_type") != "microstay", F.lit(False))
_made = lambda: F.count("*")

METRICS = {
    m.key: m
    for m in (
        Metric("occupancy_bp", "unit_night", lambda: bp(_if("is_occupied"), _if("is_sellable")), "unit-night", "stay_date", "bp"),
        Metric("occupancy_benchmark_bp", "unit_night", lambda: bp(_if("is_occupied"), F.count("*")), "unit-night", "stay_date", "bp"),
        Metric("adr_paise", "unit_night", lambda: rounded_div(F.sum("revenue_paise"), _if("is_occupied")), "unit-night", "stay_date", "paise"),
        Metric("adr_excl_microstay_paise", "unit_night", lambda: rounded_div(_sum_if(_nightly(), "revenue_paise"), _if(F.col("is_occupied") & _nightly())), "unit-night", "stay_date", "paise"),
        Metric("revpar_paise", "unit_night", lambda: rounded_div(F.sum("revenue_paise"), _if("is_sellable")), "unit-night", "stay_date", "paise"),
        Metric("room_revenue_net_paise", "unit_night", lambda: F.sum("revenue_paise"), "unit-night", "stay_date", "paise"),
        Metric("room_revenue_gross_paise", "unit_night", lambda: F.sum("gross_paise"), "unit-night", "stay_date", "paise"),
        Metric("cancellation_rate_bp", "booking", lambda: bp(_if(F.col("status") == "cancelled"), _made()), "booking", "booking_date", "bp"),
        Metric("avg_lead_tenth_days", "booking", lambda: rounded_div(F.sum("lead_days") * 10, _made()), "booking", "booking_date", "tenth of a day", lambda: (F.col("status") != "cancelled") & (F.col("stay_type") == "nightly")),
        Metric("alos_hundredth_nights", "booking", lambda: rounded_div(_sum_if(F.col("stay_type") == "nightly", "nights") * 100, _if(F.col("stay_type") == "nightly")), "booking", "booking_date", "hundredth of a night", lambda: F.col("status") != "cancelled"),
        Metric("service_tat_hundredth_minutes", "request", lambda: rounded_div(F.sum("resolution_minutes") * 100, F.count("resolution_minutes")), "request", "request_date", "hundredth of a minute"),
        Metric("sla_breach_rate_bp", "request", lambda: bp(_if("is_sla_breached"), F.count("resolution_minutes")), "request", "request_date", "bp"),
        Metric("csat_hundredths", "request", lambda: rounded_div(F.sum("csat") * 100, F.count("csat")), "request", "request_date", "hundredth"),
        Metric("wash_rate_bp", "booking", lambda: bp(_if(F.col("status").isin("cancelled", "no_show")), _made()), "booking", "check_in_date", "bp"),
        Metric("revpor_paise", "unit_night", lambda: rounded_div(F.sum("revenue_paise"), _if("is_occupied")), "unit-night", "stay_date", "paise"),
        Metric("cancel_notice_days", "booking", lambda: F.percentile(F.datediff("check_in_date", "cancel_date"), 0.5), "booking", "check_in_date", "days"),
        Metric("pickup_nights", "pickup", lambda: F.sum("nights_added"), "booking-night", "activity_date", "nights"),
    )
}


def metric(df: DataFrame, key: str, by: tuple[str, ...] = (), filtered: bool = False) -> DataFrame:
    """One registered metric over its source, by any columns of it; the value's column has the metric's name."""
    m = METRICS[key]
    df = df.where(m.only()) if filtered and m.only else df
    return df.groupBy(*by).agg(m.value().alias(key))


def channel_mix(nights: DataFrame) -> DataFrame:
    """Each channel's share of occupied nights; the share is taken after the aggregate, over a row per channel."""
    each = nights.where("is_occupied").groupBy("channel_code").agg(F.count("*").alias("nights"))
    total = each.agg(F.sum("nights").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("channel_code", "nights", bp(F.col("nights"), F.col("total")).alias("channel_mix_bp"))


def cost_per_booking(bookings: DataFrame, payments: DataFrame, literal: bool = False) -> DataFrame:
    """Commission, gateway fee and tax on it, by distinct booking, for each channel.

    Payments are summed by booking first, so a booking's commission counts once;
    ``literal`` repeats it for each payment, as a plain join would.
    """
    paid = payments.where("booking_key is not null").select("booking_key", (F.col("fee_paise") + F.col("gst_on_fee_paise")).alias("fees"))
    if not literal:
        paid = paid.groupBy("booking_key").agg(F.sum("fees").alias("fees"))
    cost = F.sum("commission_paise") + F.coalesce(F.sum("fees"), F.lit(0))
    return bookings.join(paid, "booking_key", "left").groupBy("channel_code").agg(rounded_div(cost, F.countDistinct("booking_key")).alias("cost_per_booking_paise"))


def holiday_occupancy_effect(kpi_calendar: DataFrame) -> DataFrame:
    """By signed offset: mean occupancy at it less the mean over dates that are not near a holiday, in hundredths of a point."""
    base = kpi_calendar.where(~F.col("is_holiday_adjacent")).agg(rounded_div(F.sum("occupancy_bp"), F.count("occupancy_bp")).alias("base_bp"))
    near = kpi_calendar.where("is_holiday_adjacent").groupBy("days_to_holiday").agg(rounded_div(F.sum("occupancy_bp"), F.count("occupancy_bp")).alias("near_bp"))
    return near.crossJoin(F.broadcast(base)).select("days_to_holiday", (F.col("near_bp") - F.col("base_bp")).alias("effect_bp"))
