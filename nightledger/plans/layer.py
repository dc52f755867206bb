"""Queries of the grain builders and the semantic layer (D, V)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import grain, views
from ..sources.adapter import END, START, TAX_THRESHOLD, Model
from .base import bp, rdiv, sql

AS_OF = dt.date(1998, 6, 1)


def unit_nights(m: Model):
    return grain.unit_nights(m.units(), m.bookings(), START, END, grain.every_fiftieth_night_out(START))


def enriched(m: Model):
    return grain.enriched(unit_nights(m), m.tax_rates(), TAX_THRESHOLD)


def demand(m: Model):
    return grain.booking_nights(m.bookings())


def daily(m: Model):
    return views.daily_kpi(enriched(m))


def context(m: Model):
    days = m.spark.range(1).select(F.explode(F.sequence(F.lit(START), F.lit(END))).alias("full_date"))
    return dates.calendar_context(days, m.holidays())


RATES = f"""{bp("sold", "available")} AS occupancy_bp, {bp("sold", "physical")} AS occupancy_benchmark_bp, {bp("sold", "available")} - {bp("sold", "physical")} AS ooo_gap_bp,
 {rdiv("revenue_paise", "sold")} AS adr_paise, {rdiv("nightly_revenue_paise", "sold - microstay_sold")} AS adr_excl_microstay_paise, {rdiv("revenue_paise", "available")} AS revpar_paise"""


def books_sql(dates_cte: str, max_horizon: int) -> str:
    """The as-of count at every horizon, written as the plain join with two inequalities."""
    return f"""SELECT f.property_key, f.stay_date, h.days_out, count(n.booking_key) AS on_books FROM {dates_cte} f CROSS JOIN (SELECT CAST(x AS INT) AS days_out FROM range(0, {max_horizon + 1}) t(x)) h
    LEFT JOIN booking_night n ON n.stay_date = f.stay_date AND n.property_key = f.property_key AND n.entered_on <= f.stay_date - h.days_out AND (n.left_on IS NULL OR n.left_on > f.stay_date - h.days_out) GROUP BY ALL"""


def _quantile(q):
    return f"round(100 * quantile_cont(on_books / final_nights, {q}), 6)"


QUERIES = {
    "d1_business_date": (
        lambda m: m.bookings().select("booking_key", dates.business_date(F.col("booked_at")).alias("business_date"), dates.local_hour(F.col("booked_at")).alias("local_hour"), dates.day_part(F.col("booked_at")).alias("day_part")),
        sql("""SELECT booking_key, CAST(t AS DATE) AS business_date, CAST(hour(t) AS INT) AS local_hour, CASE WHEN hour(t) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(t) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(t) >= 18 THEN 'evening' ELSE 'overnight' END AS day_part
        FROM (SELECT booking_key, booked_at + INTERVAL 330 MINUTE AS t FROM booking)""", "booking"),
    ),
    "d2_date_drift": (
        lambda m: dates.date_drift(m.bookings(), "booking_date", "booked_at"),
        sql("SELECT count(*) AS drifted_rows, count(DISTINCT booking_date) AS days_affected, min(booking_date) AS from_date, max(booking_date) AS to_date FROM booking WHERE booking_date <> CAST(booked_at + INTERVAL 330 MINUTE AS DATE)", "booking"),
    ),
    "d4_dim_date": (
        # the days between the first and the last order
        lambda m: dates.dim_date(m.spark, *m.raw("orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()),
        """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, monthname(d) AS month_name, strftime(d, '%Y-%m') AS year_month, CAST(isodow(d) AS INT) AS iso_dow,
        CAST(week(d) AS INT) AS iso_week, isodow(d) >= 6 AS is_weekend, isodow(d) <= 4 AS is_business_night, d - 364 AS same_day_last_year
        FROM (SELECT CAST(unnest(generate_series(CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""",
    ),
    "d5_calendar_context": (
        lambda m: context(m).join(daily(m).groupBy(F.col("stay_date").alias("full_date")).agg(F.sum("sold").alias("sold")), "full_date"),
        sql("SELECT c.*, s.sold FROM day_context c JOIN (SELECT stay_date, CAST(sum(sold) AS BIGINT) AS sold FROM daily GROUP BY 1) s ON s.stay_date = c.full_date", "daily", "day_context"),
    ),
    "d6_tax_rate": (
        lambda m: grain.with_tax(demand(m), "stay_date", "night_paise", m.tax_rates(), TAX_THRESHOLD).groupBy("gst_pct").agg(F.count("*").alias("nights"), F.sum("night_paise").alias("revenue_paise")),
        sql("SELECT CAST(CASE WHEN night_paise > 750000 THEN 18 WHEN stay_date >= DATE '1998-09-22' THEN 5 ELSE 12 END AS INT) AS gst_pct, count(*) AS nights, CAST(sum(night_paise) AS BIGINT) AS revenue_paise FROM booking_night GROUP BY 1", "booking_night"),
    ),
    "d7_normalised_guests": (
        lambda m: grain.normalised_guests(m.guests()).select("guest_key", "phone_last10", "email_normalised", grain.identity_key().alias("identity_key")),
        sql("SELECT guest_key, phone_last10, email_normalised, coalesce(nullif(phone_last10, ''), email_normalised, CAST(guest_key AS VARCHAR)) AS identity_key FROM guest_norm", "guest_norm"),
    ),
    "d9_booking_nights": (demand, sql("SELECT * FROM booking_night", "booking_night")),
    "d10_unit_nights": (unit_nights, sql("SELECT * FROM unit_night", "unit_night")),
    "d11_enriched_nights": (
        lambda m: enriched(m).where("is_occupied").select("unit_key", "stay_date", "booking_key", "gst_pct", "gst_paise", "gross_paise", "net_after_commission_paise"),
        sql("SELECT unit_key, stay_date, booking_key, CAST(gst_pct AS INT) AS gst_pct, gst_paise, gross_paise, net_after_commission_paise FROM enriched WHERE is_occupied", "enriched"),
    ),
    "v1_daily_kpi": (daily, sql(f"SELECT *, {RATES} FROM daily", "daily")),
    "v2_booking_kpi": (
        lambda m: views.booking_kpi(m.bookings()),
        sql("""SELECT booking_key, property_key, channel_code, booking_date, CAST(booked_at + INTERVAL 330 MINUTE AS DATE) AS derived_date, CAST(booked_at + INTERVAL 330 MINUTE AS DATE) <> booking_date AS is_drifted, status = 'cancelled' AS is_cancelled,
        net_paise - commission_paise AS net_after_commission_paise, net_paise // greatest(nights, 1) AS nightly_rate_paise FROM booking""", "booking"),
    ),
    "v3_service_kpi": (
        lambda m: views.service_kpi(m.requests()).select("request_key", "request_date", "local_hour", "day_part", "resolution_minutes", "is_sla_breached"),
        sql("SELECT request_key, request_date, CAST(hour(created_at + INTERVAL 330 MINUTE) AS INT) AS local_hour, day_part, resolution_minutes, is_sla_breached FROM request", "request"),
    ),
    "v4_guest_repeat": (
        lambda m: views.guest_repeat(m.bookings(), m.guests()),
        sql(f"""SELECT basis, count(*) AS guests, count(*) FILTER (stays >= 2) AS repeat_guests, {bp("count(*) FILTER (stays >= 2)", "count(*)")} AS repeat_rate_bp FROM (
        SELECT 'raw' AS basis, CAST(guest_key AS VARCHAR) AS who, count(*) AS stays FROM booking WHERE status = 'checked_out' GROUP BY ALL
        UNION ALL SELECT 'resolved', coalesce(nullif(phone_last10, ''), email_normalised, CAST(guest_key AS VARCHAR)), count(*) FROM booking JOIN guest_norm USING (guest_key) WHERE status = 'checked_out' GROUP BY ALL) GROUP BY basis""", "booking", "guest_norm"),
    ),
    "v6_on_the_books": (
        lambda m: views.on_the_books(demand(m), AS_OF),
        sql(f"SELECT stay_date, property_key, channel_code, count(*) AS nights_otb, CAST(sum(night_paise) AS BIGINT) AS revenue_otb_paise, date_diff('day', DATE '{AS_OF}', stay_date) AS days_out FROM booking_night WHERE entered_on <= DATE '{AS_OF}' AND stay_date > DATE '{AS_OF}' AND (left_on IS NULL OR left_on > DATE '{AS_OF}') GROUP BY ALL", "booking_night"),
    ),
    "v6_on_the_books_many": (
        lambda m: views.on_the_books_many(demand(m), m.spark.range(24).select(F.add_months(F.lit(dt.date(1997, 1, 1)), F.col("id").cast("int")).alias("as_of"))),
        sql("""SELECT as_of, property_key, count(*) AS nights_otb, CAST(sum(night_paise) AS BIGINT) AS revenue_otb_paise FROM booking_night, (SELECT CAST(DATE '1997-01-01' + to_months(CAST(i AS INT)) AS DATE) AS as_of FROM range(24) t(i))
        WHERE entered_on <= as_of AND stay_date > as_of AND (left_on IS NULL OR left_on > as_of) GROUP BY ALL""", "booking_night"),
    ),
    "v6_on_the_books_every_day": (
        lambda m: views.on_the_books_many(demand(m), m.spark.range(2404).select(F.date_add(F.lit(dt.date(1995, 1, 1)), F.col("id").cast("int")).alias("as_of"))),
        sql("""SELECT as_of, property_key, count(*) AS nights_otb, CAST(sum(night_paise) AS BIGINT) AS revenue_otb_paise FROM booking_night, (SELECT DATE '1995-01-01' + CAST(i AS INT) AS as_of FROM range(2404) t(i))
        WHERE entered_on <= as_of AND stay_date > as_of AND (left_on IS NULL OR left_on > as_of) GROUP BY ALL""", "booking_night"),
    ),
    "v7_pickup_daily": (
        lambda m: views.pickup_daily(demand(m)),
        sql("""SELECT coalesce(a.activity_date, r.activity_date) AS activity_date, coalesce(a.stay_date, r.stay_date) AS stay_date, coalesce(a.property_key, r.property_key) AS property_key, coalesce(a.channel_code, r.channel_code) AS channel_code,
        coalesce(a.n, 0) AS nights_added, coalesce(r.n, 0) AS nights_cancelled, coalesce(a.n, 0) - coalesce(r.n, 0) AS nights_net, coalesce(a.v, 0) AS revenue_added_paise, coalesce(r.v, 0) AS revenue_cancelled_paise,
        date_diff('day', coalesce(a.activity_date, r.activity_date), coalesce(a.stay_date, r.stay_date)) AS days_before_stay FROM added a FULL JOIN removed r ON a.activity_date = r.activity_date AND a.stay_date = r.stay_date AND a.property_key = r.property_key AND a.channel_code = r.channel_code""",
            "booking_night", added="SELECT entered_on AS activity_date, stay_date, property_key, channel_code, count(*) AS n, CAST(sum(night_paise) AS BIGINT) AS v FROM booking_night GROUP BY ALL",
            removed="SELECT left_on AS activity_date, stay_date, property_key, channel_code, count(*) AS n, CAST(sum(night_paise) AS BIGINT) AS v FROM booking_night WHERE left_on IS NOT NULL GROUP BY ALL"),
    ),
    "v8_booking_curve": (
        lambda m: views.booking_curve(demand(m), 60),
        sql(f"SELECT property_key, days_out, count(*) AS stay_dates, CAST(sum(on_books) AS BIGINT) AS nights_on_books, CAST(sum(final_nights) AS BIGINT) AS final_nights, {_quantile(0.5)} AS median_pct_sold, {_quantile(0.25)} AS p25_pct_sold, {_quantile(0.75)} AS p75_pct_sold FROM books JOIN final USING (property_key, stay_date) GROUP BY ALL",
            "booking_night", final="SELECT property_key, stay_date, count(*) AS final_nights FROM booking_night WHERE status IN ('checked_out', 'confirmed') GROUP BY ALL", books=books_sql("final", 60)),
    ),
    "v9_lead_time_profile": (
        lambda m: views.lead_time_profile(m.bookings(), m.channels()),
        sql(f"""SELECT channel_code, channel_type, count(*) AS bookings, {rdiv("CAST(sum(lead_days) * 10 AS BIGINT)", "count(*)")} AS mean_tenth_days, quantile_cont(lead_days, 0.25) AS p25_days, quantile_cont(lead_days, 0.5) AS p50_days, quantile_cont(lead_days, 0.75) AS p75_days,
        quantile_cont(lead_days, 0.9) AS p90_days, {bp("count(*) FILTER (lead_days = 0)", "count(*)")} AS same_day_bp, {bp("count(*) FILTER (lead_days >= 30)", "count(*)")} AS month_ahead_bp, {bp("count(*) FILTER (status = 'cancelled')", "count(*)")} AS cancel_bp FROM booking JOIN channel USING (channel_code) GROUP BY ALL""", "booking", "channel"),
    ),
    "v10_cancellation_funnel": (
        lambda m: views.cancellation_funnel(m.bookings()),
        FUNNEL := sql(f"""SELECT CAST(date_trunc('month', check_in_date) AS DATE) AS stay_month, property_key, channel_code, count(*) AS made, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'no_show') AS no_show, count(*) FILTER (status = 'checked_out') AS stayed,
        {bp("count(*) FILTER (status = 'cancelled')", "count(*)")} AS cancel_bp, {bp("count(*) FILTER (status = 'no_show')", "count(*)")} AS no_show_bp, {bp("count(*) FILTER (status IN ('cancelled', 'no_show'))", "count(*)")} AS wash_bp,
        quantile_cont(date_diff('day', cancel_date, check_in_date), 0.5) FILTER (cancel_date IS NOT NULL) AS median_notice_days FROM booking GROUP BY ALL""", "booking"),
    ),
    "v11_microstay_impact": (
        lambda m: views.microstay_impact(m.bookings(), unit_nights(m)),
        sql(f"SELECT b.channel_code, count(*) AS bookings, CAST(sum(net_paise) AS BIGINT) AS revenue_paise, count(n.unit_key) AS unit_nights, {rdiv('CAST(sum(net_paise) AS BIGINT)', 'count(*)')} AS avg_value_paise FROM booking b LEFT JOIN (SELECT * FROM unit_night WHERE is_occupied) n ON n.booking_key = b.booking_key WHERE b.check_in_date = b.check_out_date GROUP BY ALL", "booking", "unit_night"),
    ),
    "v12_grain_reconciliation": (
        lambda m: views.grain_reconciliation(demand(m), unit_nights(m), START, END),
        sql("""SELECT CAST((SELECT coalesce(sum(n), 0) FROM e) AS BIGINT) AS exploded, CAST((SELECT coalesce(sum(n), 0) FROM m) AS BIGINT) AS occupied, CAST((SELECT coalesce(sum(greatest(e.n - coalesce(m.n, 0), 0)), 0) FROM e LEFT JOIN m USING (booking_key)) AS BIGINT) AS unallocated,
        CAST((SELECT coalesce(sum(n), 0) FROM m WHERE booking_key NOT IN (SELECT booking_key FROM e)) AS BIGINT) AS hourly""", "booking_night", "unit_night",
            e="SELECT booking_key, count(*) AS n FROM booking_night WHERE status = 'checked_out' AND stay_date BETWEEN DATE '1995-01-01' AND DATE '2001-07-31' GROUP BY 1", m="SELECT booking_key, count(*) AS n FROM unit_night WHERE is_occupied GROUP BY 1"),
    ),
    "v13_daily_kpi_calendar": (
        lambda m: views.daily_kpi_calendar(daily(m), context(m)).select("property_key", "stay_date", "occupancy_bp", "revpar_paise", "is_public_holiday", "nearest_holiday", "days_to_holiday", "is_holiday_adjacent", "is_bridge_day", "is_long_weekend"),
        sql(f"SELECT property_key, stay_date, {bp('sold', 'available')} AS occupancy_bp, {rdiv('revenue_paise', 'available')} AS revpar_paise, is_public_holiday, nearest_holiday, days_to_holiday, is_holiday_adjacent, is_bridge_day, is_long_weekend FROM daily JOIN day_context ON full_date = stay_date", "daily", "day_context"),
    ),
    "k10_wash_by_channel": (
        lambda m: views.wash_by_channel(views.cancellation_funnel(m.bookings())),
        f"SELECT channel_code, CAST(sum(made) AS BIGINT) AS made, CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(no_show) AS BIGINT) AS no_show, CAST(sum(stayed) AS BIGINT) AS stayed, {bp('sum(cancelled) + sum(no_show)', 'sum(made)')} AS wash_bp FROM ({FUNNEL}) GROUP BY 1",
    ),
}
