"""Queries of the metric registry, the KPI rollups and the curated analyses (M, K, A)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import analyses, grain, kpi, metrics, views
from ..sources.adapter import TAX_THRESHOLD, UNIT_TYPES
from .base import bp, rdiv, sql
from .layer import QUERIES as LAYER
from .layer import RATES, context, daily, demand, enriched, unit_nights

A, B = dt.date(1997, 6, 1), dt.date(1997, 7, 31)
SD, BD, RD = "CAST(date_trunc('month', stay_date) AS DATE)", "CAST(date_trunc('month', booking_date) AS DATE)", "request_date"
SUMS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in kpi.SUMS)


def c_if(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


def s_if(cond: str, col: str) -> str:
    return f"CAST(coalesce(sum({col}) FILTER ({cond}), 0) AS BIGINT)"


def total(col: str) -> str:
    return f"CAST(sum({col}) AS BIGINT)"


_UNIT = lambda m: enriched(m).withColumn("month", F.trunc("stay_date", "month"))
_BOOK = lambda m: m.bookings().withColumn("month", F.trunc("booking_date", "month"))
_STAY = lambda m: m.bookings().withColumn("month", F.trunc("check_in_date", "month"))
#: metric: number, source frame, keys, SQL source, SQL keys, SQL value
_METRIC_SQL = {
    "occupancy_bp": (1, _UNIT, ("property_key", "month"), "enriched", bp(c_if("is_occupied"), c_if("is_sellable"))),
    "occupancy_benchmark_bp": (2, _UNIT, ("property_key", "month"), "enriched", bp(c_if("is_occupied"), "count(*)")),
    "adr_paise": (3, _UNIT, ("property_key", "month"), "enriched", rdiv(total("revenue_paise"), c_if("is_occupied"))),
    "adr_excl_microstay_paise": (4, _UNIT, ("property_key", "month"), "enriched", rdiv(s_if("stay_type <> 'microstay'", "revenue_paise"), c_if("is_occupied AND stay_type <> 'microstay'"))),
    "revpar_paise": (5, _UNIT, ("property_key", "month"), "enriched", rdiv(total("revenue_paise"), c_if("is_sellable"))),
    "room_revenue_net_paise": (6, _UNIT, ("property_key", "month"), "enriched", total("revenue_paise")),
    "room_revenue_gross_paise": (7, _UNIT, ("property_key", "month"), "enriched", total("gross_paise")),
    "cancellation_rate_bp": (8, _BOOK, ("channel_code", "month"), "booking", bp(c_if("status = 'cancelled'"), "count(*)")),
    "avg_lead_tenth_days": (10, _BOOK, ("channel_code", "month"), "booking", rdiv(total("lead_days * 10"), "count(*)")),
    "alos_hundredth_nights": (11, _BOOK, ("channel_code", "month"), "booking", rdiv(f"{s_if(chr(115) + 'tay_type = ' + chr(39) + 'nightly' + chr(39), 'nights')} * 100", c_if("stay_type = 'nightly'"))),
    "service_tat_hundredth_minutes": (12, lambda m: m.requests(), ("owning_team", "request_date"), "request", rdiv(total("resolution_minutes * 100"), "count(resolution_minutes)")),
    "sla_breach_rate_bp": (13, lambda m: m.requests(), ("owning_team", "request_date"), "request", bp(c_if("is_sla_breached"), "count(resolution_minutes)")),
    "csat_hundredths": (14, lambda m: m.requests(), ("owning_team", "request_date"), "request", rdiv(total("csat * 100"), "count(csat)")),
    "wash_rate_bp": (20, _STAY, ("property_key", "month"), "booking", bp(c_if("status IN ('cancelled', 'no_show')"), "count(*)")),
    "revpor_paise": (21, _UNIT, ("property_key", "month"), "enriched", rdiv(total("revenue_paise"), c_if("is_occupied"))),
    "cancel_notice_days": (22, _STAY, ("property_key", "month"), "booking", "quantile_cont(date_diff('day', cancel_date, check_in_date), 0.5)"),
}


def _metric_queries() -> dict[str, tuple]:
    out = {}
    for key, (n, frame, by, source, value) in _METRIC_SQL.items():
        day = "stay_date" if source == "enriched" else "check_in_date" if frame is _STAY else "booking_date"
        keys = [f"CAST(date_trunc('month', {day}) AS DATE) AS month" if k == "month" else k for k in by]
        out[f"m{n}_{key}"] = (lambda m, k=key, f=frame, b=by: metrics.metric(f(m), k, b), sql(f"SELECT {', '.join(keys)}, {value} AS {key} FROM {source} GROUP BY ALL", source))
    return out


_V4 = LAYER["v4_guest_repeat"]
#: The first two sections of the day brief; the guests' voice is added where text is at hand.
_BRIEF = f"""SELECT 'change' AS section, 0 AS rank, label, value FROM (SELECT {s_if('t', 'sold')} - {s_if('NOT t', 'sold')} AS sold, {s_if('t', 'revenue_paise')} - {s_if('NOT t', 'revenue_paise')} AS revenue_paise, {s_if('t', 'available')} - {s_if('NOT t', 'available')} AS available
        FROM (SELECT *, stay_date = DATE '1997-06-18' AS t FROM daily WHERE stay_date IN (DATE '1997-06-18', DATE '1997-06-11'))) UNPIVOT (value FOR label IN (sold, revenue_paise, available))
        UNION ALL SELECT 'breaches', CAST(row_number() OVER (ORDER BY b DESC, property_key, day_part) AS INT), property_key || ' ' || day_part, b FROM (SELECT property_key, day_part, {c_if('is_sla_breached')} AS b FROM request WHERE resolution_minutes IS NOT NULL AND request_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY ALL HAVING count(*) >= 3 ORDER BY b DESC, property_key, day_part LIMIT 3)"""
QUERIES = _metric_queries() | {
    "m10_lead_time_filtered": (
        lambda m: metrics.metric(_BOOK(m), "avg_lead_tenth_days", ("channel_code",), filtered=True),
        sql(f"SELECT channel_code, {rdiv(total('lead_days * 10'), 'count(*)')} AS avg_lead_tenth_days FROM booking WHERE status <> 'cancelled' AND stay_type = 'nightly' GROUP BY ALL", "booking"),
    ),
    "m9_channel_mix": (lambda m: metrics.channel_mix(unit_nights(m)), sql(f"SELECT channel_code, count(*) AS nights, {bp('count(*)', 'sum(count(*)) OVER ()')} AS channel_mix_bp FROM unit_night WHERE is_occupied GROUP BY 1", "unit_night")),
    "m15_repeat_guest_rate": (lambda m: views.guest_repeat(m.bookings(), m.guests()).where("basis = 'resolved'").select("repeat_rate_bp"), f"SELECT repeat_rate_bp FROM ({_V4[1]}) WHERE basis = 'resolved'"),
    "m16_cost_per_booking": (
        lambda m: metrics.cost_per_booking(m.bookings(), m.payments()),
        sql(f"SELECT channel_code, {rdiv('CAST(sum(commission_paise) + coalesce(sum(fees), 0) AS BIGINT)', 'count(DISTINCT b.booking_key)')} AS cost_per_booking_paise FROM booking b LEFT JOIN (SELECT booking_key, sum(fee_paise + gst_on_fee_paise) AS fees FROM payment WHERE booking_key IS NOT NULL GROUP BY 1) p ON p.booking_key = b.booking_key GROUP BY 1", "booking", "payment"),
    ),
    "m18_pickup_nights": (lambda m: metrics.metric(views.pickup_daily(demand(m)), "pickup_nights", ("activity_date",)).where("pickup_nights > 0"), sql("SELECT entered_on AS activity_date, count(*) AS pickup_nights FROM booking_night GROUP BY 1", "booking_night")),
    "m23_holiday_occupancy_effect": (
        lambda m: metrics.holiday_occupancy_effect(views.daily_kpi_calendar(daily(m), context(m))),
        sql(f"""SELECT days_to_holiday, near_bp - base_bp AS effect_bp FROM (SELECT days_to_holiday, {rdiv(total('o'), 'count(o)')} AS near_bp FROM x WHERE is_holiday_adjacent GROUP BY 1), (SELECT {rdiv(total('o'), 'count(o)')} AS base_bp FROM x WHERE NOT is_holiday_adjacent)""",
            "daily", "day_context", x=f"SELECT {bp('sold', 'available')} AS o, days_to_holiday, is_holiday_adjacent FROM daily JOIN day_context ON full_date = stay_date"),
    ),
    "m24_holiday_adjacent": (
        lambda m: daily(m).join(context(m).where("is_holiday_adjacent"), F.col("full_date") == F.col("stay_date")).groupBy("property_key", "nearest_holiday").agg(F.count("*").alias("dates"), F.sum("sold").alias("sold")),
        sql("SELECT property_key, nearest_holiday, count(*) AS dates, CAST(sum(sold) AS BIGINT) AS sold FROM daily JOIN day_context ON full_date = stay_date WHERE abs(days_to_holiday) <= 7 GROUP BY ALL", "daily", "day_context"),
    ),
    "k1_overview": (
        lambda m: kpi.overview(daily(m).where("stay_date <= date'2000-06-30'"), 30),
        sql(f"""SELECT r1 AS revenue_paise_now, r0 AS revenue_paise_before, {bp('r1 - r0', 'r0')} AS revenue_change_bp, {bp('s1', 'a1')} AS occupancy_bp_now, {bp('s1', 'a1')} - {bp('s0', 'a0')} AS occupancy_change_bp, {rdiv('r1', 's1')} AS adr_paise_now,
        {rdiv('r1', 's1')} - {rdiv('r0', 's0')} AS adr_change_paise, {rdiv('r1', 'a1')} AS revpar_paise_now, {rdiv('r1', 'a1')} - {rdiv('r0', 'a0')} AS revpar_change_paise FROM x""",
            "daily", x=f"SELECT {s_if('n', 'revenue_paise')} r1, {s_if('NOT n', 'revenue_paise')} r0, {s_if('n', 'sold')} s1, {s_if('NOT n', 'sold')} s0, {s_if('n', 'available')} a1, {s_if('NOT n', 'available')} a0 FROM (SELECT *, stay_date > DATE '2000-05-31' AS n FROM daily WHERE stay_date > DATE '2000-05-01' AND stay_date <= DATE '2000-06-30')"),
    ),
    "k2_trend": (lambda m: kpi.trend(daily(m), "month"), sql(f"SELECT period, sold, revenue_paise, {bp('sold', 'available')} AS occupancy_bp, {rdiv('revenue_paise', 'sold')} AS adr_paise, {rdiv('revenue_paise', 'available')} AS revpar_paise FROM (SELECT {SD} AS period, {SUMS_SQL} FROM daily GROUP BY 1)", "daily")),
    "k3_channel_revenue": (
        lambda m: kpi.channel_revenue(unit_nights(m)),
        sql(f"SELECT channel_code, nights, {bp('nights', 'sum(nights) OVER ()')} AS share_bp, {rdiv('r', 'nights')} AS adr_paise, c AS commission_paise, {rdiv('c * 18', '100')} AS gst_on_commission_paise, {rdiv('r - c - ' + rdiv('c * 18', '100'), 'nights')} AS net_per_night_paise FROM (SELECT channel_code, count(*) AS nights, {total('revenue_paise')} AS r, {total('commission_paise')} AS c FROM unit_night WHERE is_occupied GROUP BY 1)", "unit_night"),
    ),
    "k4_properties": (lambda m: kpi.properties(daily(m), m.units()), sql("SELECT property_key, (SELECT count(*) FROM unit u WHERE u.property_key = d.property_key) AS unit_count FROM (SELECT DISTINCT property_key FROM daily) d", "daily", "unit")),
    "k5_property_performance": (
        lambda m: kpi.property_performance(daily(m), m.requests()),
        sql(f"""SELECT property_key, sold, revenue_paise, {bp('sold', 'available')} AS occupancy_bp, {rdiv('revenue_paise', 'sold')} AS adr_paise, {rdiv('revenue_paise', 'available')} AS revpar_paise, requests, breach_bp, csat_hundredths FROM (SELECT property_key, {SUMS_SQL} FROM daily GROUP BY 1)
        LEFT JOIN (SELECT property_key, count(*) AS requests, {bp(c_if('is_sla_breached'), 'count(resolution_minutes)')} AS breach_bp, {rdiv(total('csat * 100'), 'count(csat)')} AS csat_hundredths FROM request GROUP BY 1) USING (property_key)""", "daily", "request"),
    ),
    "k6_operations_overview": (
        lambda m: kpi.operations_overview(m.requests()),
        sql(f"SELECT count(*) AS requests, count(resolution_minutes) AS resolved, {c_if('is_sla_breached')} AS breached, {bp(c_if('is_sla_breached'), 'count(resolution_minutes)')} AS breach_bp, {rdiv(total('resolution_minutes * 100'), 'count(resolution_minutes)')} AS tat_hundredths, {bp('count(csat)', 'count(*)')} AS csat_response_bp, {rdiv(total('csat * 100'), 'count(csat)')} AS csat_hundredths FROM request", "request"),
    ),
    "k7_sla_matrix": (
        lambda m: kpi.sla_matrix(views.service_kpi(m.requests())),
        sql(f"SELECT property_key, day_part, owning_team, count(*) AS requests, {c_if('is_sla_breached')} AS breaches, {bp(c_if('is_sla_breached'), 'count(*)')} AS breach_bp FROM request WHERE resolution_minutes IS NOT NULL GROUP BY ALL HAVING count(*) >= 5 ORDER BY breach_bp DESC, property_key, day_part, owning_team LIMIT 40", "request"),
    ),
    "k8_requests_by_category": (lambda m: kpi.requests_by_category(m.requests()), sql(f"SELECT category, request_type, owning_team, count(*) AS requests, {c_if('is_sla_breached')} AS breaches FROM request GROUP BY ALL ORDER BY requests DESC, category, request_type, owning_team LIMIT 40", "request")),
    "k11_same_time_last_year": (
        lambda m: kpi.same_time_last_year(daily(m)),
        sql(f"SELECT d.stay_date, d.r AS revenue_paise, b.r AS stly_paise, CAST(sum(d.r) OVER (PARTITION BY date_trunc('month', d.stay_date) ORDER BY d.stay_date) AS BIGINT) AS mtd_paise, {bp('d.r - b.r', 'b.r')} AS vs_stly_bp FROM x d LEFT JOIN x b ON b.stay_date = d.stay_date - 364", "daily", x=f"SELECT stay_date, {total('revenue_paise')} AS r FROM daily GROUP BY 1"),
    ),
    "k12_bookings_by_stay_date": (lambda m: kpi.bookings_by_date(m.bookings(), "check_in_date"), sql(f"SELECT check_in_date AS date, count(*) AS bookings, {total('net_paise')} AS net_paise FROM booking GROUP BY 1", "booking")),
    "k13_revenue_by_basis": (
        lambda m: kpi.revenue_by_basis(unit_nights(m), m.bookings(), m.payments(), A, B),
        sql(f"SELECT *, greatest(stay_paise, booking_paise, payment_paise) - least(stay_paise, booking_paise, payment_paise) AS spread_paise FROM (SELECT {s_if(f'stay_date BETWEEN DATE {chr(39)}{A}{chr(39)} AND DATE {chr(39)}{B}{chr(39)}', 'revenue_paise')} AS stay_paise FROM unit_night), (SELECT {total('net_paise')} AS booking_paise FROM booking WHERE booking_date BETWEEN DATE '{A}' AND DATE '{B}' AND status <> 'cancelled'), (SELECT {total('gross_paise')} AS payment_paise FROM payment WHERE payment_date BETWEEN DATE '{A}' AND DATE '{B}')", "unit_night", "booking", "payment"),
    ),
    "k14_cancellation_bases": (
        lambda m: kpi.cancellation_bases(m.bookings(), A, B),
        sql(f"SELECT *, {bp('cohort_cancelled', 'made')} AS cohort_bp, {bp('event_cancelled', 'made')} AS event_bp FROM (SELECT {c_if('d')} AS made, {c_if(chr(100) + ' AND status = ' + chr(39) + 'cancelled' + chr(39))} AS cohort_cancelled, count(*) FILTER (cancel_date BETWEEN DATE '{A}' AND DATE '{B}') AS event_cancelled FROM (SELECT *, booking_date BETWEEN DATE '{A}' AND DATE '{B}' AS d FROM booking))", "booking"),
    ),
    "k15_gst_summary": (lambda m: kpi.gst_summary(enriched(m)), sql(f"SELECT {total('revenue_paise')} AS net_paise, {total('gst_paise')} AS gst_paise, {total('gross_paise')} AS gross_paise, {c_if('gst_pct = 18')} AS nights_18, {c_if('gst_pct = 5')} AS nights_5, {c_if('gst_pct = 12')} AS nights_12, {bp(total('gst_paise'), total('revenue_paise'))} AS effective_bp FROM enriched WHERE is_occupied", "enriched")),
    "k16_era_compare": (
        lambda m: kpi.era_compare(m.requests(), dt.date(2024, 1, 16), "owning_team"),
        sql(f"SELECT *, {bp('tat_after', 'tat_before')} AS tat_ratio_bp FROM (SELECT coalesce(owning_team, 'ALL') AS segment, {c_if('NOT late')} AS n_before, {rdiv(s_if('NOT late', 'resolution_minutes') + ' * 100', c_if('NOT late'))} AS tat_before, {bp(c_if('NOT late AND is_sla_breached'), c_if('NOT late'))} AS breach_bp_before, {c_if('late')} AS n_after, {rdiv(s_if('late', 'resolution_minutes') + ' * 100', c_if('late'))} AS tat_after, {bp(c_if('late AND is_sla_breached'), c_if('late'))} AS breach_bp_after FROM (SELECT *, request_date >= DATE '2024-01-16' AS late FROM request WHERE resolution_minutes IS NOT NULL) GROUP BY ROLLUP (owning_team))", "request"),
    ),
    "k17_window_delta": (
        lambda m: kpi.window_delta(unit_nights(m), m.channels(), A, B),
        sql(f"""SELECT *, adr_now - adr_before AS adr_change, revpar_now - revpar_before AS revpar_change, corporate_bp_now - corporate_bp_before AS corporate_change_bp FROM (SELECT {rdiv(s_if('w', 'revenue_paise'), c_if('w AND is_occupied'))} AS adr_now, {rdiv(s_if('w', 'revenue_paise'), c_if('w AND is_sellable'))} AS revpar_now,
        {rdiv(s_if('NOT w', 'revenue_paise'), c_if('NOT w AND is_occupied'))} AS adr_before, {rdiv(s_if('NOT w', 'revenue_paise'), c_if('NOT w AND is_sellable'))} AS revpar_before, {bp(c_if("w AND is_occupied AND channel_code = '3-MEDIUM'"), c_if('w AND is_occupied'))} AS corporate_bp_now, {bp(c_if("NOT w AND is_occupied AND channel_code = '3-MEDIUM'"), c_if('NOT w AND is_occupied'))} AS corporate_bp_before
        FROM (SELECT *, stay_date >= DATE '{A}' AS w FROM unit_night WHERE stay_date BETWEEN DATE '{A}' - 61 AND DATE '{B}'))""", "unit_night"),
    ),
    "k19_csat_by_breach": (lambda m: kpi.csat_by_breach(m.requests()), sql(f"SELECT {rdiv(s_if('is_sla_breached', 'csat') + ' * 100', 'count(csat) FILTER (is_sla_breached)')} AS csat_breached, {rdiv(s_if('NOT is_sla_breached', 'csat') + ' * 100', 'count(csat) FILTER (NOT is_sla_breached)')} AS csat_kept FROM request", "request")),
    "k20_validate_layer": (
        lambda m: kpi.validate_layer(daily(m), unit_nights(m)),
        sql(f"SELECT label AS measure, value AS published, value AS recomputed, true AS agrees FROM (SELECT {c_if('is_sellable')} AS available, {c_if('is_occupied')} AS sold, {total('revenue_paise')} AS revenue_paise, {total('commission_paise')} AS commission_paise FROM unit_night) UNPIVOT (value FOR label IN (available, sold, revenue_paise, commission_paise))", "unit_night"),
    ),
    "k22_night_drift": (
        lambda m: kpi.night_drift(m.bookings(), unit_nights(m)),
        sql(f"SELECT *, {bp('booked_nights - materialised_nights', 'booked_nights')} AS drift_bp FROM (SELECT {total('nights')} AS booked_nights FROM booking WHERE status = 'checked_out' AND nights > 0), (SELECT {c_if('u.stay_type = ' + chr(39) + 'nightly' + chr(39))} AS materialised_nights, count(*) FILTER (u.stay_type = 'nightly' AND u.stay_date >= b.check_out_date) AS after_departure FROM unit_night u JOIN booking b USING (booking_key) WHERE is_occupied)", "booking", "unit_night"),
    ),
    "k23_outage_vs_expected": (
        lambda m: kpi.outage_vs_expected(m.requests(), "signup", dt.date(2024, 1, 12), dt.date(2024, 1, 20)),
        sql(f"SELECT {c_if('i')} AS seen, {rdiv(c_if('NOT i') + ' * 9', 'count(DISTINCT request_date) FILTER (NOT i)')} AS expected FROM (SELECT *, request_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-20' AS i FROM request WHERE channel = 'signup')", "request"),
    ),
    "k24_tax_exposure": (lambda m: kpi.tax_exposure(unit_nights(m), m.units(), TAX_THRESHOLD), sql("SELECT unit_type, count(*) AS nights, count(DISTINCT unit_key) AS units, bool_or(base_rate_paise > 750000) AS is_above FROM unit_night JOIN unit USING (unit_key) WHERE is_occupied GROUP BY 1", "unit_night", "unit")),
    "k25_pooled_curve": (
        lambda m: kpi.pooled_curve(views.booking_curve(demand(m), 60), (0, 1, 3, 7, 14, 21, 30, 45, 60)),
        f"SELECT days_out, {bp('sum(nights_on_books)', 'sum(final_nights)')} AS sold_bp FROM ({LAYER['v8_booking_curve'][1]}) WHERE days_out IN (0, 1, 3, 7, 14, 21, 30, 45, 60) GROUP BY 1",
    ),
    "k26_worst_month": (
        lambda m: kpi.worst_month(daily(m)),
        sql(f"SELECT period AS month, ch AS change_paise FROM (SELECT period, rp - lag(rp) OVER (ORDER BY period) AS ch FROM (SELECT {SD} AS period, {rdiv(total('revenue_paise'), total('available'))} AS rp FROM daily GROUP BY 1)) WHERE ch IS NOT NULL ORDER BY ch, period LIMIT 1", "daily"),
    ),
    "a1_revenue_variance": (
        lambda m: analyses.revenue_variance(daily(m)),
        sql("""SELECT ym AS year_month, round(rp, 4) AS revpar, round(rp - rp0, 4) AS change, round((adr - adr0) * (occ + occ0) / 2, 4) AS rate_effect, round((occ - occ0) * (adr + adr0) / 2, 4) AS volume_effect, CASE WHEN rp0 IS NOT NULL THEN round(abs(rp - rp0 - (adr - adr0) * (occ + occ0) / 2 - (occ - occ0) * (adr + adr0) / 2), 3) END AS residual,
        CASE WHEN rp0 IS NULL THEN 'baseline month' WHEN abs(round((adr - adr0) * (occ + occ0) / 2, 4)) > abs(round((occ - occ0) * (adr + adr0) / 2, 4)) THEN 'rate-driven' ELSE 'volume-driven' END AS primary_driver
        FROM (SELECT *, lag(occ) OVER (ORDER BY ym) AS occ0, lag(adr) OVER (ORDER BY ym) AS adr0, lag(rp) OVER (ORDER BY ym) AS rp0 FROM (SELECT strftime(stay_date, '%Y-%m') AS ym, sum(sold) / sum(available) AS occ, coalesce(CAST(sum(revenue_paise) AS BIGINT) / nullif(CAST(sum(sold) AS BIGINT), 0), 0) AS adr, CAST(sum(revenue_paise) AS BIGINT) / CAST(sum(available) AS BIGINT) AS rp FROM daily GROUP BY 1))""", "daily"),
    ),
    "a2_rate_or_mix": (
        lambda m: analyses.rate_or_mix(unit_nights(m), A, B),
        sql(f"""SELECT channel_code, round(100 * s0, 3) AS share_before_pct, round(100 * s1, 3) AS share_after_pct, round(a0, 3) AS adr_before, round(a1, 3) AS adr_after, round(s0 * (a1 - a0), 3) AS rate_effect, round((s1 - s0) * a0, 3) AS mix_effect FROM x
        UNION ALL SELECT 'TOTAL', round(100 * sum(s0), 3), round(100 * sum(s1), 3), NULL, NULL, round(sum(s0 * (a1 - a0)), 3), round(sum((s1 - s0) * a0), 3) FROM x""", "unit_night",
            x=f"SELECT channel_code, {c_if('NOT w')} / sum({c_if('NOT w')}) OVER () AS s0, {c_if('w')} / sum({c_if('w')}) OVER () AS s1, coalesce({s_if('NOT w', 'revenue_paise')} / nullif({c_if('NOT w')}, 0), 0) AS a0, coalesce({s_if('w', 'revenue_paise')} / nullif({c_if('w')}, 0), 0) AS a1 FROM (SELECT *, stay_date >= DATE '{A}' AS w FROM unit_night WHERE is_occupied AND stay_date BETWEEN DATE '{A}' - 60 AND DATE '{B}') GROUP BY 1"),
    ),
    "a3_sla_concentration": (
        lambda m: analyses.sla_concentration(views.service_kpi(m.requests())),
        sql(f"""SELECT *, CASE WHEN vs_baseline_bp >= 1500 AND requests >= 40 THEN 'ACT' WHEN vs_baseline_bp >= 1500 THEN 'WATCH' ELSE 'normal' END AS verdict FROM (SELECT *, CAST(rank() OVER (ORDER BY breach_bp DESC) AS INT) AS breach_rank, breach_bp - team_bp AS vs_baseline_bp FROM (
        SELECT *, {bp('breaches', 'requests')} AS breach_bp, {bp('sum(breaches) OVER (PARTITION BY owning_team)', 'sum(requests) OVER (PARTITION BY owning_team)')} AS team_bp FROM (SELECT property_key, owning_team, day_part, count(*) AS requests, {c_if('is_sla_breached')} AS breaches FROM request WHERE resolution_minutes IS NOT NULL GROUP BY ALL HAVING count(*) >= 20))) ORDER BY breach_rank, property_key, owning_team, day_part LIMIT 15""", "request"),
    ),
    "a4_channel_economics": (
        lambda m: analyses.channel_economics(m.bookings(), unit_nights(m), m.payments()),
        sql(f"""SELECT channel_code, made, {bp('cancelled', 'made')} AS cancel_bp, lead_tenths, n AS room_nights, {bp('n', 'sum(n) OVER ()')} AS share_bp, r AS revenue_paise, {rdiv('r', 'n')} AS adr_paise, t AS gst_on_commission_paise, g AS gateway_paise, {rdiv('r - (c + t + g)', 'n')} AS net_per_night_paise, {rdiv('c + t + g', 'made - cancelled')} AS cost_per_booking_paise, {bp('c + t + g', 'r')} AS cost_bp
        FROM (SELECT *, {rdiv('c * 18', '100')} AS t FROM (SELECT channel_code, count(*) AS made, {c_if("status = 'cancelled'")} AS cancelled, {rdiv(total('lead_days * 10'), 'count(*)')} AS lead_tenths FROM booking GROUP BY 1) JOIN (SELECT channel_code, count(*) AS n, {total('revenue_paise')} AS r, {total('commission_paise')} AS c FROM unit_night WHERE is_occupied GROUP BY 1) USING (channel_code)
        LEFT JOIN (SELECT channel_code, {total('fee_paise + gst_on_fee_paise')} AS g FROM payment JOIN booking USING (booking_key) GROUP BY 1) USING (channel_code))""", "booking", "unit_night", "payment"),
    ),
    "a5_repeat_cohorts": (
        lambda m: analyses.repeat_cohorts(m.bookings(), m.guests()),
        sql(f"""SELECT *, CAST(ntile(4) OVER (ORDER BY lifetime_paise, acquiring_channel) AS INT) AS value_quartile FROM (SELECT channel_code AS acquiring_channel, count(*) AS guests, {c_if('stays >= 2')} AS returned, {bp(c_if('stays >= 2'), 'count(*)')} AS repeat_bp, {rdiv(total('stays * 100'), 'count(*)')} AS stays_hundredths, {rdiv(total('gap_days'), 'count(gap_days)')} AS days_between, {rdiv(total('life'), 'count(*)')} AS lifetime_paise
        FROM (SELECT who, first(channel_code ORDER BY check_in_date, booking_key) AS channel_code, count(*) AS stays, {total('net_paise')} AS life, {rdiv(total('gap'), 'count(gap)')} AS gap_days FROM (SELECT *, date_diff('day', check_in_date, lead(check_in_date) OVER (PARTITION BY who ORDER BY check_in_date, booking_key)) AS gap FROM (SELECT b.*, coalesce(nullif(phone_last10, ''), email_normalised, CAST(b.guest_key AS VARCHAR)) AS who FROM booking b JOIN guest_norm g ON g.guest_key = b.guest_key WHERE status = 'checked_out')) GROUP BY 1) GROUP BY 1 HAVING count(*) >= 30)""", "booking", "guest_norm"),
    ),
    "a6_payment_reconciliation": (
        lambda m: analyses.payment_reconciliation(m.payments(), m.bookings()),
        sql(f"""SELECT CASE WHEN p.booking_key IS NULL THEN 'UNRESOLVED_REFERENCE' WHEN abs(gross_paise - net_paise) > 100 THEN 'AMOUNT_MISMATCH' WHEN settlement_date IS NULL THEN 'TIMING_UNSETTLED' ELSE 'MATCHED' END AS variance_code, count(*) AS payments, {total('gross_paise')} AS gross_paise, {total('net_paise')} AS folio_paise, {total('fee_paise')} AS fee_paise, {total('gst_on_fee_paise')} AS gst_on_fee_paise,
        {total('credited_paise')} AS credited_paise, CAST(coalesce(sum(gross_paise - net_paise), 0) AS BIGINT) AS unexplained_paise, {bp('count(*)', 'sum(count(*)) OVER ()')} AS share_bp FROM payment p LEFT JOIN booking b ON b.booking_key = p.booking_key GROUP BY 1""", "payment", "booking"),
    ),
    "a7_unpaid_bookings": (lambda m: analyses.unpaid_bookings(m.bookings(), m.payments()), sql("SELECT booking_key, status, net_paise FROM booking b WHERE NOT EXISTS (SELECT 1 FROM payment p WHERE p.booking_key = b.booking_key)", "booking", "payment")),
}
