"""Queries of revenue management, replay of decisions and pace alerts (R, P, L)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import alerts, revenue
from .base import bp, rdiv, sql
from .layer import AS_OF, books_sql, context, daily, demand, unit_nights

#: A date with several stay dates ahead of their curve.
BUSY = dt.date(2000, 10, 29)
REPLAY = [dt.date(1997, 1, 5) + dt.timedelta(28 * i) for i in range(14)]
_D = f"DATE '{AS_OF}'"
_ASOFS = " UNION ALL ".join(f"SELECT DATE '{d}' AS as_of" for d in REPLAY)


def calendar(m):
    return m.units().select("property_key").distinct().crossJoin(context(m).select(F.col("full_date").alias("stay_date")))


def _one(m):
    return revenue.as_of_table(m.spark, AS_OF)


def _many(m):
    return revenue.as_of_table(m.spark, *REPLAY)


def pace(m, as_ofs, **options):
    return revenue.pace(demand(m), calendar(m), as_ofs, **options)


#: The plain form: every comparable date meets every horizon and every night.
_CTES = {
    "held": "SELECT as_of, property_key, stay_date, date_diff('day', as_of, stay_date) AS days_out, count(*) AS nights_on_books, CAST(sum(night_paise) AS BIGINT) AS revenue_paise FROM booking_night, asofs WHERE entered_on <= as_of AND stay_date > as_of AND stay_date <= as_of + 35 AND (left_on IS NULL OR left_on > as_of) GROUP BY ALL",
    "recent": "SELECT * FROM (SELECT as_of, p.property_key, c.stay_date, isodow(c.stay_date) AS dow, row_number() OVER (PARTITION BY as_of, p.property_key, isodow(c.stay_date) ORDER BY c.stay_date DESC) AS r FROM calendar c, (SELECT DISTINCT property_key FROM unit) p, asofs WHERE c.stay_date < as_of) WHERE r <= 8",
    "recent_dates": "SELECT DISTINCT property_key, stay_date FROM recent",
    "books": books_sql("recent_dates", 35),
    "bench": "SELECT as_of, property_key, dow, days_out, quantile_cont(on_books, 0.5) AS median_nights, quantile_cont(on_books, 0.25) AS p25_nights, quantile_cont(on_books, 0.75) AS p75_nights, count(*) AS support FROM recent JOIN books USING (property_key, stay_date) GROUP BY ALL",
    "pace": f"""SELECT as_of, property_key, stay_date, days_out, nights_on_books, median_nights, p25_nights, p75_nights, support, revenue_paise, nights_on_books - median_nights AS gap_nights, {rdiv('nights_on_books * 2000', 'CAST(median_nights * 2 AS BIGINT)')} AS pace_tenth_pct,
        CASE WHEN abs(nights_on_books - median_nights) < 4 THEN 'on_track' WHEN nights_on_books < p25_nights THEN 'behind' WHEN nights_on_books > p75_nights THEN 'ahead' ELSE 'on_track' END AS status, CASE WHEN days_out > 21 OR support < 7 THEN 'low' WHEN days_out > 10 OR support < 8 THEN 'medium' ELSE 'high' END AS confidence
        FROM (SELECT *, isodow(stay_date) AS dow FROM held) JOIN bench USING (as_of, property_key, dow, days_out) WHERE support >= 6 AND median_nights > 0 AND nights_on_books >= 3""",
    "finals": "SELECT property_key, stay_date, count(*) AS final_nights FROM booking_night WHERE entered_on <= stay_date AND (left_on IS NULL OR left_on > stay_date) GROUP BY ALL",
    "calls": "SELECT p.*, coalesce(f.final_nights, 0) AS final_nights, b.median_nights AS expected_final, coalesce(f.final_nights, 0) < b.median_nights AS finished_below FROM pace p JOIN bench b ON b.as_of = p.as_of AND b.property_key = p.property_key AND b.dow = isodow(p.stay_date) AND b.days_out = 0 LEFT JOIN finals f ON f.property_key = p.property_key AND f.stay_date = p.stay_date",
}


def _sql(query: str, many: bool = False, more: tuple = (), **ctes) -> str:
    return sql(query, "booking_night", "calendar", "unit", *more, asofs=_ASOFS if many else f"SELECT {_D} AS as_of", **_CTES, **ctes)


def _calls(m):
    d, many = demand(m), _many(m)
    return revenue.pace_calls(pace(m, many), revenue.final_book(d, dt.date(1995, 1, 1), dt.date(2001, 7, 31)), revenue.final_book_benchmark(d, calendar(m), many))


_EVAL = f"""SELECT *, {rdiv('below * 10000', 'calls')} AS base_bp, {rdiv('hits * 10000', 'behind')} AS precision_bp, {rdiv('hits * 10000', 'below')} AS recall_bp, {rdiv('naive_hits * 10000', 'naive')} AS naive_precision_bp, CASE WHEN behind = hits THEN 30000 // nullif(behind, 0) END AS rule_of_three_bp
 FROM (SELECT count(*) AS calls, count(*) FILTER (finished_below) AS below, count(*) FILTER (status = 'behind') AS behind, count(*) FILTER (status = 'behind' AND finished_below) AS hits, count(*) FILTER (gap_nights < 0) AS naive, count(*) FILTER (gap_nights < 0 AND finished_below) AS naive_hits FROM calls)"""
_BAND = "CASE WHEN days_out <= 3 THEN '1-3' WHEN days_out <= 7 THEN '4-7' WHEN days_out <= 14 THEN '8-14' ELSE '15-30' END"
QUERIES = {
    "r1_on_the_books": (lambda m: revenue.book(demand(m), _one(m), 30), sql(f"SELECT {_D} AS as_of, property_key, stay_date, count(*) AS nights_on_books, CAST(sum(night_paise) AS BIGINT) AS revenue_paise, date_diff('day', {_D}, stay_date) AS days_out FROM booking_night WHERE entered_on <= {_D} AND stay_date > {_D} AND stay_date <= {_D} + 30 AND (left_on IS NULL OR left_on > {_D}) GROUP BY ALL", "booking_night")),
    "r2_pickup": (
        lambda m: revenue.pickup(demand(m), AS_OF),
        sql(f"""SELECT d AS activity_date, CAST(sum(a) AS BIGINT) AS nights_added, CAST(sum(c) AS BIGINT) AS nights_cancelled, CAST(sum(a - c) AS BIGINT) AS nights_net, CAST(sum(a * v) AS BIGINT) AS revenue_added_paise, CAST(sum(c * v) AS BIGINT) AS revenue_cancelled_paise FROM (SELECT entered_on AS d, 1 AS a, 0 AS c, night_paise AS v FROM booking_night
        UNION ALL SELECT left_on, 0, 1, night_paise FROM booking_night) WHERE d > {_D} - 14 AND d <= {_D} GROUP BY 1""", "booking_night"),
    ),
    "r3_pace_benchmark": (lambda m: revenue.pace_benchmark(demand(m), calendar(m), _one(m)), _sql("SELECT as_of, property_key, CAST(dow AS INT) AS dow, days_out, median_nights, p25_nights, p75_nights, support FROM bench")),
    "r4_pace": (lambda m: pace(m, _one(m)), _sql("SELECT * FROM pace")),
    "r5_need_dates": (lambda m: revenue.need_dates(pace(m, _many(m), least=1, material=1)), _sql("SELECT * FROM pace WHERE status = 'behind'", True).replace("< 4 THEN 'on_track'", "< 1 THEN 'on_track'").replace("nights_on_books >= 3", "nights_on_books >= 1")),
    "r5_constrained_dates": (lambda m: revenue.constrained_dates(pace(m, _many(m))), _sql("SELECT * FROM pace WHERE status = 'ahead'", True)),
    "r6_signals": (
        lambda m: revenue.signals(pace(m, revenue.as_of_table(m.spark, BUSY))),
        _sql("""SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY kind, o, stay_date, property_key) AS INT) AS rank, status, property_key, stay_date, gap_nights, nights_on_books || ' nights on the books, ' || CAST(floor(median_nights) AS BIGINT) || ' expected at ' || days_out || ' days out' AS evidence FROM (
        (SELECT *, 0 AS kind, gap_nights AS o FROM pace WHERE status = 'behind' ORDER BY gap_nights, stay_date, property_key LIMIT 6) UNION ALL (SELECT *, 1, -gap_nights FROM pace WHERE status = 'ahead' ORDER BY gap_nights DESC, stay_date, property_key LIMIT 12))) WHERE rank <= 12""").replace(_D, f"DATE '{BUSY}'"),
    ),
    "r7_summary": (
        lambda m: revenue.rm_summary(demand(m), pace(m, _one(m)), AS_OF),
        _sql(f"""SELECT * FROM (SELECT CAST(coalesce(sum(nights_on_books), 0) AS BIGINT) AS nights_otb, CAST(coalesce(sum(revenue_paise), 0) AS BIGINT) AS revenue_otb_paise FROM held WHERE days_out <= 30),
        (SELECT (SELECT count(*) FROM booking_night WHERE entered_on > {_D} - 14 AND entered_on <= {_D}) - (SELECT count(*) FROM booking_night WHERE left_on > {_D} - 14 AND left_on <= {_D}) AS pickup_net), (SELECT count(*) FILTER (status = 'behind') AS behind, count(*) FILTER (status = 'ahead') AS ahead, count(*) FILTER (status = 'on_track') AS on_track FROM pace)"""),
    ),
    "r8_data_horizon": (lambda m: revenue.data_horizon(unit_nights(m).where("is_occupied")), sql("SELECT max(stay_date) AS horizon, max(stay_date) - 30 AS default_as_of FROM unit_night WHERE is_occupied", "unit_night")),
    "r9_final_book_benchmark": (lambda m: revenue.final_book_benchmark(demand(m), calendar(m), _many(m)), _sql("SELECT as_of, property_key, CAST(dow AS INT) AS dow, median_nights AS expected_final, support FROM bench WHERE days_out = 0", True)),
    "r10_final_book": (lambda m: revenue.final_book(demand(m), dt.date(1996, 1, 1), dt.date(2000, 12, 31)), _sql("SELECT * FROM finals WHERE stay_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")),
    "r11_tightest_date": (
        lambda m: revenue.tightest_date(demand(m), daily(m).select("property_key", "stay_date", "available"), 7, 10),
        sql(f"SELECT * FROM (SELECT property_key, stay_date, 7 AS days_out, on_books, available, {rdiv('on_books * 10000', 'available')} AS load_bp FROM (SELECT d.property_key, d.stay_date, d.available, count(n.booking_key) AS on_books FROM daily d LEFT JOIN booking_night n ON n.property_key = d.property_key AND n.stay_date = d.stay_date AND n.entered_on <= d.stay_date - 7 AND (n.left_on IS NULL OR n.left_on > d.stay_date - 7) WHERE available > 0 GROUP BY ALL)) ORDER BY load_bp DESC, stay_date, property_key LIMIT 10", "daily", "booking_night"),
    ),
    "m17_nights_on_books": (lambda m: revenue.book(demand(m), _many(m), 400).groupBy("as_of").agg(F.sum("nights_on_books").alias("nights_on_books")), sql("SELECT as_of, count(*) AS nights_on_books FROM booking_night, asofs WHERE entered_on <= as_of AND stay_date > as_of AND (left_on IS NULL OR left_on > as_of) GROUP BY 1", "booking_night", asofs=_ASOFS)),
    "m19_booking_pace": (lambda m: pace(m, _many(m)).groupBy("as_of", "property_key").agg(F.sum("nights_on_books").alias("nights_on_books"), F.sum((F.col("median_nights") * 2).cast("long")).alias("twice_expected")), _sql("SELECT as_of, property_key, CAST(sum(nights_on_books) AS BIGINT) AS nights_on_books, CAST(sum(CAST(median_nights * 2 AS BIGINT)) AS BIGINT) AS twice_expected FROM pace GROUP BY ALL", True)),
    "p1_reconstruct_many": (_calls, _sql("SELECT * FROM calls", True)),
    "p6_pooled_replay": (
        lambda m: revenue.pooled_replay(_calls(m)),
        _sql(f"SELECT {_BAND} AS band, count(*) AS calls, count(*) FILTER (status = 'behind') AS behind, count(*) FILTER (finished_below) AS below, round(avg(abs(expected_final - final_nights)), 6) AS mae, round(avg(expected_final - final_nights), 6) AS bias, round(avg(abs(nights_on_books - final_nights)), 6) AS naive_mae FROM calls GROUP BY 1", True),
    ),
    "p4_pace_evaluation": (lambda m: revenue.pace_evaluation(_calls(m)), _sql(_EVAL, True)),
    "p5_replay_coverage": (
        lambda m: revenue.replay_coverage(pace(m, _many(m)), revenue.data_horizon(unit_nights(m).where("is_occupied"))),
        _sql("SELECT as_of, count(*) AS calls, count(*) FILTER (stay_date <= (SELECT max(stay_date) FROM unit_night WHERE is_occupied)) AS resolvable FROM pace GROUP BY 1", True, ("unit_night",)),
    ),
    "l4_opportunity_radar": (lambda m: alerts.opportunity_radar(pace(m, revenue.as_of_table(m.spark, BUSY))), _sql("SELECT property_key, stay_date, days_out, gap_nights, revenue_paise FROM pace WHERE status = 'ahead'").replace(_D, f"DATE '{BUSY}'")),
    "l5_holiday_bias": (
        lambda m: alerts.holiday_bias(pace(m, _many(m)), context(m)),
        _sql(f"SELECT *, {bp('near', 'judged')} AS base_bp, {bp('near_alerts', 'alerts')} AS alert_bp FROM (SELECT as_of, count(*) AS judged, count(*) FILTER (is_holiday_adjacent) AS near, count(*) FILTER (status = 'behind') AS alerts, count(*) FILTER (status = 'behind' AND is_holiday_adjacent) AS near_alerts FROM pace JOIN day_context ON full_date = stay_date GROUP BY 1)", True, ("day_context",)),
    ),
}
