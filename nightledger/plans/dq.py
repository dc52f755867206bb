"""Queries of the data-quality rules (Q) and of keyed results (S10, S11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import quality
from .base import bp, rdiv, sql
from .layer import daily, unit_nights

NOW = dt.datetime(2024, 2, 1, 12)


def tables(m):
    return {"guest": m.guests(), "booking": m.bookings(), "review": m.reviews(), "unit_night": unit_nights(m), "inventory": m.inventory(), "payment": m.payments(), "request": m.requests(), "daily": daily(m)}


def results(m):
    return quality.run_all(tables(m), NOW)


INVENTORY = "SELECT *, opening + received - consumed - wastage + CASE WHEN k % 211 = 0 THEN 1 ELSE 0 END AS closing FROM (SELECT l_orderkey AS k, l_orderkey % 50 AS opening, CAST(trunc(l_quantity) AS BIGINT) AS received, (l_orderkey * 7) % 60 AS consumed, CAST(l_linenumber AS BIGINT) AS wastage FROM lineitem)"
RUNS = """SELECT channel, min(request_date) AS from_date, max(request_date) AS to_date, count(*) AS quiet_days FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY request_date) - row_number() OVER (PARTITION BY channel, quiet ORDER BY request_date) AS island FROM (
 SELECT *, n = 0 AND coalesce(avg(n) OVER (PARTITION BY channel ORDER BY request_date ROWS BETWEEN 56 PRECEDING AND 1 PRECEDING), 0) >= 1.0 AS quiet FROM (SELECT c.channel, d.request_date, count(r.request_key) AS n FROM (SELECT DISTINCT channel FROM request WHERE channel IS NOT NULL) c
 CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(min(request_date) AS TIMESTAMP), CAST(max(request_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS request_date FROM request) d LEFT JOIN request r ON r.channel = c.channel AND r.request_date = d.request_date GROUP BY ALL))) WHERE quiet GROUP BY channel, island HAVING count(*) >= 4"""


def _rows(table: str, **fails: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS rows_checked, count(*) FILTER ({v}) AS rows_failed FROM {table}" for k, v in fails.items())


_DUP = "SELECT '{}' AS rule_id, CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n - 1) FILTER (n > 1 AND {} IS NOT NULL), 0) AS BIGINT) FROM (SELECT {}, count(*) AS n FROM {} GROUP BY ALL)"
ALL_SQL = " UNION ALL ".join([
    _rows("guest", DQ001="phone IS NULL OR email IS NULL"),
    _rows("booking", DQ002="channel_code IS NULL", DQ020="nights > 0 AND check_out_date <= check_in_date", DQ022="status NOT IN ('cancelled', 'no_show') AND net_paise <= 0", DQ023="stay_type = 'nightly' AND (nights < 0 OR nights > 60)", DQ024="lead_days < 0", DQ032="(status = 'cancelled') <> (cancel_date IS NOT NULL)", DQ040="booking_date <> CAST(booked_at + INTERVAL 330 MINUTE AS DATE)"),
    _rows("review", DQ003="half_stars IS NULL", DQ021="half_stars NOT BETWEEN 2 AND 10"), _rows("unit_night", DQ004="property_key IS NULL", DQ035="NOT is_occupied AND revenue_paise <> 0", DQ036="is_out_of_order AND is_sellable"),
    _rows("inventory", DQ025="opening + received - consumed - wastage <> closing", DQ026="closing < 0"), _rows("payment", DQ030="booking_key IS NULL"),
    _rows("request", DQ037="is_sla_breached IS DISTINCT FROM (resolution_minutes > sla_minutes)", DQ038="resolution_minutes < 0", DQ041="request_date <> CAST(created_at + INTERVAL 330 MINUTE AS DATE)"),
    _DUP.format("DQ010", "guest_key", "guest_key, unit_key, check_in_date", "booking"), _DUP.format("DQ011", "phone_last10", "phone_last10", "guest_norm"), _DUP.format("DQ012", "unit_key", "unit_key, stay_date", "unit_night"),
    "SELECT 'DQ031', count(*), count(*) FILTER (abs(gross_paise - net_paise) > 100) FROM payment p JOIN booking b ON b.booking_key = p.booking_key",
    "SELECT 'DQ033', count(*), count(*) FILTER (status IN ('cancelled', 'no_show')) FROM unit_night u JOIN booking b ON b.booking_key = u.booking_key WHERE is_occupied",
    "SELECT 'DQ034', count(*), count(*) FILTER (stay_date >= check_out_date) FROM unit_night u JOIN booking b ON b.booking_key = u.booking_key WHERE is_occupied AND u.stay_type = 'nightly'",
    f"SELECT 'DQ050', count(*), CASE WHEN max(created_at) < TIMESTAMP '{NOW}' - INTERVAL 26 HOUR THEN count(*) ELSE 0 END FROM request",
    "SELECT 'DQ051', (SELECT (date_diff('day', min(request_date), max(request_date)) + 1) * count(DISTINCT channel) FROM request), CAST(coalesce(sum(quiet_days), 0) AS BIGINT) FROM runs",
    "SELECT 'DQ060', count(*), count(*) FILTER (p.booking_key IS NULL) FROM booking b LEFT JOIN payment p ON p.booking_key = b.booking_key WHERE b.status <> 'cancelled'",
    "SELECT 'DQ061', count(*), count(*) FILTER (sold > available) FROM daily",
])
_NEED = ("guest_norm", "booking", "review", "unit_night", "payment", "request", "daily")
_META = ", ".join(f"('{r.rule_id}', '{r.dimension}', '{r.severity}', {r.threshold_bp}, '{r.defect}')" for r in quality.RULES)
SCORED = f"SELECT rule_id, dimension, severity, threshold_bp, defect, rows_checked, rows_failed, CASE WHEN rows_checked = 0 THEN 0 ELSE {bp('rows_failed', 'rows_checked')} END AS failure_bp, coalesce(rows_failed * 10000 <= rows_checked * threshold_bp, false) AS passed FROM (VALUES {_META}) m(rule_id, dimension, severity, threshold_bp, defect) LEFT JOIN results USING (rule_id)"


def _scored_sql(query: str) -> str:
    return sql(query, *_NEED, inventory=INVENTORY, runs=RUNS, results=ALL_SQL, scored=SCORED)


_W = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
QUERIES = {
    "q_rules": (lambda m: quality.scored(results(m)), _scored_sql("SELECT * FROM scored")),
    "q27_silent_feed": (lambda m: quality.silent_runs(m.requests()), sql("SELECT * FROM runs", "request", runs=RUNS)),
    "q30_score": (lambda m: quality.quality_score(quality.scored(results(m))), _scored_sql(f"SELECT count(*) AS rules, count(*) FILTER (passed) AS rules_passed, {bp(f'sum({_W}) FILTER (passed)', f'sum({_W})')} AS score_bp FROM scored")),
    "q31_defect_recall": (lambda m: quality.defect_recall(quality.scored(results(m))), _scored_sql("SELECT defect, CAST(sum(rows_failed) AS BIGINT) AS rows_found, sum(rows_failed) > 0 AS detected FROM scored GROUP BY 1")),
    "k27_dq_by_dimension": (lambda m: quality.by_dimension(quality.scored(results(m))), _scored_sql("SELECT dimension, count(*) AS rules, count(*) FILTER (passed) AS rules_passed FROM scored GROUP BY 1")),
    "q32_freshness": (
        lambda m: quality.freshness({"request": (m.requests(), "created_at"), "booking": (m.bookings(), "booked_at"), "payment": (m.payments(), "payment_date")}, NOW),
        sql(f"SELECT source, last_seen, {rdiv(f'date_diff({chr(39)}second{chr(39)}, date_trunc({chr(39)}second{chr(39)}, last_seen), TIMESTAMP {chr(39)}{NOW}{chr(39)})', '3600')} AS hours_old FROM (SELECT 'request' AS source, max(created_at) AS last_seen FROM request UNION ALL SELECT 'booking', max(booked_at) FROM booking UNION ALL SELECT 'payment', CAST(max(payment_date) AS TIMESTAMP) FROM payment)", "request", "booking", "payment"),
    ),
    "q_sample_keys": (
        lambda m: quality.sample_keys(m.bookings(), "DQ040", "booking_key").unionByName(quality.sample_keys(m.payments(), "DQ030", "payment_key")).unionByName(quality.sample_keys(m.requests(), "DQ037", "request_key")),
        sql("""(SELECT 'DQ040' AS rule_id, CAST(booking_key AS VARCHAR) AS sample_key FROM booking WHERE booking_date <> CAST(booked_at + INTERVAL 330 MINUTE AS DATE) ORDER BY booking_key LIMIT 5) UNION ALL (SELECT 'DQ030', CAST(payment_key AS VARCHAR) FROM payment WHERE booking_key IS NULL ORDER BY payment_key LIMIT 5)
        UNION ALL (SELECT 'DQ037', CAST(request_key AS VARCHAR) FROM request WHERE is_sla_breached IS DISTINCT FROM (resolution_minutes > sla_minutes) ORDER BY request_key LIMIT 5)""", "booking", "payment", "request"),
    ),
    "q5_duplicate_samples": (
        lambda m: quality.duplicate_samples(m.bookings(), ["guest_key", "check_in_date"], "booking_key"),
        sql("SELECT min(booking_key) AS sample_key, count(*) AS n FROM booking GROUP BY guest_key, check_in_date HAVING count(*) > 1 ORDER BY 1 LIMIT 5", "booking"),
    ),
    "s10_latest_request": (
        lambda m: quality.latest_by(m.requests().select("channel", "property_key", "created_at", "request_key"), ["channel", "property_key"], ["created_at", "request_key"]),
        sql("SELECT channel, property_key, max(created_at) AS created_at, arg_max(request_key, (created_at, request_key)) AS request_key FROM request GROUP BY ALL", "request"),
    ),
    "s11_upsert": (
        lambda m: quality.upsert(m.bookings().select("booking_key", "status"), m.bookings().where("status = 'cancelled'").select(F.col("booking_key") + 1, F.lit("rebooked")).toDF("booking_key", "status"), ["booking_key"]),
        sql("SELECT booking_key, status FROM booking WHERE booking_key NOT IN (SELECT booking_key + 1 FROM booking WHERE status = 'cancelled') UNION ALL SELECT booking_key + 1, 'rebooked' FROM booking WHERE status = 'cancelled'", "booking"),
    ),
}
