"""Queries of the alert queue over its four sources (L), and of all that was known at a decision date (P)."""

from __future__ import annotations


from ..operators import alerts, anomaly, quality, revenue, views
from .analytics import _KPI, _PORT, _PORT_ANOM, _outliers, portfolio
from .base import bp, sql
from .dq import results
from .layer import AS_OF, context, daily, demand, unit_nights
from .revenue import _CTES, _D, _many, _one, _sql, calendar, pace


def anomalies(m):
    """Anomalies of the portfolio and of the revenue of each property."""
    return anomaly.portfolio_anomalies(portfolio(m)).unionByName(anomaly.detect(daily(m), "revenue_paise", ("property_key",), gate=100_000))


_PROPERTIES = _outliers("SELECT property_key, stay_date, CAST(revenue_paise AS DOUBLE) AS actual FROM daily", "revenue_paise", "CAST(property_key AS VARCHAR)", "property_key, ", "100000")


def _queue(m):
    scores = quality.scored(results(m))
    return alerts.alert_queue(alerts.pace_alerts(pace(m, _one(m))), alerts.anomaly_alerts(anomalies(m), AS_OF), alerts.rule_alerts(scores), alerts.sla_alerts(views.service_kpi(m.requests())))


_QUEUE_CTES = {
    "sla": f"SELECT *, {bp('b', 'n')} AS breach_bp FROM (SELECT property_key, day_part, owning_team, count(*) AS n, count(*) FILTER (is_sla_breached) AS b FROM request WHERE resolution_minutes IS NOT NULL GROUP BY ALL HAVING count(*) >= 15)",
    "queue": """SELECT *, CAST(row_number() OVER (ORDER BY CASE band WHEN 'act_now' THEN 0 WHEN 'investigate' THEN 1 ELSE 2 END, days ASC NULLS LAST, measure DESC, source, subject) AS INT) AS rank FROM (
        SELECT 'act_now' AS band, 'pace' AS source, property_key || ' ' || stay_date AS subject, stay_date AS on_date, days_out AS days, CAST(abs(gap_nights) AS DOUBLE) AS measure, 'room-nights' AS unit FROM pace WHERE status = 'behind'
        UNION ALL SELECT 'investigate', 'anomaly', metric || ' ' || segment, stay_date, date_diff('day', stay_date, AS_OF), abs(robust_z), 'robust z' FROM anomalies WHERE stay_date BETWEEN AS_OF - 45 AND AS_OF
        UNION ALL SELECT 'standing', 'quality', rule_id, NULL, NULL, CAST(failure_bp AS DOUBLE), 'bp failed' FROM scored WHERE NOT passed
        UNION ALL SELECT 'standing', 'sla', property_key || ' ' || day_part || ' ' || owning_team, NULL, NULL, CAST(breach_bp AS DOUBLE), 'bp breached' FROM sla WHERE breach_bp >= (SELECT quantile_cont(breach_bp, 0.75) FROM sla) AND b >= 20)""".replace("AS_OF", _D),
}


def _queue_sql(query: str) -> str:
    """The queue over all sources, as one statement: the rules' CTEs and the pace CTEs together."""
    from .dq import _NEED, ALL_SQL, INVENTORY, RUNS, SCORED

    return sql(query, *_NEED, "daily", "booking_night", "calendar", "unit", "day_context", inventory=INVENTORY, runs=RUNS, results=ALL_SQL, scored=SCORED, asofs=f"SELECT {_D} AS as_of", port=_PORT, anomalies=f"{_PORT_ANOM} UNION ALL {_PROPERTIES}", **_CTES, **_QUEUE_CTES)


def reconstructed(m):
    d, many = demand(m), _many(m)
    return revenue.reconstruct(d, unit_nights(m), calendar(m), views.daily_kpi_calendar(daily(m), context(m)), context(m), many)


_PAST_PAIRS = """SELECT as_of, t.property_key, t.stay_date, t.nearest_holiday AS holiday, t.occupancy_bp, quantile_cont(k.occupancy_bp, 0.5) AS baseline_bp FROM asofs JOIN kpi t ON t.stay_date < as_of JOIN kpi k ON k.property_key = t.property_key AND k.stay_date < as_of AND isodow(k.stay_date) = isodow(t.stay_date) AND NOT k.is_holiday_adjacent
 AND k.stay_date BETWEEN t.stay_date - 56 AND t.stay_date + 56 WHERE t.is_holiday_adjacent AND t.occupancy_bp IS NOT NULL AND k.occupancy_bp IS NOT NULL GROUP BY ALL HAVING count(*) >= 4"""
_KNOWN = """SELECT as_of, 'book' AS section, property_key, stay_date, unnest(['nights_on_books', 'revenue_paise']) AS label, unnest([nights_on_books, revenue_paise]) AS value FROM held WHERE days_out <= 30
 UNION ALL SELECT as_of, 'pickup', NULL, NULL, 'net_nights', CAST(sum(n) AS BIGINT) FROM asofs, (SELECT entered_on AS d, 1 AS n FROM booking_night UNION ALL SELECT left_on, -1 FROM booking_night) WHERE d <= as_of AND d > as_of - 14 GROUP BY as_of
 UNION ALL SELECT as_of, 'realised', property_key, NULL, unnest(['sold', 'available', 'revenue_paise']), unnest([s, a, r]) FROM (SELECT as_of, property_key, CAST(sum(sold) AS BIGINT) AS s, CAST(sum(available) AS BIGINT) AS a, CAST(sum(revenue_paise) AS BIGINT) AS r FROM asofs, daily WHERE stay_date <= as_of AND stay_date > as_of - 28 GROUP BY ALL)
 UNION ALL SELECT as_of, 'calendar', NULL, full_date, nearest_holiday, days_to_holiday FROM asofs, day_context WHERE is_holiday_adjacent AND full_date > as_of AND full_date <= as_of + 30
 UNION ALL SELECT as_of, 'effect observations', NULL, NULL, holiday, count(*) FROM past_pairs GROUP BY as_of, holiday
 UNION ALL SELECT as_of, 'effect', NULL, NULL, holiday, CAST(sum(2 * (occupancy_bp - baseline_bp)) AS BIGINT) FROM past_pairs GROUP BY as_of, holiday
 UNION ALL SELECT as_of, 'forecast', property_key, NULL, CAST(isodow(stay_date) AS VARCHAR), CAST(sum(sold) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY as_of, property_key, isodow(stay_date) ORDER BY stay_date DESC) AS r FROM asofs, daily WHERE stay_date < as_of) WHERE r <= 4 GROUP BY as_of, property_key, isodow(stay_date)
 UNION ALL SELECT as_of, 'pace', property_key, stay_date, status, CAST(gap_nights * 4 AS BIGINT) FROM pace
 UNION ALL SELECT as_of, 'expected final', property_key, stay_date, 'nights', CAST(expected_final * 4 AS BIGINT) FROM calls"""


def _known_sql(query: str) -> str:
    return _sql(query, True, ("daily", "day_context"), kpi=_KPI, past_pairs=_PAST_PAIRS, known=_KNOWN)


QUERIES = {
    "p1_decision_inputs": (reconstructed, _known_sql("SELECT * FROM known")),
    "p2_fingerprint": (
        lambda m: revenue.fingerprint(reconstructed(m)),
        _known_sql("SELECT count(*) AS n, CAST(CAST(sum(CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("as_of", "label", "property_key", "section", "stay_date", "value")) + ")), 1, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS fingerprint FROM known"),
    ),
    "l1_alert_queue": (_queue, _queue_sql("SELECT * FROM queue")),
    "l2_with_calendar": (
        lambda m: alerts.with_calendar(_queue(m), context(m)),
        _queue_sql("SELECT q.*, CASE WHEN source = 'pace' AND is_holiday_adjacent THEN days_to_holiday || ' days from ' || nearest_holiday END AS calendar_note FROM queue q LEFT JOIN day_context ON full_date = on_date"),
    ),
    "l4_alert_summary": (lambda m: alerts.alert_summary(_queue(m)), _queue_sql("SELECT band, source, count(*) AS alerts, min(days) AS soonest_days FROM queue GROUP BY ALL")),
}
