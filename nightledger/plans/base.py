"""DuckDB SQL of the model's tables: the counterpart of sources.adapter and of the grain builders."""

from __future__ import annotations


def rdiv(n: str, d: str) -> str:
    """functions.money.rounded_div in SQL."""
    return f"(CASE WHEN ({d}) <> 0 THEN CAST(sign({n}) AS BIGINT) * ((2 * abs({n}) + ({d})) // (2 * ({d}))) END)"


def bp(part: str, whole: str) -> str:
    return rdiv(f"CAST({part} AS BIGINT) * 10000", f"CAST({whole} AS BIGINT)")


_PARTS = {
    "unit_count": "SELECT greatest(1, count(*) // 2500) AS u FROM orders",
    "o": """SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS net_paise, o_orderpriority AS channel_code,
        n_regionkey + 1 AS property_key, o_orderdate, o_orderdate + to_seconds((o_orderkey * 104729) % 86400) AS booked_at, (o_orderkey * 7919) % 1000 AS uu,
        CASE WHEN (o_orderkey * 31) % 13 = 0 THEN 0 ELSE 1 + (o_orderkey * 17) % 6 END AS nights
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "booking": """SELECT k AS booking_key, o_custkey AS guest_key, CAST(property_key AS INT) AS property_key, CAST(property_key * 10000 + k % (SELECT u FROM unit_count) AS INT) AS unit_key, channel_code, booked_at,
        booking_date, CAST(lead_days AS INT) AS lead_days, CAST(nights AS INT) AS nights, CAST(1 + k % 3 AS INT) AS adults, status, net_paise,
        booking_date + CAST(lead_days AS INT) AS check_in_date, booking_date + CAST(lead_days + nights AS INT) AS check_out_date,
        CASE WHEN status = 'cancelled' THEN booking_date + CAST((k * 13) % (lead_days + 1) AS INT) END AS cancel_date,
        CASE WHEN nights = 0 THEN 'microstay' ELSE 'nightly' END AS stay_type, net_paise * 15 // 100 AS commission_paise, CASE WHEN k % 7 = 0 THEN net_paise * 5 // 100 ELSE 0 END AS discount_paise
        FROM (SELECT *, uu * uu * uu // 16666667 AS lead_days,
            CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-12' AND DATE '1998-03-15' THEN CAST(booked_at AS DATE) ELSE CAST(booked_at + INTERVAL 330 MINUTE AS DATE) END AS booking_date,
            CASE WHEN st = 'P' AND k % 2 = 0 THEN 'cancelled' WHEN st = 'P' AND k % 22 = 1 THEN 'no_show' ELSE 'checked_out' END AS status FROM o)""",
    "unit": """SELECT property_key, unit_key, ['studio', 'one_bed', 'two_bed', 'three_bed'][1 + unit_key % 4] AS unit_type, CAST(300000 + 200000 * (unit_key % 4) AS BIGINT) AS base_rate_paise
        FROM (SELECT CAST(p AS INT) AS property_key, CAST(p * 10000 + i AS INT) AS unit_key FROM unit_count, range(1, 6) t(p), range(0, u) s(i))""",
    "channel": "SELECT * FROM (VALUES ('1-URGENT', 'ota'), ('2-HIGH', 'direct'), ('3-MEDIUM', 'corporate'), ('4-NOT SPECIFIED', 'walk_in'), ('5-LOW', 'hourly')) v(channel_code, channel_type)",
    "booking_night": """SELECT booking_key, property_key, unit_key, channel_code, guest_key, CAST(sd AS DATE) AS stay_date, booking_date AS entered_on, cancel_date AS left_on, status, stay_type, nights,
        date_diff('day', booking_date, CAST(sd AS DATE)) AS days_to_arrival, date_diff('day', check_in_date, CAST(sd AS DATE)) + 1 AS night_index, net_paise // nights AS night_paise, commission_paise // nights AS night_commission_paise
        FROM (SELECT *, unnest(generate_series(CAST(check_in_date AS TIMESTAMP), CAST(check_out_date AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS sd FROM booking WHERE check_out_date > check_in_date)""",
    "calendar": "SELECT CAST(d AS DATE) AS stay_date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-31', INTERVAL 1 DAY) t(d)",
    "placed": """SELECT unit_key, stay_date, min(booking_key) AS booking_key FROM (
        SELECT unit_key, stay_date, booking_key FROM booking_night WHERE status NOT IN ('cancelled', 'no_show')
        UNION ALL SELECT unit_key, check_in_date, booking_key FROM booking WHERE nights = 0 AND status NOT IN ('cancelled', 'no_show')) GROUP BY ALL""",
    "unit_night": """SELECT g.unit_key, g.property_key, g.stay_date, CASE WHEN ooo THEN NULL ELSE b.booking_key END AS booking_key, CASE WHEN ooo THEN NULL ELSE b.channel_code END AS channel_code,
        NOT ooo AS is_sellable, NOT ooo AND b.booking_key IS NOT NULL AS is_occupied, ooo AS is_out_of_order, CASE WHEN ooo THEN NULL ELSE b.stay_type END AS stay_type,
        CASE WHEN ooo OR b.booking_key IS NULL THEN 0 ELSE b.net_paise // greatest(b.nights, 1) END AS revenue_paise, CASE WHEN ooo OR b.booking_key IS NULL THEN 0 ELSE b.commission_paise // greatest(b.nights, 1) END AS commission_paise
        FROM (SELECT *, (unit_key * 31 + date_diff('day', DATE '1995-01-01', stay_date)) % 50 = 0 AS ooo FROM unit, calendar) g
        LEFT JOIN placed p ON p.unit_key = g.unit_key AND p.stay_date = g.stay_date LEFT JOIN booking b ON b.booking_key = p.booking_key""",
    "enriched": f"""SELECT *, {rdiv("revenue_paise * gst_pct", "100")} AS gst_paise, revenue_paise + {rdiv("revenue_paise * gst_pct", "100")} AS gross_paise, revenue_paise - commission_paise AS net_after_commission_paise
        FROM (SELECT *, CASE WHEN revenue_paise > 750000 THEN 18 WHEN stay_date >= DATE '1998-09-22' THEN 5 ELSE 12 END AS gst_pct FROM unit_night)""",
    "daily": """SELECT property_key, stay_date, count(*) AS physical, count(*) FILTER (is_sellable) AS available, count(*) FILTER (is_out_of_order) AS out_of_order, count(*) FILTER (is_occupied) AS sold,
        count(*) FILTER (is_occupied AND stay_type = 'microstay') AS microstay_sold, CAST(sum(revenue_paise) AS BIGINT) AS revenue_paise, CAST(sum(gross_paise) AS BIGINT) AS gross_paise, CAST(sum(gst_paise) AS BIGINT) AS gst_paise,
        CAST(sum(commission_paise) AS BIGINT) AS commission_paise, CAST(coalesce(sum(revenue_paise) FILTER (stay_type <> 'microstay'), 0) AS BIGINT) AS nightly_revenue_paise FROM enriched GROUP BY ALL""",
    "holiday": """SELECT make_date(CAST(y AS INT), m, d) AS holiday_date, n AS holiday_name FROM range(1995, 2002) t(y), (VALUES (1, 26, 'republic'), (5, 1, 'labour'), (8, 15, 'independence'), (10, 2, 'gandhi'), (12, 25, 'christmas')) v(m, d, n)""",
    "day_context": """SELECT full_date, is_public_holiday, nearest.n AS nearest_holiday, date_diff('day', nearest.d, full_date) AS days_to_holiday, coalesce(abs(date_diff('day', nearest.d, full_date)) <= 7, false) AS is_holiday_adjacent,
        NOT off AND coalesce(lag(off) OVER (ORDER BY full_date), false) AND coalesce(lead(off) OVER (ORDER BY full_date), false) AS is_bridge_day, off AND run_days >= 3 AS is_long_weekend
        FROM (SELECT *, count(*) OVER (PARTITION BY off, run) AS run_days FROM (
            SELECT *, row_number() OVER (ORDER BY full_date) - row_number() OVER (PARTITION BY off ORDER BY full_date) AS run FROM (
                SELECT c.stay_date AS full_date, h.holiday_date IS NOT NULL AS is_public_holiday, isodow(c.stay_date) >= 6 OR h.holiday_date IS NOT NULL AS off,
                (SELECT min_by({'d': x.holiday_date, 'n': x.holiday_name}, abs(date_diff('day', x.holiday_date, c.stay_date)) * 100000 + date_diff('day', DATE '1990-01-01', x.holiday_date)) FROM holiday x) AS nearest
                FROM calendar c LEFT JOIN holiday h ON h.holiday_date = c.stay_date)))""",
    "payment": """SELECT *, gross_paise - fee_paise - gst_on_fee_paise AS credited_paise FROM (SELECT *, fee_paise * 18 // 100 AS gst_on_fee_paise FROM (SELECT *, gross_paise * 2 // 100 AS fee_paise FROM (
        SELECT booking_key AS payment_key, CASE WHEN booking_key % 113 <> 0 THEN booking_key END AS booking_key, 'B' || booking_key AS booking_id_raw, booking_date AS payment_date,
        CASE WHEN booking_key % 97 <> 0 THEN booking_date + 2 END AS settlement_date, CASE WHEN booking_key % 41 = 0 THEN net_paise * 105 // 100 ELSE net_paise END AS gross_paise FROM booking WHERE status <> 'cancelled')))""",
    "guest": """SELECT c_custkey AS guest_key, '+91 9' || lpad(CAST(CASE WHEN c_custkey % 25 = 1 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR), 9, '0') AS phone, CASE WHEN c_custkey % 16 <> 0 THEN 'Guest.' || c_custkey || '@Mail.Example' END AS email, c_mktsegment AS guest_segment FROM customer""",
    "guest_norm": """SELECT *, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_last10, replace(lower(split_part(email, '@', 1)), '.', '') || '@' || lower(split_part(email, '@', 2)) AS email_normalised FROM guest""",
    "request": """SELECT * FROM (SELECT *, CASE WHEN request_key % 101 = 0 THEN NOT (resolution_minutes > sla_minutes) ELSE resolution_minutes > sla_minutes END AS is_sla_breached FROM (
        SELECT event_id AS request_key, ts AS created_at, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS request_date, event_type AS channel, CAST(1 + user_id % 5 AS INT) AS property_key, CAST(event_id % 10 AS INT) AS request_type,
        'team' || (event_id % 10) % 3 AS owning_team, 'category' || (event_id % 10) // 2 AS category, CAST(5 * (1 + event_id % 10) AS INT) AS sla_minutes, CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value) AS INT) END AS resolution_minutes,
        CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 5 AS INT) END AS csat,
        CASE WHEN hour(ts + INTERVAL 330 MINUTE) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts + INTERVAL 330 MINUTE) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts + INTERVAL 330 MINUTE) >= 18 THEN 'evening' ELSE 'overnight' END AS day_part FROM events))
        WHERE NOT (channel = 'signup' AND request_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-20')""",
    "review": """SELECT doc_id AS review_id, CAST(1 + doc_id % 5 AS INT) AS property_key, DATE '2000-01-01' + CAST(doc_id % 365 AS INT) AS review_date, CAST(2 + (doc_id * 7) % 9 AS INT) AS half_stars, text AS review_text, lang AS language FROM documents""",
}
_NEEDS = {
    "booking": ["unit_count", "o"], "unit": ["unit_count"], "booking_night": ["booking"], "placed": ["booking", "booking_night"], "unit_night": ["unit", "calendar", "placed", "booking"], "enriched": ["unit_night"], "daily": ["enriched"],
    "day_context": ["calendar", "holiday"], "payment": ["booking"], "guest_norm": ["guest"],
}


def sql(query: str, *tables: str, **ctes: str) -> str:
    """``query`` with the CTEs of the model tables it needs, and further CTEs in order."""
    order: list[str] = []

    def need(name):
        for x in _NEEDS.get(name, ()):
            need(x)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    parts = [f"{n} AS ({_PARTS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
