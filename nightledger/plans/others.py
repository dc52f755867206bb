"""Queries of risk, scenarios, guest text, sources and streams (X, Z, T, S, ST)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from ..operators import kpi, risk, scenario, text, views
from ..session import scratch
from ..sources import files
from ..streaming import feeds
from .base import bp, rdiv, sql
from .kpis import _BRIEF
from .kpis import QUERIES as KPIS
from .layer import daily, demand, unit_nights

#: The reviews' language is invented, so the cue words are a parameter of the query.
LEXICON = text.Lexicon(
    negative=("worthless", "anin", "stth", "eren", "auxê", "schen"), positive=("thtion", "heon", "onen", "thest", "leon"), severe=("worthless", "eren"), moderate=("stth", "anin"),
    aspects=(("staff", ("the", "le", "der"), "front desk"), ("room", ("and", "la", "und"), "housekeeping"), ("price", ("of", "de", "von"), "revenue")), split=r"[.!?;\n]+",
)


def aspects(m):
    return text.classify_aspects(m.reviews(), LEXICON)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(words) -> str:
    return f"len(list_intersect(words, {_list(words)}))"


_SEV = f"CASE WHEN {_hits(LEXICON.severe)} > 0 THEN 'severe' WHEN {_hits(LEXICON.moderate)} > 0 THEN 'moderate' ELSE 'minor' END"
_ASPECTS = f"""SELECT review_id, category, polarity, severity, CASE WHEN polarity = 'negative' THEN team END AS actionable_by, span AS evidence_span FROM (SELECT *, row_number() OVER (PARTITION BY review_id, category, polarity ORDER BY pos) AS rn FROM (
 {' UNION ALL '.join(f"SELECT review_id, pos, '{n}' AS category, polarity, severity, '{team}' AS team, span FROM cl WHERE {_hits(keys)} > 0" for n, keys, team in LEXICON.aspects)})) WHERE rn = 1"""
_CLAUSES = f"""SELECT *, CASE WHEN {_hits(LEXICON.negative)} > {_hits(LEXICON.positive)} THEN 'negative' WHEN {_hits(LEXICON.positive)} > {_hits(LEXICON.negative)} THEN 'positive' END AS polarity, {_SEV} AS severity, substring(trim(clause), 1, 200) AS span FROM (
 SELECT review_id, pos, clause, list_filter(regexp_split_to_array(lower(clause), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM (SELECT review_id, unnest(c) AS clause, generate_subscripts(c, 1) AS pos FROM (SELECT review_id, regexp_split_to_array(review_text, '[.!?;\n]+') AS c FROM review WHERE trim(review_text) <> '')))"""
_TEXT = {"cl0": _CLAUSES, "cl": "SELECT * FROM cl0 WHERE polarity IS NOT NULL", "aspect": _ASPECTS}


def _text_sql(query: str, **more) -> str:
    return sql(query, "review", **_TEXT, **more)


def gold(m):
    """Labels that differ from the classifier's output: some aspects are missing, some have the other polarity."""
    a = aspects(m).where(F.col("review_id") % 7 != 0)
    other = F.when(F.col("polarity") == "negative", "positive").otherwise("negative")
    return a.withColumn("polarity", F.when(F.col("review_id") % 11 == 0, other).otherwise(F.col("polarity")))


_GOLD = "SELECT review_id, category, CASE WHEN review_id % 11 = 0 THEN CASE polarity WHEN 'negative' THEN 'positive' ELSE 'negative' END ELSE polarity END AS polarity, severity FROM aspect WHERE review_id % 7 <> 0"


def damaged(m):
    """Aspects of which some quote what the review does not say, and some a review that does not exist."""
    a = aspects(m).select("review_id", "category", "polarity", "severity", "evidence_span")
    span = F.when(F.col("review_id") % 5 == 0, F.concat(F.lit("never said: "), "evidence_span")).otherwise(F.regexp_replace("evidence_span", " ", "  \n"))
    return a.withColumn("evidence_span", span).withColumn("review_id", F.when(F.col("review_id") % 13 == 0, -F.col("review_id") - 1).otherwise(F.col("review_id")))


def buried(m):
    good, _ = text.verify_evidence(aspects(m), m.reviews())
    return views.buried_complaints(good, m.reviews())


_BURIED = "SELECT a.review_id, a.category, severity, r.property_key, review_date, half_stars FROM aspect a JOIN review r ON r.review_id = a.review_id WHERE polarity = 'negative' AND half_stars >= 8"


def books(m):
    live = demand(m).where("status <> 'cancelled'").join(F.broadcast(risk.wash_rate(m.bookings()).select("channel_code", "wash_bp")), "channel_code")
    return live.select("stay_date", "property_key", (1 - F.col("wash_bp") / 10000).alias("survival")).join(daily(m).where("available > 0").select("stay_date", "property_key", F.col("available").alias("capacity")), ["stay_date", "property_key"])


def positions(m):
    return daily(m).groupBy("property_key", F.trunc("stay_date", "month").alias("month")).agg(*[F.sum(c).alias(c) for c in ("available", "sold", "revenue_paise", "commission_paise")]).where("sold > 0")


_STEPS = [s * 100 for s in (-10, -5, -2, 2, 5, 10)]
_LEVERS = ", ".join(f"('{n}{s:+d}', {s if i == 0 else 0}, {s if i == 1 else 0}, {s if i == 2 else 0})" for i, n in enumerate(("occupancy", "adr", "capacity")) for s in _STEPS)
_SCENARIO = f"""SELECT property_key, month, available, sold, revenue_paise, commission_paise, lever_id, rooms AS new_available, s2 AS new_sold, a2 AS new_adr_paise, a2 * s2 AS new_revenue_paise, a2 * s2 * commission_paise // greatest(revenue_paise, 1) AS new_commission_paise, (a2 - a1) * (sold + s2) AS twice_rate_effect, (s2 - sold) * (a1 + a2) AS twice_volume_effect
 FROM (SELECT *, CASE WHEN dor = 0 THEN held ELSE {rdiv('rooms * occ', '10000')} END AS s2, {rdiv('revenue_paise', 'sold')} AS a1, {rdiv(rdiv('revenue_paise', 'sold') + ' * (10000 + dad)', '10000')} AS a2 FROM (SELECT *, greatest(0, least(10000, {rdiv('held * 10000', 'rooms')} + dor)) AS occ FROM (SELECT *, least(sold, rooms) AS held FROM (SELECT p.*, lever_id, dor, dad, {rdiv('available * (10000 + dca)', '10000')} AS rooms
 FROM (SELECT property_key, CAST(date_trunc('month', stay_date) AS DATE) AS month, CAST(sum(available) AS BIGINT) AS available, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(revenue_paise) AS BIGINT) AS revenue_paise, CAST(sum(commission_paise) AS BIGINT) AS commission_paise FROM daily GROUP BY ALL HAVING sum(sold) > 0) p, (VALUES {_LEVERS}) v(lever_id, dor, dad, dca)))))"""


def answers(m):
    t = kpi.trend(daily(m), "month").where("sold > 0").withColumn("answer_id", F.date_format("period", "yyyy-MM"))
    wrong = F.when(F.month("period") % 5 == 0, F.col("adr_paise") + 1).otherwise(F.col("adr_paise"))
    prose = F.concat(F.lit("Sold "), F.col("sold").cast("string"), F.lit(" nights at "), wrong.cast("string"), F.lit(" paise, "), F.format_number((F.col("revenue_paise") / 100).cast("decimal(20,2)"), 2), F.lit(" in all"))
    values = F.explode(F.array(F.col("sold").cast("decimal(30,6)"), F.col("adr_paise").cast("decimal(30,6)"), (F.col("revenue_paise") / 100).cast("decimal(30,6)"))).alias("value")
    return t.select("answer_id", prose.alias("prose")), t.select("answer_id", values)


def feed(m):
    out = scratch(m.spark)
    files.export_daily_feed(daily(m).where("stay_date <= date'2001-01-31'"), f"{out}/feed", 90)
    return files.read_daily_feed(m.spark, f"{out}/feed")


_FEED = f"SELECT stay_date, 'P' || property_key AS property_code, CAST(available AS INT) AS rooms_available, CAST(sold AS INT) AS rooms_sold, CAST(out_of_order AS INT) AS rooms_out_of_order, revenue_paise AS room_revenue_paise, {rdiv('revenue_paise', 'available')} AS revpar_paise, sold <= available AS is_valid_occupancy, sold = 0 AND revenue_paise > 0 AS has_revenue_without_sales FROM daily WHERE stay_date > DATE '2000-11-02' AND stay_date <= DATE '2001-01-31'"


def streamed_feed(m):
    out = scratch(m.spark)
    files.export_daily_feed(daily(m).where("stay_date <= date'2001-01-31'"), f"{out}/feed", 90)
    for _ in range(2):  # the second run finds nothing new
        feeds.ingest_feed(m.spark, f"{out}/feed", f"{out}/table", f"{out}/offsets").awaitTermination()
    return m.spark.read.parquet(f"{out}/table")


def _streamed(m, df, job):
    out = scratch(m.spark)
    df.write.parquet(f"{out}/in")
    stream = m.spark.readStream.schema(df.schema).parquet(f"{out}/in")
    return feeds.caught_up(job(stream), f"{out}/out", f"{out}/offsets")


def exported(m):
    out = scratch(m.spark)
    files.export_model({"guest": m.guests(), "unit": m.units(), "channel": m.channels()}, out)
    return files.read_table(m.spark, f"{out}/guest", "guest_key long, guest_segment string, has_phone boolean, has_email boolean")


def _auc_sql(label: str, where: str) -> str:
    """The rank-sum form, with average ranks from rank() and the size of each tie."""
    ranked = f"SELECT {label} AS y, rank() OVER (ORDER BY lead_days) + (count(*) OVER (PARTITION BY lead_days) - 1) / 2.0::DOUBLE AS r FROM booking WHERE {where}"
    sums = f"SELECT sum(r) FILTER (y) AS s, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM ({ranked})"
    return sql(f"SELECT *, abs(auc - 0.5) < 0.1 AS unlearnable FROM (SELECT round((s - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auc, positives, negatives FROM ({sums}))", "booking")


#: The plain form: one convolution per booking, in the order of their chances.
_OVERBOOK = {
    "wash": f"SELECT channel_code, 1 - {bp('count(*) FILTER (status IN (' + chr(39) + 'cancelled' + chr(39) + ', ' + chr(39) + 'no_show' + chr(39) + '))', 'count(*)')} / 10000.0::DOUBLE AS survival FROM booking GROUP BY 1",
    "book": "SELECT n.stay_date, n.property_key, d.available AS capacity, list(survival ORDER BY survival) AS p FROM booking_night n JOIN wash USING (channel_code) JOIN daily d ON d.stay_date = n.stay_date AND d.property_key = n.property_key WHERE n.status <> 'cancelled' AND d.available > 0 GROUP BY ALL",
    "pmf": "SELECT *, list_reduce(list_transform(p || list_transform(range(extra), lambda i: list_avg(p)), lambda q: [1 - q, q]), lambda a, b: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * b[1] + CASE WHEN i > 1 THEN a[i - 1] * b[2] ELSE 0 END)) AS f FROM book, (SELECT CAST(unnest(range(0, 11)) AS INT) AS extra)",
    "outcome": "SELECT stay_date, property_key, extra, CAST(len(p) AS INT) AS book, CAST(capacity AS INT) AS capacity, list_sum(list_transform(f, lambda x, i: x * (i - 1))) AS expected_arrivals, list_sum(list_transform(f, lambda x, i: CASE WHEN i - 1 > capacity THEN x ELSE 0 END)) AS p_walk, list_sum(list_transform(f, lambda x, i: x * greatest(i - 1 - capacity, 0))) AS expected_walks, list_sum(list_transform(f, lambda x, i: x * greatest(capacity - i + 1, 0))) AS expected_empty FROM pmf",
}


def _overbook_sql(query: str) -> str:
    return sql(query, "booking", "booking_night", "daily", **_OVERBOOK)


def by_lead(m):
    """Bookings with a closed form of the lead time as their score, split in time."""
    b = m.bookings().select("booking_date", (F.col("status") == "cancelled").cast("double").alias("label"), (F.col("lead_days") / (F.col("lead_days") + 30.0)).alias("score"))
    return risk.temporal_split(b)


_LEAD = {
    "cut": "SELECT booking_date AS split_date FROM (SELECT booking_date, row_number() OVER (ORDER BY booking_date, booking_key) AS r, count(*) OVER () AS n FROM booking) WHERE r = CAST(floor(n * 0.75) AS BIGINT) + 1",
    "lead": "SELECT (status = 'cancelled')::INT::DOUBLE AS label, lead_days / (lead_days + 30.0::DOUBLE) AS score, booking_date < split_date AS is_train FROM booking, cut",
}

#: How each exported table is read back, and the column that is summed to compare it.
STAR = {
    "guest": ("guest_key long, guest_segment string, has_phone boolean, has_email boolean", "guest_key"), "unit": ("property_key int, unit_key int, unit_type string, base_rate_paise long", "base_rate_paise"),
    "channel": ("channel_code string, channel_type string", "length(channel_type)"), "booking": ("booking_key long, guest_key long, property_key int, unit_key int, check_in_date date, check_out_date date, status string, net_paise long", "net_paise"),
    "unit_night": ("unit_key int, property_key int, stay_date date, is_sellable boolean, is_occupied boolean, revenue_paise long", "revenue_paise"), "payment": ("payment_key long, payment_date date, gross_paise long, credited_paise long", "credited_paise"),
    "request": ("request_key long, request_date date, channel string, sla_minutes int, resolution_minutes int", "resolution_minutes"), "daily": ("property_key int, stay_date date, available long, sold long, revenue_paise long, gross_paise long", "gross_paise"),
}


def star(m, fmt: str):
    """The star schema with its facts and the daily KPI, exported and read again under explicit schemas: rows and a sum of each table."""
    out = scratch(m.spark)
    tables = {"guest": m.guests(), "unit": m.units(), "channel": m.channels(), "booking": m.bookings(), "unit_night": unit_nights(m), "payment": m.payments(), "request": m.requests(), "daily": daily(m)}
    columns = {n: [c.split()[0] for c in schema.split(", ")] for n, (schema, _) in STAR.items()}
    files.export_model({n: df if n == "guest" else df.select(*columns[n]) for n, df in tables.items()}, out, fmt)
    read = [files.read_table(m.spark, f"{out}/{n}", schema, fmt).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows"), F.sum(F.expr(c)).cast("long").alias("total")) for n, (schema, c) in STAR.items()]
    return reduce(lambda a, b: a.unionByName(b), read)


_STAR = sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, CAST(sum({c}) AS BIGINT) AS total FROM {n}" for n, (_, c) in STAR.items()), *STAR)


def holiday_file(m):
    out = scratch(m.spark)
    h = m.holidays().select(F.struct(F.col("holiday_date").alias("date"), F.col("holiday_name").alias("name"), F.lit("national").alias("scope"), F.lit("public").alias("kind"), F.lit("fixed").alias("confidence")).alias("h"))
    h.agg(F.to_json(F.struct(F.collect_list("h").alias("holidays"))).alias("value")).write.text(out)  # one document of a few dozen holidays
    return files.read_holidays(m.spark, out)


QUERIES = {
    "x2_temporal_split": (
        lambda m: risk.temporal_split(m.bookings()).groupBy("split_date", "is_train").agg(F.count("*").alias("bookings")),
        sql("SELECT split_date, booking_date < split_date AS is_train, count(*) AS bookings FROM booking, (SELECT booking_date AS split_date FROM (SELECT booking_date, row_number() OVER (ORDER BY booking_date, booking_key) AS r, count(*) OVER () AS n FROM booking) WHERE r = CAST(floor(n * 0.75) AS BIGINT) + 1) GROUP BY ALL", "booking"),
    ),
    "x4_auc": (lambda m: risk.lead_rule_auc(m.bookings()), _auc_sql("status = 'cancelled'", "true")),
    "x5_calibration_of_lead": (
        lambda m: risk.calibration(by_lead(m).where("not is_train")),
        sql("SELECT bin, n, predicted, observed, round(abs(predicted - observed), 4) AS error FROM (SELECT CAST(coalesce(least(floor((score - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS INT) AS bin, count(*) AS n, round(avg(score), 4) AS predicted, round(avg(label), 4) AS observed FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM lead WHERE NOT is_train) GROUP BY 1)", "booking", **_LEAD),
    ),
    "x6_evaluation_of_lead": (
        lambda m: risk.evaluate_risk(by_lead(m)),
        sql("SELECT n, tp, fp, fn, tn, brier, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round(tp / nullif(tp + fp, 0) / ((tp + fn) / n), 4) AS lift FROM (SELECT count(*) AS n, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn, count(*) FILTER (NOT hit AND label = 0) AS tn, round(avg(pow(score - label, 2)), 4) AS brier FROM (SELECT *, score >= (SELECT avg(label) FROM lead WHERE is_train) AS hit FROM lead WHERE NOT is_train))", "booking", **_LEAD),
    ),
    "x7_cancellation_by_quarter": (lambda m: risk.cancellation_by_quarter(m.bookings()), sql(f"SELECT CAST(date_trunc('quarter', booking_date) AS DATE) AS quarter, count(*) AS bookings, count(*) FILTER (status = 'cancelled') AS cancelled, {bp(chr(99) + 'ount(*) FILTER (status = ' + chr(39) + 'cancelled' + chr(39) + ')', 'count(*)')} AS cancel_bp FROM booking GROUP BY 1 HAVING count(*) >= 50", "booking")),
    "x7_temporal_drift": (
        lambda m: risk.temporal_drift(m.bookings()),
        sql(f"SELECT *, last_bp - first_bp AS change_bp FROM (SELECT arg_min(c, q) AS first_bp, arg_max(c, q) AS last_bp FROM (SELECT date_trunc('quarter', booking_date) AS q, {bp('count(*) FILTER (gone)', 'count(*)')} AS c FROM (SELECT *, status = 'cancelled' AS gone FROM booking) GROUP BY 1 HAVING count(*) >= 50))", "booking"),
    ),
    "x8_noshow_by_lead": (lambda m: risk.lead_rule_auc(m.bookings(), True), _auc_sql("status = 'no_show'", "status <> 'cancelled'")),
    "x9_spearman": (
        lambda m: risk.spearman(m.bookings(), "lead_days", "net_paise"),
        sql("SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY lead_days) + (count(*) OVER (PARTITION BY lead_days) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY net_paise) + (count(*) OVER (PARTITION BY net_paise) - 1) / 2.0::DOUBLE AS b FROM booking)", "booking"),
    ),
    "x10_wash_rate": (lambda m: risk.wash_rate(m.bookings()), sql(f"SELECT coalesce(channel_code, 'ALL') AS channel_code, count(*) AS made, count(*) FILTER (status IN ('cancelled', 'no_show')) AS gone, {bp(chr(99) + 'ount(*) FILTER (status <> ' + chr(39) + 'checked_out' + chr(39) + ')', 'count(*)')} AS wash_bp FROM booking GROUP BY ROLLUP (channel_code)", "booking")),
    "x11_overbook_outcomes": (
        lambda m: scenario.overbook_outcomes(books(m)).select("stay_date", "property_key", "extra", "book", "capacity", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("expected_arrivals", "p_walk", "expected_walks", "expected_empty")]),
        _overbook_sql("SELECT stay_date, property_key, extra, book, capacity, round(expected_arrivals + 1e-9, 6) AS expected_arrivals, round(p_walk + 1e-9, 6) AS p_walk, round(expected_walks + 1e-9, 6) AS expected_walks, round(expected_empty + 1e-9, 6) AS expected_empty FROM outcome"),
    ),
    "x12_overbook_sensitivity": (
        lambda m: scenario.overbook_sensitivity(scenario.overbook_outcomes(books(m))),
        _overbook_sql("SELECT stay_date, property_key, cost_ratio, extra, extra = 10 AS at_boundary FROM (SELECT stay_date, property_key, cost_ratio, CAST(arg_min(extra, (round(expected_walks * cost_ratio + expected_empty, 9), extra)) AS INT) AS extra FROM outcome, (SELECT CAST(unnest([1, 2, 5, 10, 20, 50]) AS DOUBLE) AS cost_ratio) GROUP BY ALL)"),
    ),
    "z2_sensitivity": (lambda m: scenario.apply_levers(positions(m), scenario.sensitivity_levers(m.spark)).drop("occupancy_bp", "adr_bp", "capacity_bp"), sql(_SCENARIO, "daily")),
    "z3_shift_mix": (
        lambda m: scenario.shift_mix(kpi.channel_revenue(unit_nights(m)), "1-URGENT", "2-HIGH", 1000),
        f"SELECT '1-URGENT' AS source, '2-HIGH' AS target, {rdiv('a.nights * 1000', '10000')} AS nights_moved, {rdiv('a.nights * 1000', '10000')} * (b.net_per_night_paise - a.net_per_night_paise) AS net_gain_paise FROM ({KPIS['k3_channel_revenue'][1]}) a, ({KPIS['k3_channel_revenue'][1]}) b WHERE a.channel_code = '1-URGENT' AND b.channel_code = '2-HIGH'",
    ),
    "t1_aspects": (aspects, _text_sql("SELECT * FROM aspect")),
    "t2_accepted": (
        lambda m: text.verify_evidence(damaged(m), m.reviews())[0].groupBy("category", "polarity").agg(F.count("*").alias("accepted")),
        _text_sql("SELECT category, polarity, count(*) AS accepted FROM aspect WHERE review_id % 13 <> 0 AND review_id % 5 <> 0 GROUP BY ALL"),
    ),
    "t2_quarantine": (
        lambda m: text.verify_evidence(damaged(m), m.reviews())[1].groupBy("reason").agg(F.count("*").alias("rows")),
        _text_sql("SELECT 'unknown review' AS reason, count(*) AS rows FROM aspect WHERE review_id % 13 = 0 HAVING count(*) > 0 UNION ALL SELECT 'span not in source', count(*) FROM aspect WHERE review_id % 13 <> 0 AND review_id % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'omitted', count(*) FROM review WHERE review_id % 13 = 0 OR review_id NOT IN (SELECT review_id FROM aspect) HAVING count(*) > 0"),
    ),
    "t3_scores": (
        lambda m: text.score_aspects(aspects(m), gold(m), "category", True),
        _text_sql("SELECT category, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT category, count(*) FILTER (p AND g) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT review_id, category, polarity, true AS p FROM aspect) FULL JOIN (SELECT DISTINCT review_id, category, polarity, true AS g FROM gold) USING (review_id, category, polarity) GROUP BY 1)", gold=_GOLD),
    ),
    "t4_polarity_confusion": (lambda m: text.polarity_confusion(aspects(m), gold(m)), _text_sql("SELECT g.polarity AS gold, a.polarity AS predicted, count(*) AS n FROM aspect a JOIN (SELECT DISTINCT review_id, category, polarity FROM gold) g USING (review_id, category) GROUP BY ALL", gold=_GOLD)),
    "t5_unsupported_numbers": (
        lambda m: text.unsupported_numbers(*answers(m)).select("answer_id", F.col("number").cast("long").alias("number")),
        f"SELECT strftime(period, '%Y-%m') AS answer_id, adr_paise + 1 AS number FROM ({KPIS['k2_trend'][1]}) WHERE sold > 0 AND month(period) % 5 = 0",
    ),
    "k18_daily_brief": (
        lambda m: kpi.daily_brief(daily(m), views.service_kpi(m.requests()), aspects(m).where("polarity = 'negative'").join(m.reviews().select("review_id", "review_date"), "review_id"), buried(m), dt.date(1997, 6, 18), dt.date(2024, 1, 20), dt.date(2000, 6, 30)),
        sql(_BRIEF + """ UNION ALL SELECT 'complaints', CAST(row_number() OVER (ORDER BY n DESC, category) AS INT), category, n FROM (SELECT category, count(*) AS n FROM aspect JOIN review USING (review_id) WHERE polarity = 'negative' AND review_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30' GROUP BY 1 ORDER BY n DESC, category LIMIT 3)
        UNION ALL SELECT 'buried', 0, 'aspects', count(*) FROM b WHERE review_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'""", "daily", "request", "review", **_TEXT, b=_BURIED),
    ),
    "k9_aspect_counts": (lambda m: text.aspect_counts(aspects(m)), _text_sql("SELECT category, polarity, count(*) AS aspects, count(DISTINCT review_id) AS reviews, count(*) FILTER (severity = 'severe') AS severe, count(*) FILTER (severity = 'moderate') AS moderate FROM aspect GROUP BY ALL ORDER BY aspects DESC, category, polarity LIMIT 60")),
    "v5_buried_complaints": (lambda m: buried(m).select("review_id", "category", "severity", "property_key", "review_date", "half_stars"), _text_sql(_BURIED)),
    "k21_buried_summary": (
        lambda m: text.buried_summary(buried(m), m.reviews()),
        _text_sql("""SELECT aspects, reviews, mean_rating, rated_well, top_categories, round(100 * reviews / nullif(rated_well, 0), 4) AS share_pct FROM (SELECT count(*) AS aspects, count(DISTINCT review_id) AS reviews, round(avg(half_stars) / 2, 4) AS mean_rating FROM b), (SELECT count(*) AS rated_well FROM review WHERE half_stars >= 8),
        (SELECT string_agg(category, ',' ORDER BY n DESC, category) AS top_categories FROM (SELECT category, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, category LIMIT 3))""", b=_BURIED),
    ),
    "s2_daily_feed": (lambda m: feed(m).drop("source_file", "recomputed_revpar_paise", "revpar_matches"), sql(_FEED, "daily")),
    "s3_feed_checks": (lambda m: files.feed_checks(feed(m)), sql(f"SELECT count(*) AS rows, count(*) FILTER (NOT is_valid_occupancy) AS oversold, count(*) FILTER (has_revenue_without_sales) AS revenue_without_sales, CAST(0 AS BIGINT) AS revpar_mismatches FROM ({_FEED})", "daily")),
    "s5_export_model": (exported, sql("SELECT guest_key, guest_segment, phone IS NOT NULL AS has_phone, email IS NOT NULL AS has_email FROM guest", "guest")),
    "s5_star_schema": (lambda m: star(m, "parquet"), _STAR),
    "s1_star_from_csv": (lambda m: star(m, "csv"), _STAR),
    "s4_holiday_file": (holiday_file, sql("SELECT holiday_date AS date, holiday_name AS name, 'national' AS scope, 'public' AS kind, 'fixed' AS confidence FROM holiday", "holiday")),
    "s7_budget_extract": (
        lambda m: files.budget_extract(daily(m), views.service_kpi(m.requests()), 1000)[2],
        sql("SELECT *, kpi_rows + service_rows <= 1000 AS within_cap FROM (SELECT count(*) AS kpi_rows FROM (SELECT DISTINCT property_key, date_trunc('month', stay_date) FROM daily)), (SELECT count(*) AS service_rows FROM (SELECT DISTINCT property_key, category, day_part FROM request))", "daily", "request"),
    ),
    "s8_resolve_keys": (
        lambda m: files.resolve_keys(m.bookings().select("booking_key", "channel_code"), m.channels().where("channel_code <> '5-LOW'"), "channel_code", "channel_type"),
        sql("SELECT booking_key, b.channel_code, c.channel_type FROM booking b LEFT JOIN channel c ON c.channel_code = b.channel_code AND c.channel_code <> '5-LOW'", "booking", "channel"),
    ),
    "s9_pending_reviews": (lambda m: files.pending(m.reviews(), aspects(m)).select("review_id", "review_date"), _text_sql("SELECT review_id, review_date FROM review WHERE trim(review_text) <> '' AND review_id NOT IN (SELECT review_id FROM aspect)")),
    "s12_drop_personal": (lambda m: files.drop_personal(m.guests()), sql("SELECT guest_key, guest_segment FROM guest", "guest")),
    "s13_leaks": (
        lambda m: files.leaks(m.guests().select("guest_key", F.concat(F.lit("call "), "phone").alias("note"), "guest_segment"), m.guests()),
        sql("SELECT DISTINCT 'note' AS column, phone_last10 AS value FROM guest_norm", "guest_norm").replace("AS column", 'AS "column"'),
    ),
    "st1_streamed_feed": (lambda m: streamed_feed(m).select("stay_date", "property_code", "rooms_sold"), sql(f"SELECT stay_date, property_code, rooms_sold FROM ({_FEED})", "daily")),
    "st2_daily_volume": (
        lambda m: _streamed(m, m.requests().select("created_at", "channel"), feeds.daily_volume),
        sql("SELECT request_date, channel, count(*) AS n FROM request WHERE request_date + INTERVAL '18 hours 30 minutes' <= (SELECT max(created_at) FROM request) - INTERVAL 2 DAY GROUP BY ALL", "request"),
    ),
    "st3_drop_repeats": (
        lambda m: _streamed(m, m.bookings().select("guest_key", "unit_key", "check_in_date", "booked_at"), feeds.drop_repeats).select("guest_key", "unit_key", "check_in_date"),
        sql("SELECT DISTINCT guest_key, unit_key, check_in_date FROM booking", "booking"),  # what is there at once is one batch
    ),
}
