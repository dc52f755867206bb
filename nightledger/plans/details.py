"""Queries that look into what others only count: extracts, defective feeds, holidays from a file, break-even ratios, clauses and scores by language."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.money import rounded_div
from ..operators import scenario, text, views
from ..session import scratch
from ..sources import files
from .base import bp, rdiv, sql
from .layer import daily
from .others import _ASPECTS, _CLAUSES, _FEED, _GOLD, LEXICON, _overbook_sql, _text_sql, aspects, books, gold, holiday_file

#: The conjunctions and marks at which the classifier cuts by default are planted for words that the texts have.
PLANTED = ((" of ", " but "), (" and ", " - "), (" de ", " ; "), (" the ", ". the "))
PLAIN = replace(LEXICON, split=text.Lexicon.split)


def planted(m):
    t = F.col("review_text")
    for old, new in PLANTED:
        t = F.replace(t, F.lit(old), F.lit(new))
    return m.reviews().withColumn("review_text", t)


def _planted_sql() -> str:
    """The same cuts without a look behind: white space after a full stop first, then the others."""
    t = "review_text"
    for old, new in PLANTED:
        t = f"replace({t}, '{old}', '{new}')"
    cut = rf"string_split(regexp_replace(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), '\s*;\s*|\s+-\s+|\b(?:but|however|though)\b', chr(1), 'g'), chr(1))"
    clauses = _CLAUSES.replace("regexp_split_to_array(review_text, '[.!?;\n]+')", cut)
    return sql("SELECT * FROM aspect", "review", cl0=clauses, cl="SELECT * FROM cl0 WHERE polarity IS NOT NULL", aspect=_ASPECTS)


def defective_feed(m):
    """The daily feed with planted defects: a wrong RevPAR, more sold than available, and revenue without sales."""
    out, d = scratch(m.spark), F.dayofmonth("stay_date")
    f = files.feed_rows(daily(m).where("stay_date <= date'2001-01-31'"), 90)
    f = f.withColumn("revpar_paise", F.when(d % 7 == 0, F.col("revpar_paise") + 1).otherwise(F.col("revpar_paise")))
    f = f.withColumn("rooms_sold", F.when(d % 11 == 0, F.col("rooms_available") + 1).when(d % 13 == 0, 0).otherwise(F.col("rooms_sold")))
    f.write.option("header", True).csv(f"{out}/feed")
    return files.read_daily_feed(m.spark, f"{out}/feed")


_DEFECTIVE = f"""SELECT *, CASE WHEN day(stay_date) % 7 = 0 THEN revpar_paise + 1 ELSE revpar_paise END AS given, CASE WHEN day(stay_date) % 11 = 0 THEN rooms_available + 1 WHEN day(stay_date) % 13 = 0 THEN 0 ELSE rooms_sold END AS sold FROM ({_FEED})"""
_MONTHS = "SELECT property_key, CAST(date_trunc('month', stay_date) AS DATE) AS month, CAST(sum(available) AS BIGINT) AS available, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(revenue_paise) AS BIGINT) AS revenue_paise FROM daily GROUP BY ALL"
_COUNTS = "SELECT language, category, count(*) FILTER (p AND g) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT review_id, category, polarity, true AS p FROM aspect) FULL JOIN (SELECT DISTINCT review_id, category, polarity, true AS g FROM gold) USING (review_id, category, polarity) JOIN review USING (review_id) GROUP BY ALL"


def extracts(m):
    return files.budget_extract(daily(m), views.service_kpi(m.requests()), 1000)


QUERIES = {
    "s3_feed_defects": (
        lambda m: files.feed_checks(defective_feed(m)),
        sql(f"SELECT count(*) AS rows, count(*) FILTER (sold > rooms_available) AS oversold, count(*) FILTER (sold = 0 AND room_revenue_paise > 0) AS revenue_without_sales, count(*) FILTER (given IS DISTINCT FROM revpar_paise) AS revpar_mismatches FROM ({_DEFECTIVE})", "daily"),
    ),
    "s4_holiday_nights": (
        lambda m: daily(m).join(F.broadcast(holiday_file(m)), F.col("stay_date") == F.col("date")).select("property_key", "stay_date", "name", "scope", "available", "sold", "revenue_paise"),  # a row a holiday
        sql("SELECT property_key, stay_date, holiday_name AS name, 'national' AS scope, available, sold, revenue_paise FROM daily JOIN holiday ON holiday_date = stay_date", "daily", "holiday"),
    ),
    "s7_monthly_extract": (lambda m: extracts(m)[0], sql(f"SELECT *, {bp('sold', 'available')} AS occupancy_bp, {rdiv('revenue_paise', 'sold')} AS adr_paise FROM ({_MONTHS})", "daily")),
    "s7_service_extract": (lambda m: extracts(m)[1], sql("SELECT property_key, category, day_part, count(*) AS requests, count(*) FILTER (is_sla_breached) AS breaches FROM request GROUP BY ALL", "request")),
    "x11_breakeven": (
        lambda m: scenario.overbook_outcomes(books(m)).where("p_walk > 0.01").select("stay_date", "property_key", "extra", (rounded_div(F.round(F.col("breakeven_ratio") * 1e6).cast("long"), 100) / 10000.0).alias("breakeven_ratio")),
        _overbook_sql(f"SELECT stay_date, property_key, extra, {rdiv('CAST(round((empty0 - expected_empty) / (expected_walks - walks0) * 1e6) AS BIGINT)', '100')} / 10000.0::DOUBLE AS breakeven_ratio FROM (SELECT *, lag(expected_empty) OVER w AS empty0, lag(expected_walks) OVER w AS walks0 FROM outcome WINDOW w AS (PARTITION BY stay_date, property_key ORDER BY extra)) WHERE p_walk > 0.01"),
    ),
    "t1_clauses": (lambda m: text.classify_aspects(planted(m), PLAIN), _planted_sql()),
    "t3_macro_by_language": (
        lambda m: text.macro_scores(aspects(m), gold(m), m.reviews(), "language"),
        _text_sql(f"SELECT language, count(*) AS categories, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {rdiv('CAST(sum(f) AS BIGINT)', 'count(*)')} / 1000000.0::DOUBLE AS macro_f1 FROM (SELECT *, {rdiv('2000000 * tp', '(2 * tp + fp + fn)')} AS f FROM ({_COUNTS})) GROUP BY 1", gold=_GOLD),
    ),
}
