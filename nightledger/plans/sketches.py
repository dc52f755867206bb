"""Queries over stored quantile sketches: exact counts and extremes, and quantiles within the stated rank error."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import int_div
from ..operators import sketches, views
from ..sources.adapter import Model
from .base import sql
from .layer import books_sql, demand


def lead_times(m: Model):
    """Lead time by channel, from sketches of each check-in day, property and channel."""
    b, lead = m.bookings(), F.col("lead_days")
    days = sketches.stored(b, lead, ("check_in_date", "property_key", "channel_code"))
    return sketches.rank_checked(b, lead, sketches.merged(days, ("channel_code",)), ("channel_code",))


def booking_curve(m: Model):
    """The share of the final book sold at each number of days out, in millionths, from sketches of each day and property."""
    books, share = views.books_with_final(demand(m), 60), int_div(F.col("on_books") * 1_000_000, F.col("final_nights"))
    days = sketches.stored(books, share, ("stay_date", "property_key", "days_out"))
    by_property = sketches.merged(days, ("property_key", "days_out"))
    return sketches.rank_checked(books, share, sketches.merged(by_property, ("days_out",)), ("days_out",))


def _sql(by: str, value: str, source: str) -> str:
    within = ", ".join(f"TRUE AS p{p}_within" for p in (25, 50, 75, 90))
    return f"SELECT {by}, count(*) AS n, count(*) AS sketched, CAST(min({value}) AS BIGINT) AS least, CAST(max({value}) AS BIGINT) AS greatest, {within} FROM {source} GROUP BY {by}"


QUERIES = {
    "v9_lead_time_sketches": (lead_times, sql(_sql("channel_code", "lead_days", "booking"), "booking")),
    "v8_booking_curve_sketches": (
        booking_curve,
        sql(_sql("days_out", "on_books * 1000000 // final_nights", "books JOIN final USING (property_key, stay_date)"), "booking_night",
            final="SELECT property_key, stay_date, count(*) AS final_nights FROM booking_night WHERE status IN ('checked_out', 'confirmed') GROUP BY ALL", books=books_sql("final", 60)),
    ),
}
