"""KPI rollups and comparisons. Every ratio is taken from sums; top-k lists have a unique last sort key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import bp, rounded_div
from .views import with_rates

SUMS = ("physical", "available", "out_of_order", "sold", "microstay_sold", "revenue_paise", "gross_paise", "gst_paise", "commission_paise", "nightly_revenue_paise")


def _between(c, a: dt.date, b: dt.date) -> Column:
    return F.col(c).between(a, b)


def _sum(cond: Column, c: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))


def overview(kpi: DataFrame, days: int) -> DataFrame:
    """The trailing window up to the last date against the window of equal length before it, in one pass."""
    last = F.broadcast(kpi.agg(F.max("stay_date").alias("last")))
    age = F.datediff("last", "stay_date")
    k = kpi.crossJoin(last).withColumn("now", age < days).where(age < 2 * days)
    sums = k.agg(*[_sum(F.col("now"), c).alias(f"{c}_now") for c in SUMS], *[_sum(~F.col("now"), c).alias(f"{c}_before") for c in SUMS])
    rate = lambda n, d, w: rounded_div(F.col(f"{n}_{w}"), F.col(f"{d}_{w}"))
    occ = lambda w: bp(F.col(f"sold_{w}"), F.col(f"available_{w}"))
    return sums.select(
        "revenue_paise_now", "revenue_paise_before", bp(F.col("revenue_paise_now") - F.col("revenue_paise_before"), F.col("revenue_paise_before")).alias("revenue_change_bp"),
        occ("now").alias("occupancy_bp_now"), (occ("now") - occ("before")).alias("occupancy_change_bp"), rate("revenue_paise", "sold", "now").alias("adr_paise_now"),
        (rate("revenue_paise", "sold", "now") - rate("revenue_paise", "sold", "before")).alias("adr_change_paise"), rate("revenue_paise", "available", "now").alias("revpar_paise_now"),
        (rate("revenue_paise", "available", "now") - rate("revenue_paise", "available", "before")).alias("revpar_change_paise"),
    )


def rolled_up(kpi: DataFrame, *by) -> DataFrame:
    """The daily sums by other keys, with the ratios taken anew."""
    return with_rates(kpi.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS]))


def trend(kpi: DataFrame, grain: str = "month") -> DataFrame:
    return rolled_up(kpi, F.trunc("stay_date", grain).alias("period") if grain != "day" else F.col("stay_date").alias("period")).select("period", "sold", "revenue_paise", "occupancy_bp", "adr_paise", "revpar_paise")


def channel_revenue(nights: DataFrame) -> DataFrame:
    """Share of nights, ADR, commission, the tax on it and net per night, by channel."""
    each = nights.where("is_occupied").groupBy("channel_code").agg(F.count("*").alias("nights"), F.sum("revenue_paise").alias("revenue_paise"), F.sum("commission_paise").alias("commission_paise"))
    total = F.broadcast(each.agg(F.sum("nights").alias("total")))
    tax = rounded_div(F.col("commission_paise") * 18, 100)
    return each.crossJoin(total).select(
        "channel_code", "nights", bp(F.col("nights"), F.col("total")).alias("share_bp"), rounded_div(F.col("revenue_paise"), F.col("nights")).alias("adr_paise"), "commission_paise", tax.alias("gst_on_commission_paise"),
        rounded_div(F.col("revenue_paise") - F.col("commission_paise") - tax, F.col("nights")).alias("net_per_night_paise"),
    )


def properties(kpi: DataFrame, units: DataFrame) -> DataFrame:
    """Properties with their modelled unit count; one without units has 0."""
    n = units.groupBy("property_key").agg(F.count("*").alias("unit_count"))
    return kpi.select("property_key").distinct().join(n, "property_key", "left").select("property_key", F.coalesce("unit_count", F.lit(0)).alias("unit_count"))


def property_performance(kpi: DataFrame, requests: DataFrame) -> DataFrame:
    stay = rolled_up(kpi, "property_key").select("property_key", "sold", "revenue_paise", "occupancy_bp", "adr_paise", "revpar_paise")
    service = requests.groupBy("property_key").agg(
        F.count("*").alias("requests"), bp(F.count_if("is_sla_breached"), F.count("resolution_minutes")).alias("breach_bp"), rounded_div(F.sum("csat") * 100, F.count("csat")).alias("csat_hundredths")
    )
    return stay.join(service, "property_key", "left")


def operations_overview(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("requests"), F.count("resolution_minutes").alias("resolved"), F.count_if("is_sla_breached").alias("breached"), bp(F.count_if("is_sla_breached"), F.count("resolution_minutes")).alias("breach_bp"),
        rounded_div(F.sum("resolution_minutes") * 100, F.count("resolution_minutes")).alias("tat_hundredths"), bp(F.count("csat"), F.count("*")).alias("csat_response_bp"), rounded_div(F.sum("csat") * 100, F.count("csat")).alias("csat_hundredths"),
    )


def sla_matrix(service: DataFrame, least: int = 5, top: int = 40) -> DataFrame:
    """Breach rates of property x part of day x team cells with enough resolved requests, the worst first."""
    s = service.where("resolution_minutes is not null").groupBy("property_key", "day_part", "owning_team").agg(F.count("*").alias("requests"), F.count_if("is_sla_breached").alias("breaches"))
    s = s.where(F.col("requests") >= least).withColumn("breach_bp", bp(F.col("breaches"), F.col("requests")))
    return s.orderBy(F.desc("breach_bp"), "property_key", "day_part", "owning_team").limit(top)


def requests_by_category(requests: DataFrame, top: int = 40) -> DataFrame:
    s = requests.groupBy("category", "request_type", "owning_team").agg(F.count("*").alias("requests"), F.count_if("is_sla_breached").alias("breaches"))
    return s.orderBy(F.desc("requests"), "category", "request_type", "owning_team").limit(top)


def same_time_last_year(kpi: DataFrame) -> DataFrame:
    """Revenue by date against the same weekday 364 days before, and month to date."""
    day = kpi.groupBy("stay_date").agg(F.sum("revenue_paise").alias("revenue_paise"))
    before = day.select(F.date_add("stay_date", 364).alias("stay_date"), F.col("revenue_paise").alias("stly_paise"))
    running = Window.partitionBy(F.trunc("stay_date", "month")).orderBy("stay_date").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn("mtd_paise", F.sum("revenue_paise").over(running)).join(before, "stay_date", "left").withColumn("vs_stly_bp", bp(F.col("revenue_paise") - F.col("stly_paise"), F.col("stly_paise")))


def bookings_by_date(bookings: DataFrame, role: str) -> DataFrame:
    """Bookings and money by any of their dates."""
    return bookings.groupBy(F.col(role).alias("date")).agg(F.count("*").alias("bookings"), F.sum("net_paise").alias("net_paise"))


def revenue_by_basis(nights: DataFrame, bookings: DataFrame, payments: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One period's revenue by stay date, booking date (not cancelled) and payment date, and their spread."""
    a = nights.where(_between("stay_date", start, end)).agg(F.coalesce(F.sum("revenue_paise"), F.lit(0)).alias("stay_paise"))
    b = bookings.where(_between("booking_date", start, end) & (F.col("status") != "cancelled")).agg(F.coalesce(F.sum("net_paise"), F.lit(0)).alias("booking_paise"))
    c = payments.where(_between("payment_date", start, end)).agg(F.coalesce(F.sum("gross_paise"), F.lit(0)).alias("payment_paise"))
    three = ("stay_paise", "booking_paise", "payment_paise")
    return a.crossJoin(b).crossJoin(c).withColumn("spread_paise", F.greatest(*three) - F.least(*three))


def cancellation_bases(bookings: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Cancelled share of the bookings made in a period, and cancellations that happened in it over the same bookings."""
    made, gone = _between("booking_date", start, end), F.col("status") == "cancelled"
    s = bookings.agg(F.count_if(made).alias("made"), F.count_if(made & gone).alias("cohort_cancelled"), F.count_if(_between("cancel_date", start, end)).alias("event_cancelled"))
    return s.select("*", bp(F.col("cohort_cancelled"), F.col("made")).alias("cohort_bp"), bp(F.col("event_cancelled"), F.col("made")).alias("event_bp"))


def gst_summary(nights: DataFrame) -> DataFrame:
    """Net, tax and gross with nights in each band and the effective rate."""
    n = nights.where("is_occupied")
    s = n.agg(F.sum("revenue_paise").alias("net_paise"), F.sum("gst_paise").alias("gst_paise"), F.sum("gross_paise").alias("gross_paise"), *[F.count_if(F.col("gst_pct") == p).alias(f"nights_{p}") for p in (18, 5, 12)])
    return s.withColumn("effective_bp", bp(F.col("gst_paise"), F.col("net_paise")))


def era_compare(requests: DataFrame, cutoff: dt.date, segment: str) -> DataFrame:
    """Turnaround, breach rate and count of each segment before and from a date, with the blended move in a row of its own."""
    late = F.col("request_date") >= F.lit(cutoff)
    r = requests.where("resolution_minutes is not null")

    def sides(df, *by):
        parts = []
        for name, era in (("before", ~late), ("after", late)):
            n = F.count_if(era)
            parts += [n.alias(f"n_{name}"), rounded_div(_sum(era, "resolution_minutes") * 100, n).alias(f"tat_{name}"), bp(F.count_if(era & F.col("is_sla_breached")), n).alias(f"breach_bp_{name}")]
        return df.groupBy(*by).agg(*parts)

    out = sides(r, F.col(segment).alias("segment")).unionByName(sides(r).withColumn("segment", F.lit("ALL")))
    return out.withColumn("tat_ratio_bp", bp(F.col("tat_after"), F.col("tat_before")))


def window_delta(nights: DataFrame, channels: DataFrame, start: dt.date, end: dt.date, before_days: int = 61) -> DataFrame:
    """ADR, RevPAR and channel-type share of a window against the days before it."""
    n = nights.where(_between("stay_date", start - dt.timedelta(before_days), end)).join(F.broadcast(channels), "channel_code", "left")
    now = F.col("stay_date") >= F.lit(start)
    occupied = F.col("is_occupied")
    s = n.agg(
        *[x for w, era in (("now", now), ("before", ~now)) for x in (rounded_div(_sum(era, "revenue_paise"), F.count_if(era & occupied)).alias(f"adr_{w}"), rounded_div(_sum(era, "revenue_paise"), F.count_if(era & F.col("is_sellable"))).alias(f"revpar_{w}"))],
        *[bp(F.count_if(era & occupied & (F.col("channel_type") == "corporate")), F.count_if(era & occupied)).alias(f"corporate_bp_{w}") for w, era in (("now", now), ("before", ~now))],
    )
    return s.select("*", (F.col("adr_now") - F.col("adr_before")).alias("adr_change"), (F.col("revpar_now") - F.col("revpar_before")).alias("revpar_change"), (F.col("corporate_bp_now") - F.col("corporate_bp_before")).alias("corporate_change_bp"))


def daily_brief(kpi: DataFrame, service: DataFrame, complaints: DataFrame, buried: DataFrame, day: dt.date, service_day: dt.date, review_day: dt.date) -> DataFrame:
    """(section, rank, label, value): a day against the same weekday of the week before, the worst service cells of seven days, and the guests' voice of thirty.

    ``complaints`` has category and review_date of negative aspects, ``buried`` review_date of those in reviews that rate well.
    """
    d = kpi.where(F.col("stay_date").isin(day, day - dt.timedelta(7)))
    today = F.col("stay_date") == F.lit(day)
    lines = d.agg(*[(_sum(today, c) - _sum(~today, c)).alias(c) for c in ("sold", "revenue_paise", "available")])
    lines = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("value")) for c in ("sold", "revenue_paise", "available")])).alias("x"))
    lines = lines.select(F.lit("change").alias("section"), F.lit(0).alias("rank"), "x.label", "x.value")
    week = service.where(_between("request_date", service_day - dt.timedelta(6), service_day) & F.col("resolution_minutes").isNotNull())
    cell = week.groupBy("property_key", "day_part").agg(F.count("*").alias("n"), F.count_if("is_sla_breached").alias("breaches")).where("n >= 3")
    label = F.concat_ws(" ", F.col("property_key").cast("string"), "day_part")
    worst = cell.orderBy(F.desc("breaches"), "property_key", "day_part").limit(3)
    order = Window.orderBy(F.desc("breaches"), "property_key", "day_part")  # three rows
    worst = worst.select(F.lit("breaches").alias("section"), F.row_number().over(order).alias("rank"), label.alias("label"), F.col("breaches").alias("value"))
    month = _between("review_date", review_day - dt.timedelta(29), review_day)
    by = complaints.where(month).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(3)
    by = by.select(F.lit("complaints").alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "category")).alias("rank"), F.col("category").alias("label"), F.col("n").alias("value"))  # three rows
    hidden = buried.where(month).agg(F.lit("buried").alias("section"), F.lit(0).alias("rank"), F.lit("aspects").alias("label"), F.count("*").alias("value"))
    return lines.unionByName(worst).unionByName(by).unionByName(hidden)


def csat_by_breach(requests: DataFrame) -> DataFrame:
    mean = lambda cond: rounded_div(_sum(cond, "csat") * 100, F.count(F.when(cond, F.col("csat"))))
    return requests.agg(mean(F.col("is_sla_breached")).alias("csat_breached"), mean(~F.col("is_sla_breached")).alias("csat_kept"))


def validate_layer(kpi: DataFrame, nights: DataFrame) -> DataFrame:
    """Each published total against its recomputation from the fact: (measure, published, recomputed)."""
    view = kpi.agg(F.sum("available").alias("available"), F.sum("sold").alias("sold"), F.sum("revenue_paise").alias("revenue_paise"), F.sum("commission_paise").alias("commission_paise"))
    fact = nights.agg(F.count_if("is_sellable").alias("f_available"), F.count_if("is_occupied").alias("f_sold"), F.sum("revenue_paise").alias("f_revenue_paise"), F.sum("commission_paise").alias("f_commission_paise"))
    both = view.crossJoin(fact)
    rows = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("published"), F.col(f"f_{c}").alias("recomputed")) for c in ("available", "sold", "revenue_paise", "commission_paise")]
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.*", (F.col("x.published") == F.col("x.recomputed")).alias("agrees"))


def night_drift(bookings: DataFrame, nights: DataFrame) -> DataFrame:
    """Booked nights against materialised ones, and unit-nights at or after their booking's departure."""
    booked = bookings.where(~F.col("status").isin("cancelled", "no_show") & (F.col("stay_type") == "nightly")).agg(F.sum(F.datediff("check_out_date", "check_in_date")).alias("booked_nights"))
    held = nights.where("is_occupied").join(bookings.select("booking_key", "check_out_date"), "booking_key")
    made = held.agg(F.count_if(F.col("stay_type") == "nightly").alias("materialised_nights"), F.count_if((F.col("stay_type") == "nightly") & (F.col("stay_date") >= F.col("check_out_date"))).alias("after_departure"))
    return booked.crossJoin(made).withColumn("drift_bp", bp(F.col("booked_nights") - F.col("materialised_nights"), F.col("booked_nights")))


def outage_vs_expected(requests: DataFrame, channel: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of a channel inside a window against its mean daily count outside, times the window's days."""
    inside = _between("request_date", start, end)
    s = requests.where(F.col("channel") == channel).agg(F.count_if(inside).alias("seen"), F.count_if(~inside).alias("outside"), F.countDistinct(F.when(~inside, F.col("request_date"))).alias("days_outside"))
    return s.select("seen", rounded_div(F.col("outside") * ((end - start).days + 1), F.col("days_outside")).alias("expected"))


def tax_exposure(nights: DataFrame, units: DataFrame, threshold: int) -> DataFrame:
    """Occupied nights and units by unit type, and whether the type's base rate is above the tax threshold."""
    n = nights.where("is_occupied").select("unit_key").join(F.broadcast(units.select("unit_key", "unit_type", "base_rate_paise")), "unit_key")
    return n.groupBy("unit_type").agg(F.count("*").alias("nights"), F.countDistinct("unit_key").alias("units"), F.max(F.col("base_rate_paise") > threshold).alias("is_above"))


def pooled_curve(curve: DataFrame, days_out: tuple[int, ...]) -> DataFrame:
    """The booking curve over all properties, from their sums, at chosen horizons."""
    return curve.where(F.col("days_out").isin(*days_out)).groupBy("days_out").agg(bp(F.sum("nights_on_books"), F.sum("final_nights")).alias("sold_bp"))


def worst_month(kpi: DataFrame) -> DataFrame:
    """The month whose RevPAR fell most against the month before."""
    m = trend(kpi, "month").withColumn("change_paise", F.col("revpar_paise") - F.lag("revpar_paise").over(Window.orderBy("period")))  # a row per month
    return m.where("change_paise is not null").agg(F.min_by("period", F.struct("change_paise", "period")).alias("month"), F.min("change_paise").alias("change_paise"))
