"""Revenue management: the forward book against its own weekday's history.

Functions take a small table ``as_ofs`` (one row per decision date), so one date
and a replay of hundreds are the same job with one more key.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_dow
from ..functions.money import int_div, rounded_div
from .grain import books_by_horizon, on_books_intervals
from .views import on_the_books, pickup_daily

WINDOW, MIN_SUPPORT, MIN_NIGHTS, MATERIAL, MAX_HORIZON = 8, 6, 3, 4, 35


def as_of_table(spark: SparkSession, *dates: dt.date) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "as_of date")


def book(nights: DataFrame, as_ofs: DataFrame, horizon: int = MAX_HORIZON) -> DataFrame:
    """(as_of, property_key, stay_date, days_out, nights_on_books, revenue_paise) within the horizon.

    One sweep over the days on which nights of a stay date were entered and left,
    added up by property, stay date and day first; running sums are read off at
    the decision dates, so nights do not meet each of them.
    """
    reach = as_ofs.select("as_of").distinct().select("as_of", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("days_out")).select("as_of", F.expr("date_add(as_of, days_out)").alias("stay_date"))
    first, end = F.greatest("entered_on", F.date_sub("stay_date", horizon)), F.least(F.coalesce("left_on", "stay_date"), "stay_date")
    event = F.explode(F.array(F.struct(first.alias("d"), F.lit(1).alias("n")), F.struct(end.alias("d"), F.lit(-1).alias("n")))).alias("e")
    near = nights.join(F.broadcast(reach.select("stay_date").distinct()), "stay_date", "left_semi")  # dates
    e = near.where(first < end).select("property_key", "stay_date", "night_paise", event)
    days = e.groupBy("property_key", "stay_date", F.col("e.d").alias("as_of")).agg(F.sum("e.n").alias("n"), F.sum(F.col("e.n") * F.col("night_paise")).alias("paise")).withColumn("asked", F.lit(False))
    asked = days.select("property_key", "stay_date").distinct().join(F.broadcast(reach), "stay_date").select("property_key", "stay_date", "as_of", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("paise"), F.lit(True).alias("asked"))
    upto = Window.partitionBy("property_key", "stay_date").orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = days.unionByName(asked).withColumn("nights_on_books", F.sum("n").over(upto)).withColumn("revenue_paise", F.sum("paise").over(upto))
    return swept.where("asked and nights_on_books > 0").select("as_of", "property_key", "stay_date", "nights_on_books", "revenue_paise", F.datediff("stay_date", "as_of").alias("days_out"))


def holiday_effects_known(kpi_calendar: DataFrame, as_ofs: DataFrame, half_window: int = 56) -> DataFrame:
    """(as_of, holiday, n, twice_effect_bp): observations before each decision date and the sum of twice their effects.

    A date whose window of ``half_window`` days ends before a decision date has
    one baseline for all later ones: those are found once and summed as they
    become known. Only the dates whose window a decision date cuts are taken
    anew for it, from the two windows before it.
    """
    from .calendar_fx import paired_observations

    twice = (2 * (F.col("occupancy_bp") - F.col("baseline_bp"))).cast("long")
    whole = paired_observations(kpi_calendar, half_window=half_window)
    known = whole.groupBy("holiday", F.date_add("stay_date", half_window + 1).alias("as_of")).agg(F.count("*").alias("n"), F.sum(twice).alias("twice_effect_bp")).withColumn("asked", F.lit(False))
    zero = F.lit(0).cast("long")
    asked = known.select("holiday").distinct().crossJoin(F.broadcast(as_ofs.select("as_of").distinct())).select("holiday", "as_of", zero.alias("n"), zero.alias("twice_effect_bp"), F.lit(True).alias("asked"))
    upto = Window.partitionBy("holiday").orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row a holiday and date
    swept = known.unionByName(asked).select("as_of", "holiday", "asked", F.sum("n").over(upto).alias("n"), F.sum("twice_effect_bp").over(upto).alias("twice_effect_bp")).where("asked").drop("asked")
    days = as_ofs.select("as_of").distinct().select("as_of", F.explode(F.sequence(F.lit(1), F.lit(2 * half_window))).alias("ago")).select("as_of", F.expr("date_sub(as_of, ago)").alias("stay_date"))
    cut = paired_observations(kpi_calendar.join(F.broadcast(days), "stay_date"), half_window=half_window, keys=("as_of",)).where(F.datediff("as_of", "stay_date") <= half_window)
    edge = cut.groupBy("as_of", "holiday").agg(F.count("*").alias("n"), F.sum(twice).alias("twice_effect_bp"))
    both = swept.unionByName(edge).groupBy("as_of", "holiday").agg(F.sum("n").alias("n"), F.sum("twice_effect_bp").alias("twice_effect_bp"))
    return both.where("n > 0")


def pickup(nights: DataFrame, as_of: dt.date, lookback: int = 14) -> DataFrame:
    """Net pickup by activity date over the days up to ``as_of``."""
    p = pickup_daily(nights).where(F.col("activity_date").between(as_of - dt.timedelta(lookback - 1), as_of))
    return p.groupBy("activity_date").agg(*[F.sum(c).alias(c) for c in ("nights_added", "nights_cancelled", "nights_net", "revenue_added_paise", "revenue_cancelled_paise")])


def comparables(calendar: DataFrame, as_ofs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last ``window`` same-weekday dates before each as_of, by property; ``calendar`` is (property_key, stay_date)."""
    # a date is among the last ones until the window-th later one has passed, so each as_of meets ``window`` rows a weekday
    w = Window.partitionBy("property_key", iso_dow(F.col("stay_date"))).orderBy("stay_date")
    c = calendar.withColumn("dow", iso_dow(F.col("stay_date"))).withColumn("until", F.lead("stay_date", window).over(w))
    return c.join(F.broadcast(as_ofs), (F.col("stay_date") < F.col("as_of")) & (F.col("until").isNull() | (F.col("until") >= F.col("as_of")))).drop("until")


def pace_benchmark(nights: DataFrame, calendar: DataFrame, as_ofs: DataFrame, max_horizon: int = MAX_HORIZON) -> DataFrame:
    """(as_of, property_key, dow, days_out): median and quartiles of nights on the books at comparable dates, zeros included."""
    recent = comparables(calendar, as_ofs)
    books = books_by_horizon(nights, recent.select("property_key", "stay_date").distinct(), max_horizon)
    q = lambda p: F.percentile("on_books", p)
    return recent.join(books, ["property_key", "stay_date"]).groupBy("as_of", "property_key", "dow", "days_out").agg(q(0.5).alias("median_nights"), q(0.25).alias("p25_nights"), q(0.75).alias("p75_nights"), F.count("*").alias("support"))


def status_of(gap: Column, nights: Column, p25: Column, p75: Column, material: int = MATERIAL) -> Column:
    return F.when(F.abs(gap) < material, "on_track").when(nights < p25, "behind").when(nights > p75, "ahead").otherwise("on_track")


def pace(nights: DataFrame, calendar: DataFrame, as_ofs: DataFrame, horizon: int = MAX_HORIZON, least: int = MIN_NIGHTS, material: int = MATERIAL) -> DataFrame:
    """Every future stay date that can be judged against its benchmark: ``least`` nights on the books; gaps from ``material`` on count."""
    rows = book(nights, as_ofs, horizon).withColumn("dow", iso_dow(F.col("stay_date")))
    bench = pace_benchmark(nights, calendar, as_ofs, horizon)
    p = rows.join(bench, ["as_of", "property_key", "dow", "days_out"]).where((F.col("support") >= MIN_SUPPORT) & (F.col("median_nights") > 0) & (F.col("nights_on_books") >= least))
    n, gap = F.col("nights_on_books"), F.col("nights_on_books") - F.col("median_nights")
    sure = F.when((F.col("days_out") > 21) | (F.col("support") < WINDOW - 1), "low").when((F.col("days_out") > 10) | (F.col("support") < WINDOW), "medium").otherwise("high")
    return p.select(
        "as_of", "property_key", "stay_date", "days_out", "nights_on_books", "median_nights", "p25_nights", "p75_nights", "support", "revenue_paise", gap.alias("gap_nights"),
        rounded_div(n * 2000, (F.col("median_nights") * 2).cast("long")).alias("pace_tenth_pct"), status_of(gap, n, F.col("p25_nights"), F.col("p75_nights"), material).alias("status"), sure.alias("confidence"),
    )


def need_dates(scored: DataFrame) -> DataFrame:
    """Dates behind their curve, the largest shortfall first."""
    return scored.where("status = 'behind'").orderBy("gap_nights", "stay_date", "property_key")


def constrained_dates(scored: DataFrame) -> DataFrame:
    """Dates ahead of their curve, the largest surplus first."""
    return scored.where("status = 'ahead'").orderBy(F.desc("gap_nights"), "stay_date", "property_key")


def signals(scored: DataFrame, limit: int = 12) -> DataFrame:
    """Up to half of ``limit`` behind dates, then ahead ones up to it, each with its evidence; never a price."""
    b = need_dates(scored).limit(limit // 2).withColumn("kind", F.lit(0))
    a = constrained_dates(scored).limit(limit).withColumn("kind", F.lit(1))
    both = b.unionByName(a).withColumn("rank", F.row_number().over(Window.orderBy("kind", F.when(F.col("kind") == 0, F.col("gap_nights")).otherwise(-F.col("gap_nights")), "stay_date", "property_key")))  # two dozen rows
    text = F.format_string("%d nights on the books, %d expected at %d days out", "nights_on_books", F.floor("median_nights"), "days_out")
    return both.where(F.col("rank") <= limit).select("rank", "status", "property_key", "stay_date", "gap_nights", text.alias("evidence"))


def rm_summary(nights: DataFrame, scored: DataFrame, as_of: dt.date) -> DataFrame:
    """The forward position of one date: 30-day book, 14-day pickup and counts of pace calls."""
    o = on_the_books(nights, as_of).where(F.col("days_out") <= 30).agg(F.coalesce(F.sum("nights_otb"), F.lit(0)).alias("nights_otb"), F.coalesce(F.sum("revenue_otb_paise"), F.lit(0)).alias("revenue_otb_paise"))
    p = pickup(nights, as_of).agg(F.coalesce(F.sum("nights_net"), F.lit(0)).alias("pickup_net"))
    s = scored.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("behind", "ahead", "on_track")])
    return o.crossJoin(p).crossJoin(s)


def data_horizon(calendar: DataFrame, back: int = 30) -> DataFrame:
    """The last stay date and the default as-of date before it."""
    return calendar.agg(F.max("stay_date").alias("horizon")).withColumn("default_as_of", F.date_sub("horizon", back))


def final_book(nights: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Nights on the books at arrival, by stay date and property."""
    n = on_books_intervals(nights.where(F.col("stay_date").between(start, end)), 0)
    return n.groupBy("property_key", "stay_date").agg(F.count("*").alias("final_nights"))


def final_book_benchmark(nights: DataFrame, calendar: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """(as_of, property_key, dow): the median final book of the comparable dates."""
    return pace_benchmark(nights, calendar, as_ofs, 0).select("as_of", "property_key", "dow", F.col("median_nights").alias("expected_final"), "support")


def tightest_date(nights: DataFrame, capacity: DataFrame, days_out: int = 7, top: int = 1) -> DataFrame:
    """The stay date whose book at ``days_out`` is largest against its capacity (property_key, stay_date, available)."""
    books = books_by_horizon(nights, capacity, days_out).where(F.col("days_out") == days_out)
    t = books.join(capacity, ["property_key", "stay_date"]).where("available > 0").withColumn("load_bp", rounded_div(F.col("on_books") * 10000, F.col("available")))
    return t.orderBy(F.desc("load_bp"), "stay_date", "property_key").limit(top)


def band_of(days_out: Column) -> Column:
    return F.when(days_out <= 3, "1-3").when(days_out <= 7, "4-7").when(days_out <= 14, "8-14").otherwise("15-30")


def pace_calls(scored: DataFrame, finals: DataFrame, bench: DataFrame) -> DataFrame:
    """Each call with the final book it led to, and whether that finished below the expected one."""
    s = scored.withColumn("dow", iso_dow(F.col("stay_date"))).join(bench.select("as_of", "property_key", "dow", "expected_final"), ["as_of", "property_key", "dow"])
    s = s.join(finals, ["property_key", "stay_date"], "left").withColumn("final_nights", F.coalesce("final_nights", F.lit(0)))
    return s.withColumn("finished_below", F.col("final_nights") < F.col("expected_final")).drop("dow")


def pooled_replay(calls: DataFrame) -> DataFrame:
    """Calls of all as-of dates pooled by days out: how many finished below, and the errors of the expected final book and of the book as it stood."""
    off = F.col("expected_final") - F.col("final_nights")
    return calls.groupBy(band_of(F.col("days_out")).alias("band")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "behind").alias("behind"), F.count_if("finished_below").alias("below"),
        F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.avg(off), 6).alias("bias"), F.round(F.avg(F.abs(F.col("nights_on_books") - F.col("final_nights"))), 6).alias("naive_mae"),
    )


def replay_coverage(calls: DataFrame, horizon: DataFrame) -> DataFrame:
    """By as_of: calls whose stay date the data reaches, so that they can be resolved; ``horizon`` is one row of data_horizon."""
    c = calls.crossJoin(F.broadcast(horizon.select("horizon")))
    return c.groupBy("as_of").agg(F.count("*").alias("calls"), F.count_if(F.col("stay_date") <= F.col("horizon")).alias("resolvable"))


def pace_evaluation(calls: DataFrame) -> DataFrame:
    """Precision, recall and lift of "behind" over all calls, with the sign of the gap as a naive comparator."""
    behind, below, naive = F.col("status") == "behind", F.col("finished_below"), F.col("gap_nights") < 0
    s = calls.agg(F.count("*").alias("calls"), F.count_if(below).alias("below"), F.count_if(behind).alias("behind"), F.count_if(behind & below).alias("hits"), F.count_if(naive).alias("naive"), F.count_if(naive & below).alias("naive_hits"))
    ten = lambda a, b: rounded_div(F.col(a) * 10000, F.col(b))
    misses = F.col("behind") - F.col("hits")
    return s.select("*", ten("below", "calls").alias("base_bp"), ten("hits", "behind").alias("precision_bp"), ten("hits", "below").alias("recall_bp"), ten("naive_hits", "naive").alias("naive_precision_bp"),
                    F.when((misses == 0) & (F.col("behind") > 0), int_div(F.lit(30000), F.greatest("behind", F.lit(1)))).alias("rule_of_three_bp"))


def reconstruct(nights: DataFrame, unit_nights: DataFrame, calendar: DataFrame, kpi_calendar: DataFrame, context: DataFrame, as_ofs: DataFrame, ahead: int = 30, back: int = 28, lookback: int = 14) -> DataFrame:
    """(as_of, section, property_key, stay_date, label, value): all that was known at each decision date, in whole numbers.

    The book ahead, net pickup, what the days before realised, the calendar
    ahead, holiday effects from dates before, a forecast from the last four same
    weekdays, and pace with the expected final book. Nothing is read that was
    entered, cancelled or stayed after ``as_of``.
    """
    day, at = F.col("stay_date"), F.broadcast(as_ofs)
    gap = F.datediff("stay_date", "as_of")

    def rows(df, section, label, value, key="property_key", date="stay_date"):
        nothing = {"property_key": F.lit(None).cast("int"), "stay_date": F.lit(None).cast("date")}
        return df.select("as_of", F.lit(section).alias("section"), F.col("property_key") if key else nothing["property_key"].alias("property_key"), F.col("stay_date") if date else nothing["stay_date"].alias("stay_date"), label.cast("string").alias("label"), value.cast("long").alias("value"))

    def summed(df, section, names, **where):
        return rows(df.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("long").alias("value")) for n in names])).alias("x")), section, F.col("x.label"), F.col("x.value"), **where)

    book_rows = summed(book(nights, as_ofs, ahead), "book", ("nights_on_books", "revenue_paise"))
    moves = nights.select(F.col("entered_on").alias("on"), F.lit(1).alias("n")).unionByName(nights.select(F.col("left_on").alias("on"), F.lit(-1).alias("n")))
    recent = moves.groupBy("on").agg(F.sum("n").alias("n")).join(at, (F.col("on") <= F.col("as_of")) & (F.datediff("as_of", "on") < lookback)).groupBy("as_of").agg(F.sum("n").alias("n"))
    days = unit_nights.groupBy("property_key", "stay_date").agg(F.count_if("is_occupied").alias("sold"), F.count_if("is_sellable").alias("available"), F.sum("revenue_paise").alias("revenue_paise"))
    past = days.join(at, (day <= F.col("as_of")) & (gap > -back)).groupBy("as_of", "property_key").agg(*[F.sum(c).alias(c) for c in ("sold", "available", "revenue_paise")])
    near = context.where("is_holiday_adjacent").select(F.col("full_date").alias("stay_date"), "nearest_holiday", "days_to_holiday").join(at, (gap > 0) & (gap <= ahead))
    effects = holiday_effects_known(kpi_calendar, as_ofs)
    same = comparables(calendar, as_ofs, 4).join(days, ["property_key", "stay_date"]).groupBy("as_of", "property_key", "dow").agg(F.sum("sold").alias("sold"))
    judged = pace(nights, calendar, as_ofs)
    expected = judged.withColumn("dow", iso_dow(day)).join(final_book_benchmark(nights, calendar, as_ofs).select("as_of", "property_key", "dow", "expected_final"), ["as_of", "property_key", "dow"])
    parts = [
        book_rows, rows(recent, "pickup", F.lit("net_nights"), F.col("n"), None, None), summed(past, "realised", ("sold", "available", "revenue_paise"), date=None), rows(near, "calendar", F.col("nearest_holiday"), F.col("days_to_holiday"), None),
        rows(effects, "effect observations", F.col("holiday"), F.col("n"), None, None), rows(effects, "effect", F.col("holiday"), F.col("twice_effect_bp"), None, None), rows(same, "forecast", F.col("dow"), F.col("sold"), date=None),
        rows(judged, "pace", F.col("status"), F.col("gap_nights") * 4), rows(expected, "expected final", F.lit("nights"), F.col("expected_final") * 4),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """A hash of the rows in any order, equal for equal multisets of rows: the sum of each row's first 60 bits of MD5.

    A row's text is its columns in order of their names, joined by "|", null as an empty field.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("fingerprint"))
