"""Single operators on hand-made rows, identities, and what must not change when the future does."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightledger.functions import dates, money
from nightledger.operators import anomaly, calendar_fx, forecast, grain, metrics, quality, revenue, risk, rootcause, scenario, text, views
from nightledger.sources import files
from nightledger.sources.adapter import END, START, TAX_THRESHOLD, Model

D = dt.date


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return Model(spark, sf_dir)


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_rounded_division(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (4, 3), (1, 0), (7, 14)], "n long, d long")
    assert [r[0] for r in df.select(money.rounded_div(F.col("n"), F.col("d"))).collect()] == [3, -3, 1, None, 1]


def test_business_date_turns_at_1830_utc(spark):
    df = spark.createDataFrame([("2026-03-10 18:29:00",), ("2026-03-10 18:30:00",), ("2026-03-10 18:31:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in df.select(dates.business_date(F.col("t"))).collect()] == [D(2026, 3, 10), D(2026, 3, 11), D(2026, 3, 11)]


def test_tax_follows_date_and_rate(spark):
    rates = spark.createDataFrame([(D(2017, 7, 1), D(2025, 9, 21), 12, 18), (D(2025, 9, 22), None, 5, 18)], "effective_from date, effective_to date, rate_at_or_below int, rate_above int")
    rows = spark.createDataFrame([(1, D(2026, 1, 15), 500000), (2, D(2026, 1, 15), 760000), (3, D(2025, 5, 15), 500000), (4, D(2026, 1, 15), 750000)], "i int, d date, a long")
    assert [r["gst_pct"] for r in grain.with_tax(rows, "d", "a", rates, 750000).orderBy("i").collect()] == [5, 18, 12, 5]


def booking(spark, *rows):
    schema = "booking_key long, property_key int, unit_key int, channel_code string, guest_key long, booking_date date, check_in_date date, check_out_date date, cancel_date date, status string, stay_type string, nights int, net_paise long, commission_paise long"
    return spark.createDataFrame([(k, 1, 1, "c", k, b, i, o, c, s, "nightly" if o > i else "microstay", (o - i).days, 30000, 3000) for k, b, i, o, c, s in rows], schema)


def test_half_open_stays(spark):
    b = booking(spark, (1, D(2026, 1, 1), D(2026, 1, 5), D(2026, 1, 5), None, "checked_out"), (2, D(2026, 1, 1), D(2026, 1, 5), D(2026, 1, 8), None, "checked_out"))
    assert values(grain.booking_nights(b).orderBy("stay_date"), "booking_key", "stay_date") == [(2, D(2026, 1, 5)), (2, D(2026, 1, 6)), (2, D(2026, 1, 7))]


def test_first_booking_wins_a_unit_night_and_out_of_order_suppresses(spark):
    b = booking(spark, (1, D(2026, 1, 1), D(2026, 1, 2), D(2026, 1, 4), None, "checked_out"), (2, D(2026, 1, 1), D(2026, 1, 3), D(2026, 1, 5), None, "checked_out"), (3, D(2026, 1, 1), D(2026, 1, 1), D(2026, 1, 5), D(2026, 1, 1), "cancelled"))
    units = spark.createDataFrame([(1, 1)], "unit_key int, property_key int")
    n = grain.unit_nights(units, b, D(2026, 1, 1), D(2026, 1, 5), F.col("stay_date") == F.lit(D(2026, 1, 2)))
    assert values(n.orderBy("stay_date"), "booking_key", "is_sellable", "revenue_paise") == [(None, True, 0), (None, False, 0), (1, True, 15000), (2, True, 15000), (None, True, 0)]


def test_grid_is_never_broadcast(spark, model):
    """Where only occupied nights are asked for, the outer join becomes an inner one, and few units make a large grid."""
    occupied = grain.unit_nights(model.units(), model.bookings(), START, END).where("is_occupied").groupBy("channel_code").count()
    occupied.collect()
    plan = occupied._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [unit_key" in plan and "BroadcastHashJoin [unit_key" not in plan


def test_levers_on_sums_whose_product_is_beyond_a_long(spark):
    p = spark.createDataFrame([(100_000, 80_000, 20_000_000_000, 3_000_000_000)], "available long, sold long, revenue_paise long, commission_paise long")
    rows = scenario.apply_levers(p, scenario.sensitivity_levers(spark)).collect()
    assert len(rows) == 18 and all(r["new_commission_paise"] == r["new_revenue_paise"] * 3_000_000_000 // 20_000_000_000 for r in rows)


def test_on_the_books_is_bitemporal(spark):
    b = booking(spark, (1, D(2026, 1, 1), D(2026, 2, 1), D(2026, 2, 2), D(2026, 1, 10), "cancelled"), (2, D(2026, 1, 9), D(2026, 2, 1), D(2026, 2, 2), None, "checked_out"))
    n = grain.booking_nights(b)
    count = lambda d: sum(r["nights_otb"] for r in views.on_the_books(n, d).collect())
    assert [count(D(2026, 1, d)) for d in (1, 8, 9, 10)] == [1, 1, 2, 1] and count(D(2026, 2, 1)) == 0


def test_books_by_horizon_equals_as_of_reconstruction(spark, model):
    n = grain.booking_nights(model.bookings()).where("property_key = 1").cache()
    books = grain.books_by_horizon(n, n.select("property_key", "stay_date").distinct(), 20)
    for h in (0, 3, 20):
        want = {r["stay_date"]: r["n"] for r in n.where((F.col("entered_on") <= F.date_sub("stay_date", h)) & (F.col("left_on").isNull() | (F.col("left_on") > F.date_sub("stay_date", h)))).groupBy("stay_date").agg(F.count("*").alias("n")).collect()}
        got = {r["stay_date"]: r["on_books"] for r in books.where(f"days_out = {h}").collect()}
        assert {k: v for k, v in got.items() if v} == want


def test_grain_identity_and_rates(model):
    un = grain.unit_nights(model.units(), model.bookings(), START, END, grain.every_fiftieth_night_out(START))
    r = views.grain_reconciliation(grain.booking_nights(model.bookings()), un, START, END).first()
    assert r["exploded"] - r["unallocated"] + r["hourly"] == r["occupied"] and r["unallocated"] > 0 and r["hourly"] > 0
    kpi = views.daily_kpi(grain.enriched(un, model.tax_rates(), TAX_THRESHOLD))
    assert kpi.where("gross_paise <> revenue_paise + gst_paise or sold > available").count() == 0


def test_pickup_counts_every_night_once(model):
    n = grain.booking_nights(model.bookings())
    r = views.pickup_daily(n).agg(F.sum("nights_added"), F.sum("nights_cancelled")).first()
    assert r[0] == n.count() and r[1] == n.where("left_on is not null").count()


def test_calendar_context(spark):
    days = spark.range(1).select(F.explode(F.sequence(F.lit(D(2026, 1, 1)), F.lit(D(2026, 1, 31)))).alias("full_date"))
    h = spark.createDataFrame([(D(2026, 1, 9), "a"), (D(2026, 1, 15), "b")], "holiday_date date, holiday_name string")
    by = {r["full_date"].day: r for r in dates.calendar_context(days, h).collect()}
    assert by[9]["days_to_holiday"] == 0 and by[7]["days_to_holiday"] == -2 and by[12]["nearest_holiday"] == "a" and by[12]["days_to_holiday"] == 3
    assert by[10]["is_long_weekend"] and by[16]["is_bridge_day"] and not by[14]["is_bridge_day"] and not by[31]["is_holiday_adjacent"]


def series(spark, values, start=D(2026, 1, 5)):
    return spark.createDataFrame([(start + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "stay_date date, y double")


def test_anomalies(spark):
    rnd = np.random.default_rng(1)
    week = [25 if i % 7 >= 5 else 0 for i in range(120)]
    noisy = [60 + w + rnd.normal(0, 3) for w in week]
    noisy[100] = 20
    assert D(2026, 1, 5) + dt.timedelta(100) in [r["stay_date"] for r in anomaly.detect(series(spark, noisy), "y", gate=10).collect()]
    assert anomaly.detect(series(spark, [100 if i % 7 < 5 else 60 for i in range(120)]), "y", gate=5).count() == 0
    small = [100 + rnd.normal(0, 0.05) for _ in range(120)]
    small[100] = 101
    flagged = [r["stay_date"] for r in anomaly.detect(series(spark, small), "y").collect()]
    assert D(2026, 1, 5) + dt.timedelta(100) in flagged and anomaly.detect(series(spark, small), "y", gate=5).count() == 0
    assert 0.0004 < anomaly.false_alert_budget(1) < 0.0005


@pytest.mark.parametrize("y, s, auc", [([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9], 0.0), ([0, 1, 0, 1], [0.5] * 4, 0.5), ([0, 1, 0, 1], [0.1, 0.4, 0.35, 0.8], 1.0)])
def test_auc(spark, y, s, auc):
    assert risk.roc_auc(spark.createDataFrame([(float(a), b) for a, b in zip(y, s)], "label double, score double")).first()["auc"] == auc


def test_arrivals_are_binomial():
    from math import comb

    pmf = scenario.arrivals([0.85], [20])
    assert np.allclose(pmf, [comb(20, k) * 0.85**k * 0.15 ** (20 - k) for k in range(21)], atol=1e-12) and abs(pmf.sum() - 1) < 1e-12


def test_overbooking_breakeven_falls(spark):
    df = spark.createDataFrame([(D(2026, 1, 1), 1, 10, 0.8)] * 10, "stay_date date, property_key int, capacity long, survival double")
    out = scenario.overbook_outcomes(df, 4).orderBy("extra").collect()
    ratios = [r["breakeven_ratio"] for r in out[2:]]
    assert ratios == sorted(ratios, reverse=True) and out[0]["expected_arrivals"] == pytest.approx(8)


def test_decompositions_leave_no_residual(model):
    un = grain.unit_nights(model.units(), model.bookings(), START, END, grain.every_fiftieth_night_out(START))
    cur = (D(1998, 3, 1), D(1998, 3, 31))
    r = rootcause.explain_components(un, cur, rootcause.preceding(cur)).first()
    assert r["residual"] == 0 and r["change"] == pytest.approx(r["rate_effect"] + r["occupancy_effect"], abs=1e-3)
    parts = rootcause.attribute_revpar(un, F.col("property_key"), cur, rootcause.preceding(cur)).collect()
    assert sum(p["capacity_mix_effect"] + p["performance_effect"] for p in parts) == pytest.approx(r["change"], abs=1e-2)


def test_pace_does_not_see_the_future(spark, model):
    n = grain.booking_nights(model.bookings()).cache()
    calendar = model.units().select("property_key").distinct().crossJoin(spark.range(1).select(F.explode(F.sequence(F.lit(START), F.lit(END))).alias("stay_date")))
    as_of = D(1998, 6, 1)
    later = n.where(F.col("entered_on") > F.lit(D(1998, 5, 1))).limit(500).withColumn("entered_on", F.lit(as_of + dt.timedelta(1))).withColumn("booking_key", -F.col("booking_key"))
    cancelled = n.withColumn("left_on", F.when((F.col("stay_date") > F.lit(as_of)) & F.col("left_on").isNull(), F.lit(as_of + dt.timedelta(2))).otherwise(F.col("left_on")))
    marks = [revenue.fingerprint(revenue.book(x, revenue.as_of_table(spark, as_of)).unionByName(revenue.pace(x, calendar, revenue.as_of_table(spark, as_of)), True)).first() for x in (n, n.unionByName(later), cancelled)]
    assert marks[0] == marks[1] == marks[2]


def test_naive_models_agree_at_whole_weeks(spark):
    a = spark.createDataFrame([(1, D(2026, 1, 1) + dt.timedelta(i), int(10 + i % 7 + i // 30)) for i in range(90)], "property_key int, stay_date date, occupied long")
    a = a.withColumn("sellable", F.lit(30))
    otb = a.select("property_key", "stay_date", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("days_out")).withColumn("on_books", F.lit(0).cast("long"))
    f = forecast.forecasts(a, otb, spark.createDataFrame([(D(2026, 3, 10),)], "origin date"), 14)
    by = {(r["model"], r["horizon"]): r["prediction"] for r in f.collect()}
    assert by["naive", 7] == by["seasonal_naive", 7] and by["naive", 14] == by["seasonal_naive", 14]


def test_intervals(spark):
    res = spark.createDataFrame([("m", 1, float(i)) for i in range(40)] + [("m", 2, 1.0)], "model string, horizon int, error double")
    widths = {}
    for conformal in (False, True):
        for level in (0.5, 0.8, 0.95):
            r = forecast.residual_interval(res, level, conformal).collect()
            assert [x["horizon"] for x in r] == [1]
            widths[conformal, level] = r[0]["hi"] - r[0]["lo"]
    assert all(widths[True, x] >= widths[False, x] for x in (0.5, 0.8, 0.95)) and widths[True, 0.5] < widths[True, 0.8] < widths[True, 0.95]


def test_t_values(spark):
    assert [r[0] for r in spark.createDataFrame([(2,), (10,), (11,), (29,), (30,)], "n int").select(calendar_fx.t_value(F.col("n"))).collect()] == [12.71, 2.26, 2.09, 2.09, 1.96]


def requests(spark, quiet):
    rows = [(i, "app", D(2026, 1, 1) + dt.timedelta(d)) for i in range(2) for d in range(100) if d not in quiet]
    return spark.createDataFrame(rows + [(9, "web", D(2026, 1, 1)), (9, "web", D(2026, 4, 10))], "request_key int, channel string, request_date date")


def test_silent_feed(spark):
    out = values(quality.silent_runs(requests(spark, range(70, 79))), "channel", "quiet_days")
    assert out == [("app", 9)] and quality.silent_runs(requests(spark, range(70, 73))).count() == 0


def test_duplicates_and_latest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "k int, x string")
    assert quality.duplicates(df, "DQ011", ["x"]).first().asDict() == {"rule_id": "DQ011", "rows_checked": 5, "rows_failed": 1}
    assert values(quality.latest_by(df.where("x is not null"), ["x"], ["k"]).orderBy("x"), "x", "k") == [("a", 2), ("b", 5)]


LEXICON = text.Lexicon(("dirty", "rude"), ("clean", "kind"), ("rude",), ("dirty",), (("room", ("room", "bed"), "housekeeping"), ("staff", ("staff",), "front desk")))


def test_aspects_and_evidence(spark):
    r = spark.createDataFrame([(1, "The room was clean but the staff was rude. Another dirty bed!"), (2, ""), (3, None)], "review_id long, review_text string")
    a = text.classify_aspects(r, LEXICON)
    assert sorted(values(a, "category", "polarity", "severity")) == [("room", "negative", "moderate"), ("room", "positive", "minor"), ("staff", "negative", "severe")]
    claims = spark.createDataFrame([(1, "room", "THE  room was\nclean"), (1, "staff", "made up"), (7, "room", "x")], "review_id long, category string, evidence_span string")
    good, bad = text.verify_evidence(claims, r)
    assert values(good, "category") == [("room",)] and sorted(values(bad, "reason")) == [("omitted",), ("omitted",), ("span not in source",), ("unknown review",)]


def test_unsupported_numbers(spark):
    a = spark.createDataFrame([(1, "We sold 1,234 nights at 5.5 and 7")], "answer_id int, prose string")
    f = spark.createDataFrame([(1, Decimal("1234")), (1, Decimal("5.47"))], "answer_id int, value decimal(30,6)")
    assert sorted(float(r["number"]) for r in text.unsupported_numbers(a, f).collect()) == [7.0]


def test_feed_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stay_date,property_code,rooms_available,rooms_sold,rooms_out_of_order,room_revenue_paise,revpar_paise\n2026-01-01, p1\t,10,11,0,5000,500\n2026-01-02,P1,0,0,0,10,\n")
    (tmp_path / "b.txt").write_text("no\n")
    rows = files.read_daily_feed(spark, str(tmp_path)).orderBy("stay_date").collect()
    assert [(r["property_code"], r["is_valid_occupancy"], r["has_revenue_without_sales"], r["revpar_matches"], r["source_file"]) for r in rows] == [("P1", False, False, True, "a.csv"), ("P1", True, True, True, "a.csv")]
    df = spark.createDataFrame([("x@y.z", "1", 2)], "email string, guest_key string, n int")
    assert files.classify_columns(df.schema) == {"email": "email", "guest_key": "guest_key", "n": "other"} and files.drop_personal(df).columns == ["guest_key", "n"]


def test_metric_registry_names_what_it_measures():
    assert all(m.grain and m.date_basis and m.unit for m in metrics.METRICS.values())


def test_decision_inputs_do_not_see_the_future(spark, model):
    """The fingerprint is the same when all that came after the decision date is taken away."""
    from nightledger.plans import layer
    from nightledger.plans.revenue import calendar

    m, day = model, D(1997, 8, 10)
    nights, units, kpi = layer.demand(m), layer.unit_nights(m), views.daily_kpi_calendar(layer.daily(m), layer.context(m))
    past = nights.where(F.col("entered_on") <= day).withColumn("left_on", F.when(F.col("left_on") <= day, F.col("left_on")))
    given = [(nights, units, kpi), (past, units.where(F.col("stay_date") <= day), kpi.where(F.col("stay_date") < day))]
    seen = [revenue.fingerprint(revenue.reconstruct(n, u, calendar(m), k, layer.context(m), revenue.as_of_table(spark, day))).first() for n, u, k in given]
    assert seen[0] == seen[1] and seen[0]["n"] > 50


def test_backtest_reads_the_bookings_once(spark, sf_dir):
    """Its features come from the stored days and books, so the plan that joins them has no scan of orders (it had one a feature)."""
    from nightledger.plans.analytics import QUERIES

    df = QUERIES["i5_forward_intervals"][0](Model(spark, sf_dir))
    assert "o_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 150


def test_queries_on_occupied_nights_broadcast_no_grid(spark, sf_dir):
    """The join of the grid with its bookings is the one on unit_key and stay_date."""
    from nightledger.plans import registry

    queries = registry.queries()
    for name in ("k24_tax_exposure", "k3_channel_revenue", "k22_night_drift", "a4_channel_economics", "d11_enriched_nights", "m9_channel_mix", "r8_data_horizon", "v11_microstay_impact", "v12_grain_reconciliation", "z3_shift_mix", "q_rules"):
        plan = queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [unit_key" in line and "stay_date" in line]
        assert joins and not [j for j in joins if "Broadcast" in j], name
