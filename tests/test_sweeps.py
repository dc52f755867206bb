"""Order statistics of growing sets, the book at many decision dates and holiday effects as they become known, each against its plain definition."""

import datetime as dt
import random

from pyspark.sql import functions as F

from nightledger.operators import calendar_fx, revenue
from nightledger.operators.orderstats import known_by

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(i)


def test_order_statistics_of_all_sets(spark):
    rng = random.Random(5)
    # one group holds most rows, and a third of those are one value
    rows = [("hot", day(rng.randrange(40)), 7 if rng.random() < 0.3 else rng.randrange(-(10**9), 10**9)) for _ in range(6000)] + [("small", day(i), i % 3) for i in range(9)] + [("small", day(1), None), (None, day(1), 4)]
    at = [("hot", day(i)) for i in (0, 3, 17, 39, 60)] + [("small", day(i)) for i in (1, 8)] + [("none", day(3))]
    values, ats = spark.createDataFrame(rows, "g string, day date, v long"), spark.createDataFrame(at, "g string, at date")
    picks = lambda n: [F.lit(1), F.floor((n + 1) / 2), n, n]
    got = {(r["g"], r["at"], r["i"]): (r["n"], r["v"]) for r in known_by(values, ats, picks, ("g",), least=3).collect()}
    want = {}
    for g, a in at:
        known = sorted(v for x, d, v in rows if x == g and d <= a and v is not None)
        n = len(known)
        if n >= 3:
            want |= {(g, a, i): (n, known[k - 1]) for i, k in enumerate((1, (n + 1) // 2, n, n))}
    assert got == want and ("small", day(8), 0) in got and ("small", day(1), 0) not in got
    assert known_by(values.limit(0), ats, picks, ("g",)).count() == 0


def test_book_at_2400_decision_dates(spark):
    rng = random.Random(6)
    nights = []
    for _ in range(3000):
        stay, entered = rng.randrange(2500), rng.randrange(90)
        left = None if rng.random() < 0.6 else stay - rng.randrange(entered + 3) + 1
        nights.append((1 + rng.randrange(2), day(stay), day(stay - entered), None if left is None else day(left), rng.randrange(1000)))
    df = spark.createDataFrame(nights, "property_key int, stay_date date, entered_on date, left_on date, night_paise long")
    as_ofs = revenue.as_of_table(spark, *[day(i) for i in range(2400)])
    got = {(r["as_of"], r["property_key"], r["stay_date"]): (r["days_out"], r["nights_on_books"], r["revenue_paise"]) for r in revenue.book(df, as_ofs, 35).collect()}
    want = {}
    for p, stay, entered, left, paise in nights:
        for out in range(1, 36):
            d = stay - dt.timedelta(out)
            if D0 <= d < day(2400) and entered <= d and (left is None or left > d):
                _, n, s = want.get((d, p, stay), (0, 0, 0))
                want[d, p, stay] = (out, n + 1, s + paise)
    assert got == want


def test_holiday_effects_as_they_become_known(spark):
    rng = random.Random(7)
    rows = []
    for p in (1, 2):
        for i in range(400):
            off = (i + 20) % 90 - 20  # a holiday every 90 days
            rows.append((p, day(i), None if rng.random() < 0.05 else rng.randrange(3000, 9000), off if abs(off) <= 7 else None, f"h{(i + 20) // 90 % 3}", abs(off) <= 7))
    kpi = spark.createDataFrame(rows, "property_key int, stay_date date, occupancy_bp long, days_to_holiday int, nearest_holiday string, is_holiday_adjacent boolean")
    dates = [day(i) for i in (5, 60, 93, 94, 200, 201, 399, 460, 900)]
    got = {(r["as_of"], r["holiday"]): (r["n"], r["twice_effect_bp"]) for r in revenue.holiday_effects_known(kpi, revenue.as_of_table(spark, *dates)).collect()}
    want = {}
    for d in dates:
        for r in calendar_fx.paired_observations(kpi, d).collect():
            n, s = want.get((d, r["holiday"]), (0, 0))
            want[d, r["holiday"]] = (n + 1, s + int(2 * (r["occupancy_bp"] - r["baseline_bp"])))
    assert got == want and len({d for d, _ in got}) > 5
