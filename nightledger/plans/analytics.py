"""Queries of forecasting, intervals, holiday effects, anomalies and root causes (F, I, G, C, N, W)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import anomaly, calendar_fx, forecast, kpi, rootcause, views
from ..operators.revenue import band_of
from ..session import stored
from .base import bp, rdiv, sql
from ..sources.adapter import END
from .layer import RATES, books_sql, context, daily, demand, unit_nights
from .revenue import calendar

CUR, BASE = (dt.date(1998, 3, 1), dt.date(1998, 3, 31)), (dt.date(1998, 1, 29), dt.date(1998, 2, 28))
#: The last night of a live booking within the calendar, to which the backtest runs.
LAST = f"(SELECT least(max(stay_date), DATE '{END}') FROM booking_night WHERE status NOT IN ('cancelled', 'no_show'))"


def last_date(m) -> dt.date:
    """Found once a model."""
    if not hasattr(m, "last_night"):
        m.last_night = min(END, demand(m).where("status not in ('cancelled', 'no_show')").agg(F.max("stay_date")).first()[0])
    return m.last_night


def nightly(m):
    """The daily KPI, a row a property and date: written once a model, as each feature of the backtest reads it."""
    if not hasattr(m, "stored_daily"):
        m.stored_daily = stored(daily(m))
    return m.stored_daily


def actuals(m):
    """Occupied and sellable unit-nights of the stored days."""
    return nightly(m).select("property_key", "stay_date", F.col("sold").alias("occupied"), F.col("available").alias("sellable"))


def otb(m, first=None, last=None):
    return forecast.otb_matrix(demand(m), calendar(m), 30, first, last)


def pairs(m, as_of=None):
    return calendar_fx.paired_observations(views.daily_kpi_calendar(daily(m) if as_of is None else nightly(m), context(m)), as_of)


def books(m, days: int):
    """The on-the-books matrix of a backtest, written once a model: a row a property, date and horizon."""
    if not hasattr(m, "stored_books"):
        m.stored_books = {}
    if days not in m.stored_books:
        # the calendar has every date, so the last eight of a weekday lie within nine weeks of an origin
        m.stored_books[days] = stored(otb(m, last_date(m) - dt.timedelta(days + 63), last_date(m) + dt.timedelta(30)))
    return m.stored_books[days]


def predictions(m, days: int = 120):
    last = last_date(m)
    return forecast.forecasts(actuals(m), books(m, days), forecast.origin_dates(m.spark, last, days), 30, calendar_fx.holiday_multiplier(pairs(m, last - dt.timedelta(days))), context(m))


def rows(m, days: int = 120):
    return forecast.backtest(predictions(m, days), actuals(m), context(m))


def residuals(m):
    return forecast.prepared_residuals(rows(m), actuals(m))


def portfolio(m):
    return kpi.rolled_up(daily(m), "stay_date")


_DIFF = "occupancy_bp - baseline_bp"
_T = "CASE n " + " ".join(f"WHEN {k} THEN {v}" for k, v in calendar_fx.T95.items()) + " ELSE CASE WHEN n < 30 THEN 2.09 ELSE 1.96 END END"


def _effects(by: str, where: str = "true", source: str = "pairs") -> str:
    half = f"CASE WHEN n < 2 THEN 0 ELSE ({_T}) * sd / sqrt(n) END"
    return f"SELECT {by}, n, round(mean, 3) AS effect_bp, round(mean - {half}, 3) AS ci_low_bp, round(mean + {half}, 3) AS ci_high_bp FROM (SELECT {by}, count(*) AS n, avg({_DIFF}) AS mean, stddev_samp({_DIFF}) AS sd FROM {source} WHERE {where} GROUP BY 1)"


_PAIRS = """SELECT t.property_key, t.stay_date, t.days_to_holiday AS "offset", t.nearest_holiday AS holiday, t.occupancy_bp, quantile_cont(k.occupancy_bp, 0.5) AS baseline_bp, count(*) AS baseline_obs FROM kpi t JOIN kpi k ON k.property_key = t.property_key AND isodow(k.stay_date) = isodow(t.stay_date) AND NOT k.is_holiday_adjacent AND k.stay_date BETWEEN t.stay_date - 56 AND t.stay_date + 56
 WHERE t.is_holiday_adjacent AND t.occupancy_bp IS NOT NULL AND k.occupancy_bp IS NOT NULL GROUP BY ALL HAVING count(*) >= 4"""
_KPI = f"SELECT d.property_key, d.stay_date, {bp('sold', 'available')} AS occupancy_bp, days_to_holiday, nearest_holiday, is_holiday_adjacent FROM daily d JOIN day_context ON full_date = stay_date"
_PAIR_CTES = {"kpi": _KPI, "pairs": _PAIRS}
_FIRST = f"({LAST} - 120)"
_SURE = f"SELECT holiday FROM ({_effects('holiday', source='early_pairs')}) WHERE n >= 3 AND (ci_low_bp > 0 OR ci_high_bp < 0)"
_MULT = f"""SELECT holiday, "offset", round(avg(occupancy_bp / baseline_bp), 6) AS multiplier FROM early_pairs WHERE baseline_bp > 0 AND holiday IN ({_SURE}) GROUP BY ALL"""
#: The backtest as its definition reads: every origin looks at the history up to it.
_BACKTEST_CTES = {
    "kpi": _KPI, "early_kpi": f"SELECT * FROM kpi WHERE stay_date < {_FIRST}", "early_pairs": _PAIRS.replace("kpi t", "early_kpi t").replace("kpi k", "early_kpi k"), "mult": _MULT,
    "act": f"SELECT property_key, stay_date, count(*) FILTER (is_occupied) AS occupied, count(*) FILTER (is_sellable) AS sellable FROM unit_night GROUP BY ALL",
    "days": f"SELECT p.property_key, c.stay_date FROM (SELECT DISTINCT property_key FROM unit) p, calendar c", "books": books_sql("days", 30),
    "steps": f"SELECT property_key, o AS origin, h AS horizon, o + h AS target FROM (SELECT DISTINCT property_key FROM act), (SELECT {_FIRST} + CAST(i AS INT) AS o FROM range(0, 120, 3) t(i)), (SELECT CAST(x AS INT) AS h FROM range(1, 31) t(x))",
    "hist": "SELECT o.property_key, o.origin, list(a.occupied ORDER BY a.stay_date DESC) AS y FROM (SELECT DISTINCT property_key, origin FROM steps) o JOIN act a ON a.property_key = o.property_key AND a.stay_date <= o.origin GROUP BY ALL HAVING count(*) >= 29",
    "same": "SELECT s.property_key, s.origin, s.horizon, list(a.occupied ORDER BY a.stay_date DESC) AS y, list(a.occupied - b.on_books ORDER BY a.stay_date DESC) AS r FROM steps s JOIN act a ON a.property_key = s.property_key AND a.stay_date <= s.origin AND isodow(a.stay_date) = isodow(s.target) JOIN books b ON b.property_key = a.property_key AND b.stay_date = a.stay_date AND b.days_out = s.horizon GROUP BY ALL",
    "wide": """SELECT s.*, h.y[1] AS naive, m.y[1] AS seasonal_naive, list_sum(h.y[1:28]) / least(28, len(h.y)) AS moving_average, list_sum(m.y[1:4]) / least(4, len(m.y)) AS dow_moving_average, CASE WHEN b.on_books IS NULL THEN list_sum(m.y[1:4]) / least(4, len(m.y)) ELSE b.on_books + list_median(m.r[1:8]) END AS pickup,
        list_sum(m.y[1:4]) / least(4, len(m.y)) * coalesce(x.multiplier, 1) AS seasonal_holiday FROM steps s JOIN hist h ON h.property_key = s.property_key AND h.origin = s.origin JOIN same m ON m.property_key = s.property_key AND m.origin = s.origin AND m.horizon = s.horizon LEFT JOIN books b ON b.property_key = s.property_key AND b.stay_date = s.target AND b.days_out = s.horizon
        LEFT JOIN day_context c ON c.full_date = s.target AND c.is_holiday_adjacent LEFT JOIN mult x ON x.holiday = c.nearest_holiday AND x."offset" = c.days_to_holiday""",
    "preds": "SELECT property_key, origin, target, horizon, model, round(prediction, 6) AS prediction FROM (" + " UNION ALL ".join(f"SELECT property_key, origin, target, horizon, '{m}' AS model, CAST({m} AS DOUBLE) AS prediction FROM wide" for m in forecast.MODELS) + ")",
    "bt": "SELECT p.*, CAST(a.occupied AS DOUBLE) AS actual, round(prediction - a.occupied, 6) AS error, c.is_holiday_adjacent AS holiday_adjacent FROM preds p JOIN act a ON a.property_key = p.property_key AND a.stay_date = p.target LEFT JOIN day_context c ON c.full_date = p.target",
    "res": "SELECT b.*, l.level, round(error / l.level, 9) AS relative_error FROM bt b JOIN (SELECT property_key, stay_date, count(*) OVER w AS n, CAST(sum(occupied) OVER w AS BIGINT) / 28.0 AS level FROM act WINDOW w AS (PARTITION BY property_key ORDER BY stay_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) l ON l.property_key = b.property_key AND l.stay_date = b.origin WHERE l.n = 28 AND l.level > 0",
}


def _bt(query: str, days: int = 120, **more) -> str:
    out = sql(query, "daily", "day_context", "unit", "calendar", "booking_night", **_BACKTEST_CTES, **more)
    return out.replace(f"({LAST} - 120)", f"({LAST} - {days})").replace("range(0, 120, 3)", f"range(0, {days}, 3)")


#: Errors as whole millionths, relative ones as whole billionths: sums without an order.
_E, _R = "CAST(round(error * 1e6) AS BIGINT)", "CAST(round(abs(relative_error) * 1e9) AS BIGINT)"
_MAE, _BIAS = (f"{rdiv(f'CAST(sum({e}) AS BIGINT)', '(count(*) * 100)')} / 10000.0::DOUBLE AS {n}" for e, n in ((f"abs({_E})", "mae"), (_E, "bias")))
_SHARE = "CAST(sum(CASE WHEN actual > 0 THEN CAST(round(abs(error) / nullif(actual, 0) * 1e9) AS BIGINT) END) AS BIGINT)"
_SCORE = f"count(*) AS n, {_MAE}, round(sqrt(CAST(sum(CAST({_E} AS HUGEINT) * {_E}) AS DOUBLE) / count(*)) / 1e6, 4) AS rmse, {_BIAS}, CASE WHEN count(*) FILTER (actual > 0) * 10 >= count(*) * 9 THEN {rdiv(_SHARE, '(count(*) FILTER (actual > 0) * 1000)')} / 10000.0::DOUBLE END AS mape"
_ORDER = "list_position([" + ", ".join(f"'{m}'" for m in forecast.MODELS) + "], model)"


def _pick(level: float, conformal: bool, a: str = "e", n: str = "len(e)") -> tuple[str, str]:
    alpha = 1 - level
    q0 = f"greatest(0.0, floor(({n} + 1) * CAST({alpha / 2!r} AS DOUBLE)) / {n})" if conformal else f"CAST({alpha / 2!r} AS DOUBLE)"
    q1 = f"least(1.0, ceil(({n} + 1) * CAST({1 - alpha / 2!r} AS DOUBLE)) / {n})" if conformal else f"CAST({1 - alpha / 2!r} AS DOUBLE)"
    return f"{a}[CAST(floor({q0} * ({n} - 1)) AS BIGINT) + 1]", f"{a}[CAST(ceil({q1} * ({n} - 1)) AS BIGINT) + 1]"


def _coverage_sql() -> str:
    cases = []
    for method, col, conformal, scale in (("plain", "e", False, "1.0"), ("conformal", "e", True, "1.0"), ("scaled", "r", False, "level"), ("scaled_conformal", "r", True, "level")):
        for level in (0.5, 0.8, 0.95):
            lo, hi = _pick(level, conformal, col)
            cases.append(f"SELECT model, '{method}' AS method, CAST({level} AS DOUBLE) AS nominal, actual, greatest(0, prediction - ({hi}) * {scale}) AS lo, greatest(0, prediction - ({lo}) * {scale}) AS hi FROM judged")
    return _bt(
        f"SELECT model, method, nominal, count(*) AS n, count(*) FILTER (actual >= lo - 1e-9 AND actual <= hi + 1e-9) AS inside, round(quantile_cont(hi - lo, 0.5), 4) AS median_width FROM ({' UNION ALL '.join(cases)}) GROUP BY ALL",
        chosen="SELECT * FROM res WHERE horizon IN (1, 7, 14)",
        nth="SELECT model, horizon, origin, row_number() OVER (PARTITION BY model, horizon ORDER BY origin) AS i FROM (SELECT DISTINCT model, horizon, origin FROM chosen)",
        sets="SELECT n.model, n.horizon, n.origin, list(r.error ORDER BY r.error) AS e, list(r.relative_error ORDER BY r.relative_error) AS r FROM nth n JOIN chosen r ON r.model = n.model AND r.horizon = n.horizon AND r.target <= n.origin WHERE i > 20 GROUP BY ALL HAVING count(*) >= 20",
        judged="SELECT x.*, s.e, s.r FROM chosen x JOIN sets s ON s.model = x.model AND s.horizon = x.horizon AND s.origin = x.origin",
    )


_LO, _HI = _pick(0.8, True)
_Z = """SELECT *, CASE WHEN scale <= 1e-9 THEN CASE WHEN abs(actual - baseline) >= greatest(g, 1e-9) THEN sign(actual - baseline) * 4.5 ELSE 0 END ELSE (actual - baseline) / scale END AS z FROM (SELECT *, 1.4826 * list_median([abs(x - baseline) FOR x IN past]) AS scale FROM (SELECT *, list_median(past) AS baseline FROM (
 SELECT *, list(actual) OVER (PARTITION BY {keys}isodow(stay_date) ORDER BY stay_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS past FROM ({source})) WHERE len(past) >= 6))"""


def _outliers(source: str, metric: str, segment: str, keys: str, gate: str) -> str:
    z = _Z.format(keys=keys, source=source).replace("greatest(g, 1e-9)", f"greatest({gate}, 1e-9)")
    return f"""SELECT '{metric}' AS metric, {segment} AS segment, stay_date, actual, baseline, actual - baseline AS deviation, round(z, 6) AS robust_z, CASE WHEN actual > baseline THEN 'above' ELSE 'below' END AS direction, CASE WHEN abs(round(z, 6)) >= 5.5 AND len(past) >= 8 THEN 'high' ELSE 'medium' END AS confidence
    FROM ({z}) WHERE abs(round(z, 6)) >= 3.5 AND abs(actual - baseline) >= {gate}"""


_DRIFT = f"""SELECT model, n, round(100 * (e1 / e0 - 1), 3) AS absolute_pct, round(100 * (r1 / r0 - 1), 3) AS relative_pct, CASE WHEN round(100 * (r1 / r0 - 1), 3) > 10 THEN 'degrading' WHEN round(100 * (r1 / r0 - 1), 3) < -10 THEN 'improving' ELSE 'stable' END AS verdict FROM (SELECT model, count(*) AS n, {', '.join(f"CAST(sum({c}) FILTER ({w}) AS BIGINT) / count(*) FILTER ({w}) AS {x}" for x, c, w in (('e0', f'abs({_E})', 'NOT late'), ('e1', f'abs({_E})', 'late'), ('r0', _R, 'NOT late'), ('r1', _R, 'late')))}
 FROM (SELECT *, origin >= (SELECT list_sort(list(DISTINCT origin))[len(list(DISTINCT origin)) // 2 + 1] FROM res WHERE horizon = 7) AS late FROM res WHERE horizon = 7) GROUP BY 1 HAVING count(*) >= 20)"""
_PORT = f"SELECT *, {RATES} FROM (SELECT stay_date, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in kpi.SUMS) + " FROM daily GROUP BY 1)"
_series = lambda c: f"SELECT stay_date, CAST({c} AS DOUBLE) AS actual FROM port WHERE {c} IS NOT NULL"
_PORT_ANOM = " UNION ALL ".join([_outliers(_series("revenue_paise"), "revenue_paise", "'PORTFOLIO'", "", "abs(baseline) * 0.15"), _outliers(_series("occupancy_bp"), "occupancy_bp", "'PORTFOLIO'", "", "800"), _outliers(_series("adr_paise"), "adr_paise", "'PORTFOLIO'", "", "35000")])
_ERA = f"stay_date BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}'"
_BASE = f"stay_date BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}'"


def _two(by: str, what: str = "is_sellable") -> str:
    return f"SELECT {by}, count(*) FILTER ({what} AND {_ERA}) AS a1, count(*) FILTER ({what} AND {_BASE}) AS a0, CAST(coalesce(sum(revenue_paise) FILTER ({_ERA}), 0) AS BIGINT) AS r1, CAST(coalesce(sum(revenue_paise) FILTER ({_BASE}), 0) AS BIGINT) AS r0 FROM unit_night WHERE ({_ERA} OR {_BASE}) GROUP BY 1"


_W3 = """SELECT member, round(p0, 4) AS before, round(p1, 4) AS after, round((w1 - w0) * (p0 + p1) / 2, 4) AS capacity_mix_effect, round((w0 + w1) / 2 * (p1 - p0), 4) AS performance_effect, round(((w1 - w0) * (p0 + p1) / 2 + (w0 + w1) / 2 * (p1 - p0)) / sum((w1 - w0) * (p0 + p1) / 2 + (w0 + w1) / 2 * (p1 - p0)) OVER (), 4) AS share_of_movement
 FROM (SELECT *, a0 / sum(a0) OVER () AS w0, a1 / sum(a1) OVER () AS w1, coalesce(r0 / nullif(a0, 0), 0) AS p0, coalesce(r1 / nullif(a1, 0), 0) AS p1 FROM ({}))"""
QUERIES = {
    "f1_daily_actuals": (lambda m: forecast.daily_actuals(unit_nights(m)), sql("SELECT property_key, stay_date, count(*) FILTER (is_occupied) AS occupied, count(*) FILTER (is_sellable) AS sellable FROM unit_night GROUP BY ALL", "unit_night")),
    "f2_otb_matrix": (lambda m: otb(m), _bt("SELECT property_key, stay_date, days_out, on_books FROM books")),
    "f3_f8_predictions": (predictions, _bt("SELECT * FROM preds")),
    "f9_backtest": (rows, _bt("SELECT * FROM bt")),
    "f10_scores": (lambda m: forecast.score(rows(m)), _bt(f"SELECT model, horizon, {_SCORE} FROM bt GROUP BY ALL")),
    "f11_winners": (lambda m: forecast.winners(forecast.score(rows(m))), _bt(f"SELECT horizon, arg_min(model, (mae, {_ORDER})) AS model, min(mae) AS mae FROM (SELECT model, horizon, {_SCORE} FROM bt GROUP BY ALL) GROUP BY 1")),
    "f12_holiday_evaluation": (lambda m: forecast.score(rows(m, 260), ("model", "holiday_adjacent")), _bt(f"SELECT model, holiday_adjacent, {_SCORE} FROM bt GROUP BY ALL", 260)),
    "f13_slices": (
        lambda m: forecast.slices(rows(m)),
        _bt(f"SELECT slice, value, model, count(*) AS n, {_MAE}, {_BIAS} FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS slice, CAST({c} AS VARCHAR) AS value, model, error FROM bt" for s, c in (("horizon", "horizon"), ("month", "month(target)"), ("weekday", "isodow(target)"), ("holiday", "holiday_adjacent"))) + ") GROUP BY ALL HAVING count(*) >= 30"),
    ),
    "p3_forecast_accuracy": (
        lambda m: forecast.score(rows(m).where("model = 'pickup'").withColumn("band", band_of(F.col("horizon"))), ("band",)),
        _bt(f"SELECT CASE WHEN horizon <= 3 THEN '1-3' WHEN horizon <= 7 THEN '4-7' WHEN horizon <= 14 THEN '8-14' ELSE '15-30' END AS band, {_SCORE} FROM bt WHERE model = 'pickup' GROUP BY 1"),
    ),
    "f14_forward": (
        lambda m: forecast.forward(actuals(m), otb(m, last_date(m) - dt.timedelta(30 + 63), last_date(m)), m.spark.createDataFrame([(last_date(m) - dt.timedelta(30),)], "origin date"), "dow_moving_average").select("property_key", "target", "prediction", "occupancy_pct"),
        sql(f"""SELECT a.property_key, t.target, round(p, 6) AS prediction, round(100 * round(p, 6) / nullif(cap, 0), 4) AS occupancy_pct FROM (SELECT {LAST} - 30 + CAST(h AS INT) AS target FROM range(1, 31) x(h)) t JOIN (SELECT property_key, isodow(stay_date) AS dow, CAST(sum(y) AS BIGINT) / count(*) AS p, CAST(sum(c) AS BIGINT) / count(*) AS cap
        FROM (SELECT *, row_number() OVER (PARTITION BY property_key, isodow(stay_date) ORDER BY stay_date DESC) AS r FROM (SELECT property_key, stay_date, count(*) FILTER (is_occupied) AS y, count(*) FILTER (is_sellable) AS c FROM unit_night WHERE stay_date <= {LAST} - 30 GROUP BY ALL)) WHERE r <= 4 GROUP BY ALL) a ON a.dow = isodow(t.target)""", "unit_night"),
    ),
    "i1_residuals": (residuals, _bt("SELECT * FROM res")),
    "i2_residual_interval": (
        lambda m: forecast.residual_interval(residuals(m), 0.8),
        _bt(f"SELECT model, horizon, CAST(len(e) AS INT) AS n, {_LO} AS lo, {_HI} AS hi FROM (SELECT model, horizon, list(error ORDER BY error) AS e FROM res GROUP BY ALL HAVING count(*) >= 20)"),
    ),
    "i4_coverage": (lambda m: forecast.coverage(residuals(m).where("horizon in (1, 7, 14)")), _coverage_sql()),
    "i5_forward_intervals": (
        lambda m: forecast.forward_intervals(predictions(m).where((F.col("origin") == F.lit(last_date(m) - dt.timedelta(30))) & (F.col("model") == "pickup")), forecast.residual_interval(residuals(m), 0.8)).drop("origin"),
        _bt(f"SELECT p.property_key, p.target, p.horizon, p.model, p.prediction, round(greatest(0, p.prediction - q.hi), 6) AS lower, round(greatest(0, p.prediction - q.lo), 6) AS upper FROM preds p LEFT JOIN (SELECT model, horizon, {_LO} AS lo, {_HI} AS hi FROM (SELECT model, horizon, list(error ORDER BY error) AS e FROM res GROUP BY ALL HAVING count(*) >= 20)) q USING (model, horizon) WHERE p.model = 'pickup' AND p.origin = {LAST} - 30"),
    ),
    "g1_drift": (lambda m: forecast.drift(residuals(m)), _bt(_DRIFT)),
    "g2_model_registry": (
        lambda m: forecast.model_registry(forecast.score(rows(m)), forecast.drift(residuals(m)), "120/3"),
        _bt(f"SELECT s.model, CAST(sum(s.n) AS BIGINT) AS forecasts, {rdiv('CAST(sum(CAST(round(mae * 1e4) AS BIGINT) * s.n) AS BIGINT)', 'CAST(sum(s.n) * 10 AS BIGINT)')} / 1000.0::DOUBLE AS mae, coalesce(max(w.champion_horizons), '') AS champion_horizons, max(d.verdict) AS verdict, sha256(s.model || '|120/3') AS config FROM sc s LEFT JOIN ({_DRIFT}) d ON d.model = s.model LEFT JOIN (SELECT model, string_agg(CAST(horizon AS VARCHAR), ',' ORDER BY horizon) AS champion_horizons FROM (SELECT horizon, arg_min(model, (mae, {_ORDER})) AS model FROM sc GROUP BY 1) GROUP BY 1) w ON w.model = s.model GROUP BY 1", sc=f"SELECT model, horizon, {_SCORE} FROM bt GROUP BY ALL"),
    ),
    "c1_paired_observations": (pairs, sql("SELECT * FROM pairs", "daily", "day_context", **_PAIR_CTES)),
    "c2_offset_profile": (lambda m: calendar_fx.offset_profile(pairs(m)), sql(_effects('"offset"', '"offset" BETWEEN -7 AND 10'), "daily", "day_context", **_PAIR_CTES)),
    "c3_holiday_effects": (
        lambda m: calendar_fx.holiday_effects(pairs(m)),
        sql(f"""SELECT e.*, peak_offset, occurrences FROM ({_effects('holiday')}) e JOIN (SELECT holiday, arg_max("offset", (abs(round(m, 3)), "offset")) AS peak_offset FROM (SELECT holiday, "offset", avg({_DIFF}) AS m FROM pairs GROUP BY ALL) GROUP BY 1) USING (holiday) JOIN (SELECT holiday, count(DISTINCT year(stay_date)) AS occurrences FROM pairs GROUP BY 1) USING (holiday)""", "daily", "day_context", **_PAIR_CTES),
    ),
    "c4_holiday_multiplier": (
        lambda m: calendar_fx.holiday_multiplier(pairs(m)),
        sql(f"""SELECT holiday, "offset", round(avg(occupancy_bp / baseline_bp), 6) AS multiplier FROM pairs WHERE baseline_bp > 0 AND holiday IN (SELECT holiday FROM ({_effects('holiday')}) WHERE n >= 3 AND (ci_low_bp > 0 OR ci_high_bp < 0)) GROUP BY ALL""", "daily", "day_context", **_PAIR_CTES),
    ),
    "c4_generic_multiplier": (lambda m: calendar_fx.generic_multiplier(pairs(m)), sql("""SELECT "offset", round(avg(occupancy_bp / baseline_bp), 6) AS multiplier FROM pairs WHERE baseline_bp > 0 GROUP BY 1 HAVING count(*) >= 3""", "daily", "day_context", **_PAIR_CTES)),
    "n1_property_anomalies": (
        lambda m: anomaly.detect(daily(m), "revenue_paise", ("property_key",), gate=100_000),
        sql(_outliers("SELECT property_key, stay_date, CAST(revenue_paise AS DOUBLE) AS actual FROM daily", "revenue_paise", "CAST(property_key AS VARCHAR)", "property_key, ", "100000"), "daily"),
    ),
    "n2_portfolio_anomalies": (lambda m: anomaly.portfolio_anomalies(portfolio(m)), sql(_PORT_ANOM, "daily", port=_PORT)),
    "n3_attribution": (
        lambda m: anomaly.attribute(anomaly.detect(portfolio(m), "revenue_paise", gate_share=0.15), daily(m), "revenue_paise", "property_key"),
        sql(f"""SELECT stay_date, property_key, CAST(rank AS INT) AS rank, round(delta, 3) AS delta, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY stay_date ORDER BY abs(delta) DESC, property_key) AS rank, abs(delta) / nullif(sum(abs(delta)) OVER (PARTITION BY stay_date), 0) AS share FROM (SELECT property_key, stay_date, actual - baseline AS delta FROM ({_Z.format(keys='property_key, ', source='SELECT property_key, stay_date, CAST(revenue_paise AS DOUBLE) AS actual, 0 AS g FROM daily')}))
        WHERE stay_date IN (SELECT stay_date FROM ({_outliers(_series('revenue_paise'), 'revenue_paise', chr(39) + 'P' + chr(39), '', 'abs(baseline) * 0.15')}))) WHERE rank <= 3""", "daily", port=_PORT),
    ),
    "n5_volume_series": (
        lambda m: anomaly.volume_series(m.requests()),
        sql("SELECT c.channel, d AS stay_date, count(r.request_key) AS requests FROM (SELECT DISTINCT channel FROM request) c CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(min(request_date) AS TIMESTAMP), CAST(max(request_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM request) LEFT JOIN request r ON r.channel = c.channel AND r.request_date = d GROUP BY ALL", "request"),
    ),
    "n5_sla_series": (lambda m: anomaly.sla_series(views.service_kpi(m.requests())), sql("SELECT property_key, day_part, request_date AS stay_date, count(*) FILTER (is_sla_breached) AS breaches, count(*) AS resolved FROM request WHERE resolution_minutes IS NOT NULL GROUP BY ALL", "request")),
    "n4_alert_budget": (
        lambda m: portfolio(m).agg((F.count("*") * 3).alias("tests")).select("tests", F.round(F.col("tests") * F.lit(anomaly.false_alert_budget(1.0)), 6).alias("expected_by_chance")),
        sql(f"SELECT count(*) * 3 AS tests, round(count(*) * 3 * CAST({anomaly.false_alert_budget(1.0)!r} AS DOUBLE), 6) AS expected_by_chance FROM (SELECT DISTINCT stay_date FROM daily)", "daily"),
    ),
    "w1_window_totals": (
        lambda m: rootcause.window_totals(unit_nights(m), CUR, BASE),
        sql(f"SELECT *, round(sold / available, 9) AS occ, round(revenue_paise / nullif(sold, 0), 6) AS adr, round(revenue_paise / available, 6) AS revpar FROM (SELECT CASE WHEN {_ERA} THEN 'current' ELSE 'base' END AS era, count(*) FILTER (is_sellable) AS available, count(*) FILTER (is_occupied) AS sold, CAST(sum(revenue_paise) AS BIGINT) AS revenue_paise, count(*) FILTER (is_out_of_order) AS out_of_order FROM unit_night WHERE {_ERA} OR {_BASE} GROUP BY 1)", "unit_night"),
    ),
    "w2_components": (
        lambda m: rootcause.explain_components(unit_nights(m), CUR, BASE),
        sql(f"SELECT round(r1 / a1 - r0 / a0, 4) AS change, round((r1 / s1 - r0 / s0) * (s0 / a0 + s1 / a1) / 2, 4) AS rate_effect, round((s1 / a1 - s0 / a0) * (r0 / s0 + r1 / s1) / 2, 4) AS occupancy_effect, 0.0 AS residual FROM (SELECT count(*) FILTER (is_sellable AND {_ERA}) AS a1, count(*) FILTER (is_sellable AND {_BASE}) AS a0, count(*) FILTER (is_occupied AND {_ERA}) AS s1, count(*) FILTER (is_occupied AND {_BASE}) AS s0, CAST(sum(revenue_paise) FILTER ({_ERA}) AS BIGINT) AS r1, CAST(sum(revenue_paise) FILTER ({_BASE}) AS BIGINT) AS r0 FROM unit_night)", "unit_night").replace("0.0 AS residual", "CAST(0 AS DOUBLE) AS residual"),
    ),
    "w3_attribute_revpar": (lambda m: rootcause.attribute_revpar(unit_nights(m), F.col("property_key"), CUR, BASE), sql(_W3.format(_two("CAST(property_key AS VARCHAR) AS member")), "unit_night")),
    "w3_attribute_weekend": (
        lambda m: rootcause.attribute_revpar(unit_nights(m), F.when(F.weekday("stay_date") >= 5, "weekend").otherwise("weekday"), CUR, BASE),
        sql(_W3.format(_two("CASE WHEN isodow(stay_date) >= 6 THEN 'weekend' ELSE 'weekday' END AS member")), "unit_night"),
    ),
    "w4_attribute_revenue": (lambda m: rootcause.attribute_revenue(unit_nights(m), "channel_code", CUR, BASE), sql(f"SELECT member, r1 - r0 AS revenue_change_paise, a1 - a0 AS nights_change FROM ({_two('channel_code AS member', 'is_occupied')}) WHERE member IS NOT NULL", "unit_night")),
    "w5_mix_vs_rate": (
        lambda m: rootcause.mix_vs_rate(unit_nights(m), "channel_code", CUR, BASE),
        sql(f"""SELECT round(change, 3) AS change, round(rate, 3) AS rate_effect, round(mix, 3) AS mix_effect, round(change - rate - mix, 3) AS interaction, CASE WHEN abs(rate) >= 2 * abs(mix) THEN 'rate' WHEN abs(mix) >= 2 * abs(rate) THEN 'mix' ELSE 'both' END AS verdict FROM (SELECT sum(a0 / t0 * (q1 - q0)) AS rate, sum((a1 / t1 - a0 / t0) * q0) AS mix, max(v1 / t1 - v0 / t0) AS change FROM (
        SELECT *, coalesce(r0 / nullif(a0, 0), 0) AS q0, coalesce(r1 / nullif(a1, 0), 0) AS q1, CAST(sum(a0) OVER () AS BIGINT) AS t0, CAST(sum(a1) OVER () AS BIGINT) AS t1, CAST(sum(r0) OVER () AS BIGINT) AS v0, CAST(sum(r1) OVER () AS BIGINT) AS v1 FROM ({_two('channel_code', 'is_occupied')}) WHERE channel_code IS NOT NULL))""", "unit_night"),
    ),
    "w6_explain_revpar": (
        lambda m: rootcause.explain_revpar(unit_nights(m), CUR),
        sql("""SELECT round(100 * (v1 / v0 - 1), 4) AS move_pct, abs(v1 / v0 - 1) >= 0.01 AS material, drivers, round(c, 4) AS concentration, grown AS capacity_material, CASE WHEN c >= 0.5 THEN CASE WHEN grown THEN 'medium' ELSE 'high' END WHEN c >= 0.3 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT *, coalesce(CASE WHEN net >= 0 THEN up ELSE -down END / nullif(gross, 0), 0) AS c FROM (SELECT sum(effect) AS net, sum(abs(effect)) AS gross, max(effect) FILTER (effect > 0) AS up, min(effect) FILTER (effect < 0) AS down, coalesce(string_agg(member, ',' ORDER BY member) FILTER (abs(share_of_movement) >= 0.1 AND r <= 8), '') AS drivers FROM ranked),
        (SELECT round(sum(r1) / sum(a1), 6) AS v1, round(sum(r0) / sum(a0), 6) AS v0, abs(sum(a1) / sum(a0) - 1) >= 0.05 AS grown FROM sums))""", "unit_night", sums=_two("CAST(property_key AS VARCHAR) AS member"), parts=_W3.format(_two("CAST(property_key AS VARCHAR) AS member")),
        ranked="SELECT *, row_number() OVER (ORDER BY abs(effect) DESC, member) AS r FROM (SELECT *, capacity_mix_effect + performance_effect AS effect FROM parts)"),
    ),
}
