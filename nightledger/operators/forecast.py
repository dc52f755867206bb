"""Forecast models, a rolling-origin backtest that cannot look ahead, scores, intervals and drift.

All models are features of (keys, date) made once with windows and joined to
origins x horizons at dates no later than the origin, so nothing of the future
can enter. Series are one row per key and date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_dow
from ..functions.money import rounded_div
from ..session import stored
from .anomaly import median_of
from .grain import books_by_horizon
from .orderstats import known_by

MODELS = ("naive", "seasonal_naive", "moving_average", "dow_moving_average", "pickup", "seasonal_holiday")
KEYS = ("property_key",)


def daily_actuals(nights: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Occupied and sellable unit-nights by date."""
    return nights.groupBy(*keys, "stay_date").agg(F.count_if("is_occupied").alias("occupied"), F.count_if("is_sellable").alias("sellable"))


def otb_matrix(nights: DataFrame, dates: DataFrame, max_horizon: int = 30, first: dt.date | None = None, last: dt.date | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Long form of the on-the-books matrix: a row per date and horizon, zeros included, between optional bounds."""
    if first is not None:
        dates = dates.where(F.col("stay_date") >= F.lit(first))
    if last is not None:
        dates = dates.where(F.col("stay_date") <= F.lit(last))
    return books_by_horizon(nights, dates, max_horizon, keys)


def _mean(c: str, w) -> Column:
    return F.sum(c).over(w) / F.count(c).over(w)


def forecasts(actuals: DataFrame, otb: DataFrame, origins: DataFrame, max_horizon: int = 30, multipliers: DataFrame | None = None, context: DataFrame | None = None, keys: tuple[str, ...] = KEYS, least_history: int = 29) -> DataFrame:
    """(keys, origin, target, horizon, model, prediction) of every model at every origin.

    ``multipliers`` (holiday, offset, multiplier) and ``context`` (full_date,
    nearest_holiday, days_to_holiday, is_holiday_adjacent) feed the holiday model.
    """
    k = list(keys)
    a = actuals.select(*k, "stay_date", F.col("occupied").cast("double").alias("y"))
    by_date, by_dow = Window.partitionBy(*k).orderBy("stay_date"), Window.partitionBy(*k, iso_dow(F.col("stay_date"))).orderBy("stay_date")
    at_origin = a.select(*k, F.col("stay_date").alias("origin"), F.col("y").alias("naive"), _mean("y", by_date.rowsBetween(-27, 0)).alias("moving_average"), F.count("*").over(by_date).alias("history"))
    same_day = a.select(*k, F.col("stay_date").alias("latest"), F.col("y").alias("seasonal_naive"), _mean("y", by_dow.rowsBetween(-3, 0)).alias("dow_moving_average"))
    gap = otb.join(a, [*k, "stay_date"]).withColumn("remaining", F.col("y") - F.col("on_books"))
    last8 = Window.partitionBy(*k, iso_dow(F.col("stay_date")), "days_out").orderBy("stay_date").rowsBetween(-7, 0)
    gap = gap.select(*k, F.col("stay_date").alias("latest"), F.col("days_out").alias("horizon"), F.collect_list("remaining").over(last8).alias("past"))  # at most eight
    steps = at_origin.join(F.broadcast(origins), "origin").where(F.col("history") >= least_history)
    steps = steps.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(max_horizon)))).withColumn("target", F.expr("date_add(origin, horizon)"))
    # the latest date up to the origin that falls on the target's weekday
    steps = steps.withColumn("latest", F.expr("date_sub(origin, (7 - horizon % 7) % 7)"))
    books = otb.select(*k, F.col("stay_date").alias("target"), F.col("days_out").alias("horizon"), F.col("on_books").cast("double").alias("on_books"))
    f = steps.join(same_day, [*k, "latest"], "left").join(gap, [*k, "latest", "horizon"], "left").join(books, [*k, "target", "horizon"], "left")
    f = f.withColumn("remaining", F.when(F.size("past") > 0, median_of(F.col("past"))))  # only where a step asks for it
    f = f.withColumn("pickup", F.when(F.col("on_books").isNull(), F.col("dow_moving_average")).otherwise(F.col("on_books") + F.coalesce("remaining", F.lit(0.0))))
    if multipliers is not None and context is not None:
        near = F.broadcast(context.where("is_holiday_adjacent").select(F.col("full_date").alias("target"), F.col("nearest_holiday").alias("holiday"), F.col("days_to_holiday").alias("offset")))
        f = f.join(near, "target", "left").join(F.broadcast(multipliers.select("holiday", "offset", "multiplier")), ["holiday", "offset"], "left")
        f = f.withColumn("seasonal_holiday", F.col("dow_moving_average") * F.coalesce("multiplier", F.lit(1.0)))
    else:
        f = f.withColumn("seasonal_holiday", F.col("dow_moving_average"))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in MODELS])).alias("m")
    return f.select(*k, "origin", "target", "horizon", long).select(*k, "origin", "target", "horizon", "m.model", F.round("m.prediction", 6).alias("prediction"))


def backtest(predictions: DataFrame, actuals: DataFrame, context: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Predictions whose target exists, with actual, error (prediction less actual) and nearness to a holiday."""
    b = predictions.join(actuals.select(*keys, F.col("stay_date").alias("target"), F.col("occupied").cast("double").alias("actual")), [*keys, "target"])
    b = b.withColumn("error", F.round(F.col("prediction") - F.col("actual"), 6))
    if context is None:
        return b.withColumn("holiday_adjacent", F.lit(False))
    return b.join(F.broadcast(context.select(F.col("full_date").alias("target"), F.col("is_holiday_adjacent").alias("holiday_adjacent"))), "target", "left")


def origin_dates(spark, last: dt.date, test_days: int = 120, step: int = 3) -> DataFrame:
    """Every ``step``-th date of [last - test_days, last - 1]."""
    days = range(0, test_days, step)
    return spark.createDataFrame([(last - dt.timedelta(test_days - i),) for i in days], "origin date")


def _whole(c: Column, places: int) -> Column:
    """A number in whole units of 10^-places, whose sums have no order."""
    return F.round(c * 10.0**places).cast("long")


def score(rows: DataFrame, by: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """MAE, RMSE, bias and MAPE; MAPE only where at least 90 % of the actuals are positive.

    Errors have six places and are added as whole millionths, so that a mean does
    not depend on the order of the rows.
    """
    e, y, n = _whole(F.col("error"), 6), F.col("actual"), F.count("*")
    usable = F.count_if(y > 0)
    share = F.sum(F.when(y > 0, _whole(F.abs(F.col("error")) / y, 9)))
    mape = F.when(usable * 10 >= n * 9, rounded_div(share, usable * 1000) / 10000.0)
    rmse = F.round(F.sqrt(F.sum((e * e).cast("decimal(20,0)")).cast("double") / n) / 1e6, 4)
    return rows.groupBy(*by).agg(n.alias("n"), (rounded_div(F.sum(F.abs(e)), n * 100) / 10000.0).alias("mae"), rmse.alias("rmse"), (rounded_div(F.sum(e), n * 100) / 10000.0).alias("bias"), mape.alias("mape"))


def model_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MODELS)), c)


def winners(scores: DataFrame, by: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """The model with the least MAE; on a tie the first in order."""
    return scores.groupBy(*by).agg(F.min(F.struct("mae", model_order(F.col("model")).alias("o"), "model"))["model"].alias("model"), F.min("mae").alias("mae"))


def slices(rows: DataFrame, least: int = 30) -> DataFrame:
    """Accuracy by horizon, month, weekday and nearness to a holiday; cells with too few forecasts are left out."""
    cut = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in (("horizon", F.col("horizon")), ("month", F.month("target")), ("weekday", iso_dow(F.col("target"))), ("holiday", F.col("holiday_adjacent")))])).alias("s")
    s = score(rows.select("model", "error", "actual", cut).select("model", "error", "actual", "s.slice", "s.value"), ("slice", "value", "model")).where(F.col("n") >= least)
    return s.select("slice", "value", "model", "n", "mae", "bias")


def forward(actuals: DataFrame, otb: DataFrame, as_of: DataFrame, model: str, max_horizon: int = 30, keys: tuple[str, ...] = KEYS, **holiday) -> DataFrame:
    """One model's forecast from each origin, with occupancy against the mean capacity of the weekday over the last 28 days."""
    k = list(keys)
    f = forecasts(actuals, otb, as_of, max_horizon, keys=keys, **holiday).where(F.col("model") == model)
    a = actuals.select(*k, "stay_date", "sellable")
    c = a.join(F.broadcast(as_of), (F.col("stay_date") <= F.col("origin")) & (F.col("stay_date") > F.date_sub("origin", 28))).groupBy(*k, "origin", iso_dow(F.col("stay_date")).alias("dow")).agg((F.sum("sellable") / F.count("*")).alias("capacity"))
    f = f.withColumn("dow", iso_dow(F.col("target"))).join(c, [*k, "origin", "dow"], "left")
    return f.withColumn("occupancy_pct", F.round(100 * F.col("prediction") / F.nullif(F.col("capacity"), F.lit(0.0)), 4)).drop("dow")


def prepared_residuals(rows: DataFrame, actuals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Backtest rows with the series' level at the origin (mean of 28 days, none before) and the error relative to it."""
    w = Window.partitionBy(*keys).orderBy("stay_date").rowsBetween(-27, 0)
    level = actuals.withColumn("n", F.count("*").over(w)).withColumn("level", F.sum("occupied").over(w) / 28.0).where("n = 28 and level > 0").select(*keys, F.col("stay_date").alias("origin"), "level")
    return rows.join(level, [*keys, "origin"]).withColumn("relative_error", F.round(F.col("error") / F.col("level"), 9))


def _levels(n: Column, level: float, conformal: bool) -> tuple[Column, Column]:
    alpha = 1 - level
    if not conformal:
        return F.lit(alpha / 2), F.lit(1 - alpha / 2)
    return F.greatest(F.lit(0.0), F.floor((n + 1) * F.lit(alpha / 2)) / n), F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha / 2)) / n)


def _picks(n: Column, level: float, conformal: bool) -> list[Column]:
    """The places of the two quantiles among n sorted errors, from 1: the lower one rounded down and the upper one up."""
    q0, q1 = _levels(n, level, conformal)
    return [F.floor(q0 * (n - 1)) + 1, F.ceil(q1 * (n - 1)) + 1]


def residual_interval(residuals: DataFrame, level: float, conformal: bool = True, scaled: bool = False, least: int = 20, by: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """The pair of error quantiles by model and horizon; groups with too few residuals have none."""
    e, places = ("relative_error", 9) if scaled else ("error", 6)
    v = stored(residuals.select(*by, F.lit(dt.date(1970, 1, 1)).alias("day"), _whole(F.col(e), places).alias("v")))
    q = known_by(v, v.select(*by, F.col("day").alias("at")).distinct(), lambda n: _picks(n, level, conformal), by, least)
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("v"))) / 10.0**places
    return q.groupBy(*by).agg(F.max("n").cast("int").alias("n"), one(0).alias("lo"), one(1).alias("hi"))


def bounds(prediction: Column, lo: Column, hi: Column, scale: Column | None = None) -> tuple[Column, Column]:
    """[prediction - hi * scale, prediction - lo * scale], not below 0 and not capped above."""
    s = scale if scale is not None else F.lit(1.0)
    zero = F.lit(0.0)
    return F.greatest(zero, prediction - hi * s), F.greatest(zero, prediction - lo * s)


def coverage(residuals: DataFrame, levels: tuple[float, ...] = (0.5, 0.8, 0.95), skip: int = 20, least: int = 20, by: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """Out-of-sample coverage: at each origin the interval comes from residuals whose target was known by then.

    Groups are pooled over keys. The quantiles of all origins' sets come from
    running counts (``orderstats.known_by``), so no set is copied or sorted.
    """
    k = list(by)
    rows = stored(residuals.select(*k, "origin", "target", "prediction", "actual", "level", "error", "relative_error"))
    order = rows.groupBy(*k, "origin").agg(F.count("*").alias("rows")).withColumn("nth", F.row_number().over(Window.partitionBy(*k).orderBy("origin")))
    kinds = [(method, what, conformal, level) for method, what, conformal in (("plain", "e", False), ("conformal", "e", True), ("scaled", "r", False), ("scaled_conformal", "r", True)) for level in levels]
    forms = [(conformal, level) for conformal in (False, True) for level in levels]
    what = F.explode(F.array(F.struct(F.lit("e").alias("what"), _whole(F.col("error"), 6).alias("v")), F.struct(F.lit("r").alias("what"), _whole(F.col("relative_error"), 9).alias("v")))).alias("x")
    values = rows.select(*k, F.col("target").alias("day"), what).select(*k, "x.what", "day", "x.v")
    now = order.where(F.col("nth") > skip).select(*k, F.col("origin").alias("at"), F.explode(F.array(F.lit("e"), F.lit("r"))).alias("what"))
    q = known_by(values, now, lambda n: [p for conformal, level in forms for p in _picks(n, level, conformal)], (*by, "what"), least)
    place = lambda conformal, level: 2 * forms.index((conformal, level))
    one = lambda w, i: F.max(F.when((F.col("what") == w) & (F.col("i") == i), F.col("v"))) / (1e6 if w == "e" else 1e9)
    # a dozen pairs of quantiles meet the rows; there is a row per origin and group
    pairs = q.groupBy(*k, "at").agg(*[one(w, place(conformal, level) + side).alias(f"{n}{i}") for i, (_, w, conformal, level) in enumerate(kinds) for side, n in enumerate(("lo", "hi"))]).where("lo0 is not null")
    judged = rows.withColumnRenamed("origin", "at").join(F.broadcast(pairs), [*k, "at"])
    cases = []
    for i, (method, w, _, level) in enumerate(kinds):
        lo, hi = bounds(F.col("prediction"), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col("level") if w == "r" else None)
        cases.append(F.struct(F.lit(method).alias("method"), F.lit(level).alias("nominal"), ((F.col("actual") >= lo - 1e-9) & (F.col("actual") <= hi + 1e-9)).alias("inside"), (hi - lo).alias("width")))
    long = judged.select(*k, F.explode(F.array(*cases)).alias("c")).select(*k, "c.*")
    return long.groupBy("model", "method", "nominal").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"), F.round(F.percentile("width", 0.5), 4).alias("median_width"))


def forward_intervals(forecast: DataFrame, intervals: DataFrame) -> DataFrame:
    """A forward forecast with its bounds; null where there are too few residuals."""
    f = forecast.join(F.broadcast(intervals.select("model", "horizon", "lo", "hi")), ["model", "horizon"], "left")
    lo, hi = bounds(F.col("prediction"), F.col("lo"), F.col("hi"))
    return f.withColumn("lower", F.when(F.col("hi").isNotNull(), F.round(lo, 6))).withColumn("upper", F.when(F.col("lo").isNotNull(), F.round(hi, 6))).drop("lo", "hi")


def drift(residuals: DataFrame, horizon: int = 7, least: int = 20) -> DataFrame:
    """MAE of the later half of the origins against the earlier, absolute and relative to the level, with a verdict."""
    r = residuals.where(F.col("horizon") == horizon)
    days = r.select("origin").distinct().agg(F.sort_array(F.collect_list("origin")).alias("o"))  # the backtest's origins
    middle = F.broadcast(days.select(F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int")).alias("middle")))
    late = F.col("origin") >= F.col("middle")
    s = r.crossJoin(middle).groupBy("model").agg(
        F.count("*").alias("n"), *[(F.sum(F.when(c, F.abs(e))) / F.count_if(c)).alias(n) for n, c, e in (("e0", ~late, _whole(F.col("error"), 6)), ("e1", late, _whole(F.col("error"), 6)), ("r0", ~late, _whole(F.col("relative_error"), 9)), ("r1", late, _whole(F.col("relative_error"), 9)))]
    ).where(F.col("n") >= least)
    move = F.round(100 * (F.col("r1") / F.col("r0") - 1), 3)
    return s.select("model", "n", F.round(100 * (F.col("e1") / F.col("e0") - 1), 3).alias("absolute_pct"), move.alias("relative_pct"), F.when(move > 10, "degrading").when(move < -10, "improving").otherwise("stable").alias("verdict"))


def model_registry(scores: DataFrame, drifted: DataFrame, params: str) -> DataFrame:
    """A row per model: mean MAE, the horizons it wins, its drift and a hash of its configuration."""
    won = winners(scores).groupBy("model").agg(F.array_join(F.transform(F.sort_array(F.collect_list("horizon")), lambda h: h.cast("string")), ",").alias("champion_horizons"))
    s = scores.groupBy("model").agg(F.sum("n").alias("forecasts"), (rounded_div(F.sum(_whole(F.col("mae"), 4) * F.col("n")), F.sum("n") * 10) / 1000.0).alias("mae"))
    out = s.join(won, "model", "left").join(drifted.select("model", "verdict"), "model", "left")
    return out.withColumn("champion_horizons", F.coalesce("champion_horizons", F.lit(""))).withColumn("config", F.sha2(F.concat_ws("|", "model", F.lit(params)), 256))
