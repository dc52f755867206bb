"""Queries of the fitted cancellation and no-show models (X1, X3 to X6, X8); the SQL takes the same Newton steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk
from ..session import scratch
from ..sources.adapter import CHANNEL_TYPES
from .base import sql

_HOT = {f"is_channel_code_{i + 1}": f"channel_code = '{c}'" for i, c in enumerate(sorted(CHANNEL_TYPES)[1:])} | {f"is_property_key_{i + 1}": f"property_key = {i + 2}" for i in range(4)} | {"is_stay_type_1": "stay_type = 'nightly'"}
#: Each feature in SQL, in the order of risk.risk_features.
FEATURES = {
    "lead": "lead_days::DOUBLE", "lead_log": "ln(1 + greatest(lead_days, 0)::DOUBLE)", "lead_curve": "tanh((lead_days - 10) / 14.0::DOUBLE)", "nights": "nights::DOUBLE", "adults": "adults::DOUBLE",
    "price": "(net_paise // greatest(nights, 1)) / 100000.0::DOUBLE", "has_discount": "(discount_paise > 0)::INT::DOUBLE", "weekend": "(isodow(check_in_date) >= 6)::INT::DOUBLE", **{n: f"({c})::INT::DOUBLE" for n, c in _HOT.items()},
}
_K = len(FEATURES)
_STEPS = 9


def _newton(t: int, lam: float = 1.0) -> dict[str, str]:
    """Step t: sums over the training rows, elimination without a pivot search (the matrix is positive definite), and the new coefficients."""
    k = _K + 1
    chance = f"(SELECT x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM std, b{t - 1} WHERE is_train)"
    hessian = f"SELECT i, j, sum(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i < {k} THEN {lam} ELSE 0 END AS v FROM {chance}, range(1, {k + 1}) r(i), range(1, {k + 1}) s(j) GROUP BY i, j"
    gradient = f"SELECT i, {k + 1} AS j, sum((p - y) * x[i]) + CASE WHEN i < {k} THEN {lam} * any_value(b[i]) ELSE 0 END AS v FROM {chance}, b{t - 1}, range(1, {k + 1}) r(i) GROUP BY i"
    return {
        f"m{t}": f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM ({hessian} UNION ALL {gradient}) GROUP BY i)",
        f"e{t}": f"SELECT 1 AS s, m FROM m{t} UNION ALL SELECT s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / r[s]) ELSE list_transform(r, lambda v, c: v - r[s] * m[s][c] / m[s][s]) END) FROM e{t} WHERE s <= {k}",
        f"b{t}": f"SELECT list_transform(b, lambda w, i: w - m[i][{k + 1}]) AS b FROM e{t}, b{t - 1} WHERE s = {k + 1}",
    }


def fitted_sql(query: str, label: str, where: str = "true") -> str:
    """``query`` over scored (booking_key, is_train, label, score) and coef (feature, weight)."""
    x = ", ".join(FEATURES.values())
    ctes = {
        "eligible": f"SELECT *, ({label})::INT::DOUBLE AS y FROM booking WHERE {where}",
        "cut": "SELECT booking_date AS split_date FROM (SELECT booking_date, row_number() OVER (ORDER BY booking_date, booking_key) AS r, count(*) OVER () AS n FROM eligible) WHERE r = CAST(floor(n * 0.75) AS BIGINT) + 1",
        "feat": f"SELECT booking_key, y, [{x}] AS x, booking_date < split_date AS is_train FROM eligible, cut",
        "stat": "SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, round(avg(v), 9) AS m, CASE WHEN round(stddev_pop(v), 9) >= 1e-9 THEN round(stddev_pop(v), 9) ELSE 1 END AS s FROM (SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM feat WHERE is_train) GROUP BY i)",
        "std": "SELECT booking_key, is_train, y, list_append(list_transform(x, lambda v, i: (v - m[i]) / s[i]), 1.0::DOUBLE) AS x FROM feat, stat",
        "b0": f"SELECT list_transform(range({_K + 1}), lambda i: 0.0::DOUBLE) AS b",
    }
    for t in range(1, _STEPS + 1):
        ctes |= _newton(t)
    names = ", ".join(f"'{n}'" for n in (*FEATURES, "intercept"))
    ctes["scored"] = f"SELECT booking_key, is_train, y AS label, round(1 / (1 + exp(-list_dot_product(x, b))), 6) AS score FROM std, b{_STEPS}"
    ctes["coef"] = f"SELECT unnest([{names}]) AS feature, unnest(b) AS weight FROM b{_STEPS}"
    return sql(query, "booking", **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def split_features(m, surviving: bool = False):
    """Features, label and split of all bookings, or of those not cancelled; written once, as every step of a fit reads them."""
    b = m.bookings()
    features = risk.risk_features(b.where("status <> 'cancelled'"), "no_show") if surviving else risk.risk_features(b)
    out = scratch(m.spark)
    risk.temporal_split(features).write.parquet(out)
    return m.spark.read.parquet(out)


def scored(m, surviving: bool = False):
    f = split_features(m, surviving)
    return risk.fit_cancellation(f).withColumn("score", F.round("score", 6))


def coefficients(m):
    return risk.fitted(split_features(m)).coefficients(m.spark)


_AUC = "SELECT sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored WHERE NOT is_train)"
_AUC = f"SELECT round((s - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auc, positives, negatives FROM ({_AUC})"
_BINS = "SELECT bin, n, predicted, observed, round(abs(predicted - observed), 4) AS error FROM (SELECT CAST(coalesce(least(floor((score - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS INT) AS bin, count(*) AS n, round(avg(score), 4) AS predicted, round(avg(label), 4) AS observed FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM scored WHERE NOT is_train) GROUP BY 1)"
_EVALUATED = "SELECT n, tp, fp, fn, tn, brier, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round(tp / nullif(tp + fp, 0) / ((tp + fn) / n), 4) AS lift FROM (SELECT count(*) AS n, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn, count(*) FILTER (NOT hit AND label = 0) AS tn, round(avg(pow(score - label, 2)), 4) AS brier FROM (SELECT *, score >= (SELECT avg(label) FROM scored WHERE is_train) AS hit FROM scored WHERE NOT is_train))"
_CANCELLED = "status = 'cancelled'"

QUERIES = {
    "x1_features": (
        lambda m: risk.risk_features(m.bookings()).select("booking_key", "label", *[F.round(n, 9).alias(n) for n in FEATURES]),
        sql(f"SELECT booking_key, ({_CANCELLED})::INT::DOUBLE AS label, {', '.join(f'round({c}, 9) AS {n}' for n, c in FEATURES.items())} FROM booking", "booking"),
    ),
    "x3_cancellation_fit": (lambda m: scored(m).select("booking_key", "is_train", "score"), fitted_sql("SELECT booking_key, is_train, score FROM scored", _CANCELLED)),
    "x3_coefficients": (lambda m: coefficients(m).select("feature", F.round("weight", 4).alias("weight")), fitted_sql("SELECT feature, round(weight, 4) AS weight FROM coef", _CANCELLED)),
    "x4_auc_of_fit": (lambda m: risk.roc_auc(scored(m).where("not is_train")), fitted_sql(_AUC, _CANCELLED)),
    "x5_calibration": (lambda m: risk.calibration(scored(m).where("not is_train")), fitted_sql(_BINS, _CANCELLED)),
    "x6_evaluation": (lambda m: risk.evaluate_risk(scored(m)), fitted_sql(_EVALUATED, _CANCELLED)),
    "x8_noshow_check": (
        lambda m: risk.roc_auc(scored(m, True).where("not is_train")).withColumn("unlearnable", F.abs(F.col("auc") - 0.5) < 0.1),
        fitted_sql(f"SELECT *, abs(auc - 0.5) < 0.1 AS unlearnable FROM ({_AUC})", "status = 'no_show'", "status <> 'cancelled'"),
    ),
}
