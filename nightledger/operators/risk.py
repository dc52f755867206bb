"""Cancellation risk: features known at booking time, a temporal split, a logistic fit and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import bp, int_div
from .logit import Logit, fit

NUMERIC = ("lead", "lead_log", "lead_curve", "nights", "adults", "price", "has_discount", "weekend")


def risk_features(bookings: DataFrame, target: str = "cancelled") -> DataFrame:
    """Booking-time features and the label (status is ``target``); one-hot columns drop the first level of each category."""
    lead = F.col("lead_days")
    b = bookings.select(
        "booking_key", "booking_date", "status", lead.cast("double").alias("lead"), F.log1p(F.greatest(lead, F.lit(0)).cast("double")).alias("lead_log"), F.tanh((lead - 10) / 14.0).alias("lead_curve"), F.col("nights").cast("double").alias("nights"), F.col("adults").cast("double").alias("adults"),
        (int_div(F.col("net_paise"), F.greatest("nights", F.lit(1))) / 100000.0).alias("price"), (F.col("discount_paise") > 0).cast("double").alias("has_discount"), (F.weekday("check_in_date") >= 5).cast("double").alias("weekend"),
        "channel_code", "property_key", "stay_type", (F.col("status") == target).cast("double").alias("label"),
    )
    categories = ("channel_code", "property_key", "stay_type")
    levels = bookings.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in categories]).first()  # a handful each
    hot = [(F.col(c) == v).cast("double").alias(f"is_{c}_{i + 1}") for c in categories for i, v in enumerate(levels[c][1:])]
    return b.select("booking_key", "booking_date", "status", "label", *NUMERIC, *hot)


def temporal_split(df: DataFrame, share: float = 0.75, date: str = "booking_date") -> DataFrame:
    """``df`` with is_train: before the date at which ``share`` of the rows is reached, found from daily counts."""
    daily = df.groupBy(date).agg(F.count("*").alias("n"))
    running = daily.withColumn("upto", F.sum("n").over(Window.orderBy(date)))  # a row per date
    total = running.agg(F.max("upto").alias("total"))
    at = running.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min(date).alias("split_date"))
    return df.crossJoin(F.broadcast(at)).withColumn("is_train", F.col(date) < F.col("split_date"))


def fitted(features: DataFrame, lam: float = 1.0) -> Logit:
    """An L2 logistic regression on the training rows, standardised on them."""
    names = [c for c in features.columns if c in NUMERIC or c.startswith("is_") and c != "is_train"]
    return fit(features.where("is_train"), names, "label", lam)


def fit_cancellation(features: DataFrame, lam: float = 1.0) -> DataFrame:
    """``features`` with the score of the model that is fitted on their training rows."""
    return features.withColumn("score", fitted(features, lam).score())


def with_below(g: DataFrame, by: str, n: str, range_rows: int = 500_000) -> DataFrame:
    """``g``, one row per value of ``by``, with ``below``: the sum of ``n`` over all smaller values.

    Values are cut into ranges of about ``range_rows`` at quantiles; a running sum
    within each range is added to what the ranges before it hold, a row a range.
    """
    ranges = min(4096, max(1, -(-g.count() // range_rows)))
    cuts = sorted(set(g.approxQuantile(by, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    at = F.size(F.filter(F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>"), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    g = g.withColumn("range", at)
    totals = g.groupBy("range").agg(F.sum(n).alias("held"))
    offsets = totals.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.join(F.broadcast(offsets), "range").withColumn("below", inside + F.col("offset")).drop("range", "offset")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AUC by rank sum with average ranks for ties: one aggregate by distinct score and a running count."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
    w = with_below(g.withColumn("q", F.col("n") - F.col("p")), "s", "q")
    t = w.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return t.select(F.round(F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0)), 6).alias("auc"), F.col("pos").cast("long").alias("positives"), F.col("neg").cast("long").alias("negatives"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in equal-width bins over the observed range."""
    r = F.broadcast(df.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    k = F.least(F.floor((F.col("score") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    b = df.crossJoin(r).groupBy(F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("predicted"), F.round(F.avg("label"), 4).alias("observed"))
    return b.withColumn("error", F.round(F.abs(F.col("predicted") - F.col("observed")), 4))


def evaluate_risk(df: DataFrame) -> DataFrame:
    """Confusion, precision, recall, F1, lift and Brier score on the test rows, at the training base rate."""
    base = F.broadcast(df.where("is_train").agg(F.avg("label").alias("base")))
    t = df.where("not is_train").crossJoin(base)
    hit, pos = F.col("score") >= F.col("base"), F.col("label") == 1
    s = t.agg(F.count("*").alias("n"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"), F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 4).alias("brier"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    rate = (F.col("tp") + F.col("fn")) / F.col("n")
    return s.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), 4).alias("f1"), F.round(precision / rate, 4).alias("lift"))


def cancellation_by_quarter(bookings: DataFrame, least: int = 50) -> DataFrame:
    """Cancellation rate by booking quarter, for quarters with enough bookings."""
    q = bookings.groupBy(F.date_trunc("quarter", F.col("booking_date").cast("timestamp_ntz")).cast("date").alias("quarter")).agg(F.count("*").alias("bookings"), F.count_if(F.col("status") == "cancelled").alias("cancelled"))
    return q.where(F.col("bookings") >= least).withColumn("cancel_bp", bp(F.col("cancelled"), F.col("bookings")))


def temporal_drift(bookings: DataFrame, least: int = 50) -> DataFrame:
    """The first and the last quarter's rate and the change between them."""
    q = cancellation_by_quarter(bookings, least)
    s = q.agg(F.min_by("cancel_bp", "quarter").alias("first_bp"), F.max_by("cancel_bp", "quarter").alias("last_bp"))
    return s.withColumn("change_bp", F.col("last_bp") - F.col("first_bp"))


def lead_rule_auc(bookings: DataFrame, surviving: bool = False) -> DataFrame:
    """The AUC of lead time alone: for cancellations, or for no-shows among the bookings that were not cancelled."""
    b = bookings.where(F.col("status") != "cancelled") if surviving else bookings
    label = (F.col("status") == ("no_show" if surviving else "cancelled")).cast("double")
    a = roc_auc(b.select(label.alias("label"), F.col("lead_days").cast("double").alias("score")))
    return a.withColumn("unlearnable", F.abs(F.col("auc") - 0.5) < 0.1)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, ties at their average rank; ranks come from counts by distinct value."""
    def ranks(c):
        g = with_below(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")), c, "n")
        return g.select(F.col(c), (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(ranks(a), a).join(ranks(b), b)
    return r.agg(F.round(F.corr(f"rank_{a}", f"rank_{b}"), 6).alias("spearman"))


def wash_rate(bookings: DataFrame) -> DataFrame:
    """Wash overall and by channel."""
    gone = F.count_if(F.col("status").isin("cancelled", "no_show"))
    by = bookings.groupBy("channel_code").agg(F.count("*").alias("made"), gone.alias("gone"))
    all_ = by.agg(F.lit("ALL").alias("channel_code"), F.sum("made").alias("made"), F.sum("gone").alias("gone"))
    return by.unionByName(all_).withColumn("wash_bp", bp(F.col("gone"), F.col("made")))
