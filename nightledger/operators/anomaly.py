"""Robust outliers against the same weekday's recent past, with a gate for what matters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_dow

Z, LOOKBACK, LEAST = 3.5, 8, 6


def median_of(a):
    """The median of a short array."""
    n, s = F.size(a), F.sort_array(a)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)


def with_history(df: DataFrame, metric: str, keys: tuple[str, ...], lookback: int = LOOKBACK, least: int = LEAST) -> DataFrame:
    """Dates with enough history: the last ``lookback`` values of the same weekday strictly before, their median and scaled MAD."""
    w = Window.partitionBy(*keys, iso_dow(F.col("stay_date"))).orderBy("stay_date").rowsBetween(-lookback, -1)
    d = df.where(F.col(metric).isNotNull()).select(*keys, "stay_date", F.col(metric).cast("double").alias("actual"))
    d = d.withColumn("past", F.collect_list("actual").over(w)).where(F.size("past") >= least)
    d = d.withColumn("baseline", median_of(F.col("past")))
    return d.withColumn("scale", 1.4826 * median_of(F.transform("past", lambda x: F.abs(x - F.col("baseline"))))).withColumn("support", F.size("past")).drop("past")


def detect(df: DataFrame, metric: str, keys: tuple[str, ...] = (), gate: float = 0.0, z: float = Z, gate_share: float = 0.0) -> DataFrame:
    """Outliers of one metric by ``keys``: |z| at least ``z`` and the deviation at least the gate (or a share of the baseline).

    On a flat history any move of at least the gate counts, with z just over the threshold.
    """
    h = with_history(df, metric, keys)
    dev = F.col("actual") - F.col("baseline")
    g = F.greatest(F.lit(float(gate)), F.abs(F.col("baseline")) * gate_share)
    flat = F.col("scale") <= 1e-9
    score = F.when(flat, F.when(F.abs(dev) >= F.greatest(g, F.lit(1e-9)), F.signum(dev) * (z + 1)).otherwise(0.0)).otherwise(dev / F.col("scale"))
    out = h.withColumn("deviation", dev).withColumn("robust_z", F.round(score, 6)).where((F.abs("robust_z") >= z) & (F.abs(dev) >= g))
    segment = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("PORTFOLIO")
    sure = F.when((F.abs("robust_z") >= z + 2) & (F.col("support") >= LOOKBACK), "high").otherwise("medium")
    return out.select(F.lit(metric).alias("metric"), segment.alias("segment"), "stay_date", "actual", "baseline", "deviation", "robust_z", F.when(dev > 0, "above").otherwise("below").alias("direction"), sure.alias("confidence"))


def portfolio_anomalies(kpi: DataFrame) -> DataFrame:
    """Revenue (15 % of the median), occupancy (8 points) and ADR (350) over one row per date."""
    return detect(kpi, "revenue_paise", gate_share=0.15).unionByName(detect(kpi, "occupancy_bp", gate=800)).unionByName(detect(kpi, "adr_paise", gate=35_000))


def attribute(anomalies: DataFrame, segments: DataFrame, metric: str, key: str, top: int = 3) -> DataFrame:
    """For each anomalous date the segments that moved most against their own same-weekday median."""
    h = with_history(segments, metric, (key,)).withColumn("delta", F.col("actual") - F.col("baseline"))
    d = h.join(F.broadcast(anomalies.select("stay_date").distinct()), "stay_date")
    day = Window.partitionBy("stay_date")
    d = d.withColumn("share", F.abs("delta") / F.nullif(F.sum(F.abs("delta")).over(day), F.lit(0.0)))
    d = d.withColumn("rank", F.row_number().over(day.orderBy(F.desc(F.abs("delta")), key)))
    return d.where(F.col("rank") <= top).select("stay_date", key, "rank", F.round("delta", 3).alias("delta"), F.round("share", 6).alias("share"))


def false_alert_budget(tests: float, z: float = Z) -> float:
    """Alerts expected by chance: tests times the two-sided tail of a normal (a number, so computed on the driver)."""
    return tests * math.erfc(z / math.sqrt(2))


def volume_series(requests: DataFrame, key: str = "channel") -> DataFrame:
    """Requests by key and date, zeros included, as a series for ``detect``."""
    n = requests.groupBy(key, F.col("request_date").alias("stay_date")).agg(F.count("*").alias("requests"))
    span = requests.agg(F.min("request_date").alias("a"), F.max("request_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("stay_date"))
    return span.crossJoin(n.select(key).distinct()).join(n, [key, "stay_date"], "left").withColumn("requests", F.coalesce("requests", F.lit(0)))


def sla_series(service: DataFrame) -> DataFrame:
    """Breaches by property, part of the day and date."""
    return service.where("resolution_minutes is not null").groupBy("property_key", "day_part", F.col("request_date").alias("stay_date")).agg(F.count_if("is_sla_breached").alias("breaches"), F.count("*").alias("resolved"))
