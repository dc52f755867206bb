"""One alert queue from four sources in one envelope; units differ by source and there is no shared severity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import bp

BANDS = ("act_now", "investigate", "standing")


def pace_alerts(scored: DataFrame) -> DataFrame:
    s = scored.where("status = 'behind'")
    label = F.concat_ws(" ", F.col("property_key").cast("string"), F.col("stay_date").cast("string"))
    return s.select(F.lit("act_now").alias("band"), F.lit("pace").alias("source"), label.alias("subject"), F.col("stay_date").alias("on_date"), F.col("days_out").cast("long").alias("days"), F.abs("gap_nights").cast("double").alias("measure"), F.lit("room-nights").alias("unit"))


def anomaly_alerts(anomalies: DataFrame, as_of: dt.date, days: int = 45) -> DataFrame:
    ago = F.datediff(F.lit(as_of), "stay_date")
    a = anomalies.where((ago >= 0) & (ago <= days))
    return a.select(F.lit("investigate").alias("band"), F.lit("anomaly").alias("source"), F.concat_ws(" ", "metric", "segment").alias("subject"), F.col("stay_date").alias("on_date"), ago.cast("long").alias("days"), F.abs("robust_z").alias("measure"), F.lit("robust z").alias("unit"))


def rule_alerts(scores: DataFrame) -> DataFrame:
    r = scores.where(~F.col("passed"))
    return r.select(F.lit("standing").alias("band"), F.lit("quality").alias("source"), F.col("rule_id").alias("subject"), F.lit(None).cast("date").alias("on_date"), F.lit(None).cast("long").alias("days"), F.col("failure_bp").cast("double").alias("measure"), F.lit("bp failed").alias("unit"))


def sla_alerts(service: DataFrame, least: int = 15, breaches: int = 20) -> DataFrame:
    """Cells at or over the upper quartile of their peers with enough breaches."""
    s = service.where("resolution_minutes is not null").groupBy("property_key", "day_part", "owning_team").agg(F.count("*").alias("n"), F.count_if("is_sla_breached").alias("b")).where(F.col("n") >= least)
    s = s.withColumn("breach_bp", bp(F.col("b"), F.col("n")))
    peers = F.broadcast(s.agg(F.percentile("breach_bp", 0.75).alias("p75")))
    s = s.crossJoin(peers).where((F.col("breach_bp") >= F.col("p75")) & (F.col("b") >= breaches))
    label = F.concat_ws(" ", F.col("property_key").cast("string"), "day_part", "owning_team")
    return s.select(F.lit("standing").alias("band"), F.lit("sla").alias("source"), label.alias("subject"), F.lit(None).cast("date").alias("on_date"), F.lit(None).cast("long").alias("days"), F.col("breach_bp").cast("double").alias("measure"), F.lit("bp breached").alias("unit"))


def alert_queue(*sources: DataFrame) -> DataFrame:
    """All alerts ranked: the band, then days to act or days ago, then the larger measure."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    band = F.when(F.col("band") == "act_now", 0).when(F.col("band") == "investigate", 1).otherwise(2)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(band, F.col("days").asc_nulls_last(), F.desc("measure"), "source", "subject")))  # a few hundred rows


def with_calendar(queue: DataFrame, context: DataFrame) -> DataFrame:
    """The queue with each dated pace alert's nearest holiday and a qualifier."""
    c = F.broadcast(context.select("full_date", "nearest_holiday", "days_to_holiday", "is_holiday_adjacent"))
    near = (F.col("source") == "pace") & F.col("is_holiday_adjacent")
    text = F.when(near, F.format_string("%d days from %s", "days_to_holiday", "nearest_holiday"))
    return queue.join(c, F.col("on_date") == F.col("full_date"), "left").withColumn("calendar_note", text).drop("full_date", "nearest_holiday", "days_to_holiday", "is_holiday_adjacent")


def alert_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("band", "source").agg(F.count("*").alias("alerts"), F.min("days").alias("soonest_days"))


def opportunity_radar(scored: DataFrame) -> DataFrame:
    """Dates ahead of their curve, with what is on the books, the nearest first."""
    return scored.where("status = 'ahead'").select("property_key", "stay_date", "days_out", "gap_nights", "revenue_paise").orderBy("days_out", F.desc("gap_nights"), "property_key")


def holiday_bias(scored: DataFrame, context: DataFrame) -> DataFrame:
    """By as_of: share of judged dates near a holiday against the share among alerts."""
    c = F.broadcast(context.select(F.col("full_date").alias("stay_date"), "is_holiday_adjacent"))
    s, bad = scored.join(c, "stay_date"), F.col("status") == "behind"
    return s.groupBy("as_of").agg(F.count("*").alias("judged"), F.count_if("is_holiday_adjacent").alias("near"), F.count_if(bad).alias("alerts"), F.count_if(bad & F.col("is_holiday_adjacent")).alias("near_alerts"),
                                  bp(F.count_if("is_holiday_adjacent"), F.count("*")).alias("base_bp"), bp(F.count_if(bad & F.col("is_holiday_adjacent")), F.count_if(bad)).alias("alert_bp"))
