"""Declarative data-quality rules, their scores and freshness.

All rules on one table are one aggregate over it; a result row is rule_id,
rows_checked, rows_failed. ``scored`` adds the failure rate, the verdict and the
rule's metadata.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import business_date
from ..functions.money import bp, rounded_div
from .grain import GONE, normalised_guests


@dataclass(frozen=True)
class Rule:
    rule_id: str
    dimension: str
    severity: str  # error, warning or info
    threshold_bp: int
    defect: str
    table: str = ""
    fails: Callable[[], Column] | None = None  # for rules on the rows of one table


def _c(name: str) -> Column:
    return F.col(name)


_live = lambda: ~_c("status").isin(*GONE)
RULES = (
    Rule("DQ001", "completeness", "warning", 200, "missing_contact", "guest", lambda: _c("phone").isNull() | _c("email").isNull()),
    Rule("DQ002", "completeness", "error", 0, "missing_channel", "booking", lambda: _c("channel_code").isNull()),
    Rule("DQ003", "completeness", "warning", 100, "missing_rating", "review", lambda: _c("half_stars").isNull()),
    Rule("DQ004", "completeness", "error", 0, "missing_property", "unit_night", lambda: _c("property_key").isNull()),
    Rule("DQ010", "uniqueness", "error", 0, "duplicate_booking"),
    Rule("DQ011", "uniqueness", "warning", 100, "duplicate_guest"),
    Rule("DQ012", "uniqueness", "error", 0, "duplicate_unit_night"),
    Rule("DQ020", "validity", "error", 0, "bad_stay", "booking", lambda: (_c("stay_type") == "nightly") & (_c("check_out_date") <= _c("check_in_date"))),
    Rule("DQ021", "validity", "error", 0, "bad_rating", "review", lambda: ~_c("half_stars").between(2, 10)),
    Rule("DQ022", "validity", "error", 0, "bad_amount", "booking", lambda: _live() & (_c("net_paise") <= 0)),
    Rule("DQ023", "validity", "error", 0, "bad_nights", "booking", lambda: (_c("stay_type") == "nightly") & ~_c("nights").between(0, 60)),
    Rule("DQ024", "validity", "warning", 0, "negative_lead", "booking", lambda: _c("lead_days") < 0),
    Rule("DQ025", "consistency", "warning", 0, "stock_balance", "inventory", lambda: _c("opening") + _c("received") - _c("consumed") - _c("wastage") != _c("closing")),
    Rule("DQ026", "validity", "warning", 0, "negative_stock", "inventory", lambda: _c("closing") < 0),
    Rule("DQ030", "integrity", "error", 50, "orphan_payment", "payment", lambda: _c("booking_key").isNull()),
    Rule("DQ031", "consistency", "warning", 100, "amount_mismatch"),
    Rule("DQ032", "consistency", "error", 0, "cancel_flag", "booking", lambda: (_c("status") == "cancelled") != _c("cancel_date").isNotNull()),
    Rule("DQ033", "consistency", "error", 0, "ghost_occupancy"),
    Rule("DQ034", "consistency", "error", 0, "night_after_departure"),
    Rule("DQ035", "consistency", "error", 0, "vacant_revenue", "unit_night", lambda: ~_c("is_occupied") & (_c("revenue_paise") != 0)),
    Rule("DQ036", "consistency", "error", 0, "ooo_sellable", "unit_night", lambda: _c("is_out_of_order") & _c("is_sellable")),
    Rule("DQ037", "consistency", "warning", 0, "breach_flag", "request", lambda: ~_c("is_sla_breached").eqNullSafe(_c("resolution_minutes") > _c("sla_minutes"))),
    Rule("DQ038", "validity", "error", 0, "time_travel", "request", lambda: _c("resolution_minutes") < 0),
    Rule("DQ040", "timeliness", "error", 0, "booking_date_drift", "booking", lambda: _c("booking_date") != business_date(_c("booked_at"))),
    Rule("DQ041", "timeliness", "warning", 100, "request_date_drift", "request", lambda: _c("request_date") != business_date(_c("created_at"))),
    Rule("DQ050", "timeliness", "error", 0, "stale_feed"),
    Rule("DQ051", "timeliness", "error", 0, "silent_feed"),
    Rule("DQ060", "integrity", "warning", 300, "missing_payment"),
    Rule("DQ061", "consistency", "error", 0, "oversold"),
)
BY_ID = {r.rule_id: r for r in RULES}


def table_rules(df: DataFrame, table: str) -> DataFrame:
    """All rules of a table in one scan."""
    own = [r for r in RULES if r.table == table]
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(r.fails()).alias(r.rule_id) for r in own])
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col("n").alias("rows_checked"), F.col(r.rule_id).alias("rows_failed")) for r in own])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def _result(df: DataFrame, rule_id: str, checked: Column, failed: Column) -> DataFrame:
    return df.agg(checked.alias("rows_checked"), failed.alias("rows_failed")).select(F.lit(rule_id).alias("rule_id"), "rows_checked", F.coalesce("rows_failed", F.lit(0)).alias("rows_failed"))


def duplicates(df: DataFrame, rule_id: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; rows with a null key are checked and are no duplicates."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return _result(groups, rule_id, F.sum("n"), F.sum(F.when(known & (F.col("n") > 1), F.col("n") - 1)))


def duplicate_samples(df: DataFrame, keys: list[str], sample: str, top: int = 5) -> DataFrame:
    """The first keys of duplicated groups, by their least ``sample``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(sample).alias("sample_key")).where("n > 1").orderBy("sample_key").limit(top).select("sample_key", "n")


def sample_keys(df: DataFrame, rule_id: str, key: str, top: int = 5) -> DataFrame:
    """The first failing keys of a rule on one table, in order."""
    return df.where(BY_ID[rule_id].fails()).select(F.lit(rule_id).alias("rule_id"), F.col(key).cast("string").alias("sample_key"), F.col(key).alias("k")).orderBy("k").limit(top).drop("k")


def amount_mismatch(payments: DataFrame, bookings: DataFrame) -> DataFrame:
    both = payments.where("booking_key is not null").join(bookings.select("booking_key", "net_paise"), "booking_key")
    return _result(both, "DQ031", F.count("*"), F.count_if(F.abs(F.col("gross_paise") - F.col("net_paise")) > 100))


def occupancy_rules(nights: DataFrame, bookings: DataFrame) -> DataFrame:
    """DQ033 and DQ034: occupied nights of bookings that did not stay, nightly ones at or after departure; one join."""
    both = nights.where("is_occupied").select("booking_key", "stay_date", "stay_type").join(bookings.select("booking_key", "status", "check_out_date"), "booking_key")
    nightly = F.col("stay_type") == "nightly"
    s = both.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*GONE)).alias("ghost"), F.count_if(nightly).alias("n2"), F.count_if(nightly & (F.col("stay_date") >= F.col("check_out_date"))).alias("late"))
    rows = F.array(F.struct(F.lit("DQ033").alias("rule_id"), F.col("n").alias("rows_checked"), F.col("ghost").alias("rows_failed")), F.struct(F.lit("DQ034").alias("rule_id"), F.col("n2").alias("rows_checked"), F.col("late").alias("rows_failed")))
    return s.select(F.explode(rows).alias("r")).select("r.*")


def stale_feed(df: DataFrame, ts: str, now: dt.datetime, hours: int = 26) -> DataFrame:
    """All rows fail if the newest is older than ``hours`` at ``now``."""
    s = df.agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp_ntz")).alias("last"))
    limit = F.lit((now - dt.timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp_ntz")
    return s.select(F.lit("DQ050").alias("rule_id"), F.col("n").alias("rows_checked"), F.when(F.col("last") < limit, F.col("n")).otherwise(0).cast("long").alias("rows_failed"))


def silent_runs(requests: DataFrame, window: int = 56, healthy: float = 1.0, least_days: int = 4) -> DataFrame:
    """(channel, from_date, to_date, quiet_days): runs without volume on a channel that normally has some.

    Volumes are counted first, so the windows run over a row per channel and day.
    """
    volume = requests.where("channel is not null").groupBy("channel", "request_date").agg(F.count("*").alias("n"))
    span = requests.agg(F.min("request_date").alias("a"), F.max("request_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("request_date"))
    grid = days.crossJoin(volume.select("channel").distinct()).join(volume, ["channel", "request_date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy("channel").orderBy("request_date")
    baseline = F.avg("n").over(by.rowsBetween(-window, -1))
    marked = grid.withColumn("quiet", (F.col("n") == 0) & F.coalesce(baseline >= healthy, F.lit(False)))
    marked = marked.withColumn("island", F.row_number().over(by) - F.row_number().over(Window.partitionBy("channel", "quiet").orderBy("request_date")))
    runs = marked.where("quiet").groupBy("channel", "island").agg(F.min("request_date").alias("from_date"), F.max("request_date").alias("to_date"), F.count("*").alias("quiet_days"))
    return runs.where(F.col("quiet_days") >= least_days).drop("island")


def silent_feed(requests: DataFrame) -> DataFrame:
    """DQ051 from the runs; checked are the cells of the channel x day grid."""
    span = requests.agg((F.datediff(F.max("request_date"), F.min("request_date")) + 1).alias("days"), F.countDistinct("channel").alias("channels"))
    failed = silent_runs(requests).agg(F.coalesce(F.sum("quiet_days"), F.lit(0)).alias("rows_failed"))
    return span.crossJoin(failed).select(F.lit("DQ051").alias("rule_id"), (F.col("days") * F.col("channels")).cast("long").alias("rows_checked"), "rows_failed")


def missing_payment(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Joined rows are counted, so a booking with two payments is two rows checked."""
    b = bookings.where(F.col("status") != "cancelled").select("booking_key")
    both = b.join(payments.where("booking_key is not null").select(F.col("booking_key").alias("paid")), F.col("booking_key") == F.col("paid"), "left")
    return _result(both, "DQ060", F.count("*"), F.count_if(F.col("paid").isNull()))


def oversold(kpi: DataFrame) -> DataFrame:
    return _result(kpi, "DQ061", F.count("*"), F.count_if(F.col("sold") > F.col("available")))


def run_all(tables: dict[str, DataFrame], now: dt.datetime) -> DataFrame:
    """Every rule over its tables: guest, booking, review, unit_night, inventory, payment, request, daily."""
    t = tables
    parts = [table_rules(t[name], name) for name in ("guest", "booking", "review", "unit_night", "inventory", "payment", "request")]
    parts += [
        duplicates(t["booking"], "DQ010", ["guest_key", "unit_key", "check_in_date"]), duplicates(normalised_guests(t["guest"]), "DQ011", ["phone_last10"]), duplicates(t["unit_night"], "DQ012", ["unit_key", "stay_date"]),
        amount_mismatch(t["payment"], t["booking"]), occupancy_rules(t["unit_night"], t["booking"]), stale_feed(t["request"], "created_at", now), silent_feed(t["request"]), missing_payment(t["booking"], t["payment"]), oversold(t["daily"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.dimension, r.severity, r.threshold_bp, r.defect) for r in RULES], "rule_id string, dimension string, severity string, threshold_bp int, defect string")


def scored(results: DataFrame) -> DataFrame:
    """Results with their failure rate and verdict; a rule without a result is an error and fails."""
    r = F.broadcast(rule_table(results.sparkSession))
    out = r.join(results, "rule_id", "left").withColumn("failure_bp", F.when(F.col("rows_checked") == 0, 0).otherwise(bp(F.col("rows_failed"), F.col("rows_checked"))))
    exact = F.col("rows_failed") * 10000 <= F.col("rows_checked") * F.col("threshold_bp")
    return out.withColumn("passed", F.coalesce(exact, F.lit(False)))


def quality_score(scores: DataFrame) -> DataFrame:
    """The pass rate weighted by severity (error 3, warning 2, info 1), in hundredths of a percent."""
    w = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return scores.agg(F.count("*").alias("rules"), F.count_if("passed").alias("rules_passed"), bp(F.sum(F.when(F.col("passed"), w).otherwise(0)), F.sum(w)).alias("score_bp"))


def defect_recall(scores: DataFrame) -> DataFrame:
    """By class of defect: rows found and whether any were."""
    return scores.groupBy("defect").agg(F.coalesce(F.sum("rows_failed"), F.lit(0)).alias("rows_found")).withColumn("detected", F.col("rows_found") > 0)


def by_dimension(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dimension").agg(F.count("*").alias("rules"), F.count_if("passed").alias("rules_passed"))


def freshness(sources: dict[str, tuple[DataFrame, str]], now: dt.datetime) -> DataFrame:
    """(source, last_seen, hours_old) of each table's newest instant or date at ``now``."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    out = None
    for name, (df, c) in sources.items():
        one = df.agg(F.max(F.col(c).cast("timestamp_ntz")).alias("last_seen")).select(F.lit(name).alias("source"), "last_seen")
        out = one if out is None else out.unionByName(one)
    seconds = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return out.withColumn("hours_old", rounded_div(seconds, 3600))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate (max of a struct) rather than a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *[f"r.{c}" for c in (*order, *rest)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` replaced or joined by those of ``new`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
