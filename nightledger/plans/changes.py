"""Queries of tables written more than once (S10, S11, Q33) and of streams over several batches (ST2, ST3, Q27)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import quality
from ..session import scratch
from ..sources import keyed
from ..streaming import feeds, silence
from .base import bp, sql
from .dq import RUNS

# S11: a booking's status under a change log in two batches; keys repeat, some are deleted, old changes come late


def status_changes(m):
    """Two batches of changes (booking_key, status, seq, deleted) to the bookings' status."""
    b = m.bookings().select("booking_key", "status")
    k = F.col("booking_key")
    change = lambda on, status, seq, deleted=False: b.where(on).select("booking_key", F.lit(status).alias("status"), F.lit(seq).cast("long").alias("seq"), F.lit(deleted).alias("deleted"))
    first = [change(k % 3 == 0, "moved", 5), change(k % 6 == 0, "moved again", 7), change(k % 10 == 1, "moved", 6, True), change(k % 4 == 1, "early", 2)]
    second = [change(k % 5 == 0, "too old", 4), change(k % 7 == 0, "last", 9), change(k % 20 == 1, "back", 8), change(k % 9 == 2, "gone", 9, True), b.where(k % 50 == 3).select(-k, F.lit("new"), F.lit(1).cast("long"), F.lit(False)).toDF("booking_key", "status", "seq", "deleted")]
    union = lambda parts: reduce(lambda x, y: x.unionByName(y), parts)
    return union(first), union(second)


def upserted(m):
    """The bookings' status after both batches, the second of which is applied twice."""
    table = keyed.KeyedTable(m.spark, f"{scratch(m.spark)}/status", StructType.fromDDL("booking_key long, status string, seq long"), ("booking_key",))
    table.merge(m.bookings().select("booking_key", "status", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted")))
    for batch in (*(changes := status_changes(m)), changes[1]):
        table.merge(batch)
    return table.rows()


_CHANGES = {
    "change": """SELECT booking_key, status, 0 AS seq, false AS deleted FROM booking UNION ALL SELECT booking_key, 'moved', 5, false FROM booking WHERE booking_key % 3 = 0 UNION ALL SELECT booking_key, 'moved again', 7, false FROM booking WHERE booking_key % 6 = 0
    UNION ALL SELECT booking_key, 'moved', 6, true FROM booking WHERE booking_key % 10 = 1 UNION ALL SELECT booking_key, 'early', 2, false FROM booking WHERE booking_key % 4 = 1 UNION ALL SELECT booking_key, 'too old', 4, false FROM booking WHERE booking_key % 5 = 0
    UNION ALL SELECT booking_key, 'last', 9, false FROM booking WHERE booking_key % 7 = 0 UNION ALL SELECT booking_key, 'back', 8, false FROM booking WHERE booking_key % 20 = 1 UNION ALL SELECT booking_key, 'gone', 9, true FROM booking WHERE booking_key % 9 = 2
    UNION ALL SELECT -booking_key, 'new', 1, false FROM booking WHERE booking_key % 50 = 3""",
    # of two changes with one sequence number the larger (status, deleted) holds
    "last": "SELECT booking_key, status, seq, deleted FROM (SELECT *, row_number() OVER (PARTITION BY booking_key ORDER BY seq DESC, status DESC, deleted DESC) AS r FROM change) WHERE r = 1",
}

# S10, Q33: the rules on requests at three days, the second run of which is retried

RUN_DAYS = (dt.date(2024, 1, 10), dt.date(2024, 1, 18), dt.date(2024, 1, 29))
RESULT = "rule_id string, rows_checked long, rows_failed long, failure_bp long, passed boolean, severity string"


def history(m):
    """Runs over the requests until each day; the last one leaves the freshness rule out."""
    out = keyed.RunHistory(m.spark, f"{scratch(m.spark)}/results", StructType.fromDDL(RESULT))
    for k, day in enumerate((*RUN_DAYS, RUN_DAYS[1])):
        now = dt.datetime.combine(day, dt.time(12))
        seen = m.requests().where(F.col("created_at") < F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))
        found = quality.table_rules(seen, "request")
        if day != RUN_DAYS[-1]:
            found = found.unionByName(quality.stale_feed(seen, "created_at", now))
        if k == 1:  # the first try of the second run broke off with other figures
            found = found.withColumn("rows_failed", F.col("rows_failed") + 1)
        kept = quality.scored(found).where("rows_checked is not null")
        out.append(kept, f"run-{day:%Y%m%d}", now)
    return out


def _run_sql(k: int, day: dt.date) -> str:
    at = f"TIMESTAMP '{day} 12:00:00'"
    rules = {"DQ037": ("is_sla_breached IS DISTINCT FROM (resolution_minutes > sla_minutes)", 0, "warning"), "DQ038": ("resolution_minutes < 0", 0, "error"), "DQ041": ("request_date <> CAST(created_at + INTERVAL 330 MINUTE AS DATE)", 100, "warning")}
    rows = [f"SELECT '{r}' AS rule_id, count(*) AS c, count(*) FILTER ({f}) AS f, {t} AS t, '{s}' AS severity FROM seen{k}" for r, (f, t, s) in rules.items()]
    if day != RUN_DAYS[-1]:
        rows.append(f"SELECT 'DQ050', count(*), CASE WHEN max(created_at) < {at} - INTERVAL 26 HOUR THEN count(*) ELSE 0 END, 0, 'error' FROM seen{k}")
    return f"SELECT rule_id, c AS rows_checked, f AS rows_failed, CASE WHEN c = 0 THEN 0 ELSE {bp('f', 'c')} END AS failure_bp, f * 10000 <= c * t AS passed, severity, {at} AS run_at, 'run-{day:%Y%m%d}' AS run_id FROM ({' UNION ALL '.join(rows)})"


_HISTORY = {f"seen{k}": f"SELECT * FROM request WHERE created_at < TIMESTAMP '{d} 12:00:00'" for k, d in enumerate(RUN_DAYS)} | {"history": " UNION ALL ".join(_run_sql(k, d) for k, d in enumerate(RUN_DAYS))}
_WEIGHT = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
_SCORE = f"count(*) AS rules, count(*) FILTER (passed) AS rules_passed, {bp(f'coalesce(sum({_WEIGHT}) FILTER (passed), 0)', f'sum({_WEIGHT})')} AS score_bp"


def score_trend(m):
    return history(m).read().groupBy("run_id").agg(*_score())


def latest_score(m):
    """The score over the latest result of each rule."""
    return history(m).latest().agg(*_score())


def _score():
    w = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return F.count("*").alias("rules"), F.count_if("passed").alias("rules_passed"), quality.bp(F.sum(F.when(F.col("passed"), w).otherwise(0)), F.sum(w)).alias("score_bp")


# ST2, ST3, Q27: events in slices of time, each a batch, read by as many runs of one query


def streamed(m, slices, job, **options):
    """What ``job`` makes of a stream whose slices are read one a batch, with a restart after each; and its progress.

    ``slices`` are rows with a column slice, made once; options are those of
    feeds.run_batches. A slice arrives in as many files as tasks wrote it, and a
    run takes all that are new as one batch, so no task holds a slice.
    """
    out = scratch(m.spark)
    slices.write.partitionBy("slice").parquet(f"{out}/slices")
    held = m.spark.read.schema(slices.schema).parquet(f"{out}/slices")
    read, progress = None, []
    for n in sorted(r[0] for r in held.select("slice").distinct().collect()):
        held.where(F.col("slice") == n).drop("slice").write.mode("append").parquet(f"{out}/in")
        stream = m.spark.readStream.schema(slices.drop("slice").schema).parquet(f"{out}/in")
        read, done = feeds.run_batches(job(stream), f"{out}/out", f"{out}/offsets", **options)
        progress += done
    return read, progress


KEYS = ("guest_key", "unit_key", "check_in_date")


def submissions(m):
    """First submissions by year of booking; some come again within seconds, some after three years, and some arrive three years late."""
    b = m.bookings().groupBy(*KEYS).agg(F.min("booked_at").alias("booked_at"))
    again = b.where("guest_key % 5 = 0").withColumn("booked_at", F.expr("booked_at + interval 30 seconds"))
    back = b.where("guest_key % 5 = 1 and year(booked_at) <= 1998").withColumn("booked_at", F.expr("booked_at + interval 1096 days"))
    late = b.where("guest_key % 5 = 2 and year(booked_at) <= 1998").withColumn("unit_key", F.col("unit_key") + 1_000_000)
    in_time = b.unionByName(again).unionByName(back).withColumn("slice", F.year("booked_at"))
    return in_time.unionByName(late.withColumn("slice", F.year("booked_at") + 3))


_ARRIVED = {
    "fresh": "SELECT guest_key, unit_key, check_in_date, min(booked_at) AS booked_at FROM booking GROUP BY ALL",
    "arrived": """SELECT *, year(booked_at) AS slice FROM (SELECT * FROM fresh UNION ALL SELECT guest_key, unit_key, check_in_date, booked_at + INTERVAL 30 SECOND FROM fresh WHERE guest_key % 5 = 0 UNION ALL SELECT guest_key, unit_key, check_in_date, booked_at + INTERVAL 1096 DAY FROM fresh WHERE guest_key % 5 = 1 AND year(booked_at) <= 1998)
    UNION ALL SELECT guest_key, unit_key + 1000000, check_in_date, booked_at, year(booked_at) + 3 FROM fresh WHERE guest_key % 5 = 2 AND year(booked_at) <= 1998""",
    # late: older than the newest row of all slices before, less ten minutes
    "seen": "SELECT slice, max(upto) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT slice, max(booked_at) AS upto FROM arrived GROUP BY 1)",
    "judged": "SELECT a.*, coalesce(booked_at <= seen - INTERVAL 10 MINUTE, false) AS late FROM arrived a JOIN seen USING (slice)",
    "kept": "SELECT * FROM (SELECT *, lag(booked_at) OVER (PARTITION BY guest_key, unit_key, check_in_date ORDER BY booked_at) AS before FROM judged WHERE NOT late) WHERE before IS NULL OR booked_at - before > INTERVAL 10 MINUTE",
}


def kept_submissions(m):
    """The first of each key's submissions that are not late; a last row at the end of time closes all that is open, and stays open."""
    rows = submissions(m)
    over = m.spark.range(1).select(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(rows.columns, (None, None, None, "9999-01-01", 9999), strict=True)))
    with feeds.rocksdb(m.spark):  # a slice's keys are the state
        kept = streamed(m, rows.unionByName(over), feeds.first_of_repeats)[0]
    return kept.select(*KEYS, F.col("booked_at").cast("timestamp_ntz").alias("booked_at"))


def submission_counts(m):
    """How many rows came, were too late, and were kept."""
    with feeds.rocksdb(m.spark):
        kept, progress = streamed(m, submissions(m), feeds.drop_repeats)
    late = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    rows = sum(p["numInputRows"] for p in progress)
    return kept.agg(F.lit(rows).cast("long").alias("rows"), F.lit(late).cast("long").alias("late"), F.count("*").alias("kept"))


def request_slices(m, late_every: int | None = 97):
    """Requests in slices of five days; every so many-th arrives three slices late."""
    r = m.requests().select("request_key", "created_at", "channel", F.floor(F.datediff("created_at", F.lit(dt.date(2024, 1, 1))) / 5).cast("int").alias("slice"))
    if late_every:
        r = r.withColumn("slice", F.col("slice") + F.when(F.col("request_key") % late_every == 0, 3).otherwise(0))
    return r.drop("request_key")


_SLICES = {
    "came": "SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) / 5) AS INT) + CASE WHEN request_key % 97 = 0 THEN 3 ELSE 0 END AS slice FROM request",
    "upto": "SELECT slice, max(m) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT slice, max(created_at) AS m FROM came GROUP BY 1)",
    "counted": "SELECT c.* FROM came c JOIN upto USING (slice) WHERE seen IS NULL OR request_date + INTERVAL '18 hours 30 minutes' > seen - INTERVAL 2 DAY",
}


def silent_runs_streamed(m):
    """The silent channels of the requests in slices, without late rows; a last row far ahead closes all days."""
    slices = request_slices(m, None)
    first = slices.agg(F.min(F.to_date(F.expr("created_at + interval 330 minutes")))).first()[0]
    end = slices.agg(F.max("created_at").alias("created_at"), F.max("slice").alias("slice"))
    over = end.select(F.expr("created_at + interval 10 days").alias("created_at"), F.lit("end").alias("channel"), (F.col("slice") + 1).alias("slice"))
    with feeds.rocksdb(m.spark):
        return streamed(m, slices.unionByName(over), lambda s: silence.silent_channels(s, first))[0].where("channel <> 'end'")


QUERIES = {
    "s11_keyed_changes": (upserted, sql("SELECT booking_key, status, CAST(seq AS BIGINT) AS seq FROM last WHERE NOT deleted", "booking", **_CHANGES)),
    "s10_latest_results": (lambda m: history(m).latest().select("rule_id", "rows_checked", "rows_failed", "failure_bp", "passed", "run_id"), sql("SELECT rule_id, rows_checked, rows_failed, failure_bp, passed, run_id FROM history QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY run_at DESC) = 1", "request", **_HISTORY)),
    "q33_score_trend": (score_trend, sql(f"SELECT run_id, {_SCORE} FROM history GROUP BY 1", "request", **_HISTORY)),
    "q33_latest_score": (latest_score, sql(f"SELECT {_SCORE} FROM (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY run_at DESC) = 1)", "request", **_HISTORY)),
    "st2_volume_in_batches": (
        lambda m: streamed(m, request_slices(m), feeds.daily_volume)[0],
        sql("SELECT request_date, channel, count(*) AS n FROM counted WHERE request_date + INTERVAL '18 hours 30 minutes' <= (SELECT max(created_at) FROM request) - INTERVAL 2 DAY GROUP BY ALL", "request", **_SLICES),
    ),
    "st3_repeats_in_batches": (kept_submissions, sql("SELECT guest_key, unit_key, check_in_date, booked_at FROM kept", "booking", **_ARRIVED)),
    "st3_late_rows": (submission_counts, sql("SELECT count(*) AS rows, count(*) FILTER (late) AS late, (SELECT count(*) FROM kept) AS kept FROM judged", "booking", **_ARRIVED)),
    "q27_silent_feed_streamed": (silent_runs_streamed, sql("SELECT * FROM runs", "request", runs=RUNS)),
}
