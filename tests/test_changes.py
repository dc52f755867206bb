"""Keyed tables, run histories, streams over batches and the logistic fit, on hand-made rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nightledger.operators import logit
from nightledger.plans import changes
from nightledger.sources.adapter import Model
from nightledger.sources.keyed import KeyedTable, RunHistory
from nightledger.streaming import feeds, silence

CHANGE = "id long, value string, seq long, deleted boolean"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"{tmp_path}/t", StructType.fromDDL("id long, value string, seq long"), ("id",), buckets=16)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_write_wins(spark, table):
    batch = lambda *x: spark.createDataFrame(x, CHANGE)
    table.merge(batch(*[(i, "old", 0, False) for i in range(100)]))
    table.merge(batch((1, "b", 3, False), (1, "a", 2, False), (2, "gone", 5, True), (200, "new", 1, False), (3, "x", 1, False), (3, "x", 1, False)))
    want = {(i, "old", 0) for i in range(100)} - {(1, "old", 0), (2, "old", 0), (3, "old", 0)} | {(1, "b", 3), (200, "new", 1), (3, "x", 1)}
    assert rows(table.rows()) == sorted(want)
    late = batch((2, "too late", 4, False), (1, "z", 2, False), (200, "newer", 2, True))
    for _ in range(2):  # applied twice
        table.merge(late)
        assert rows(table.rows()) == sorted(want - {(200, "new", 1)})
    table.merge(batch((2, "back", 6, False)))
    assert (2, "back", 6) in rows(table.rows())
    assert table.merge(batch().where("false")) == []


def test_only_touched_buckets_are_written(spark, table):
    table.merge(spark.createDataFrame([(i, "old", 0, False) for i in range(200)], CHANGE))
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}
    before = files()
    touched = table.merge(spark.createDataFrame([(7, "new", 1, False)], CHANGE))
    assert len(touched) == 1
    assert {f.split("bucket=")[1].split("/")[0] for f in before ^ files()} == {str(touched[0])}


def test_runs_are_repeatable_and_pruned(spark, tmp_path):
    h = RunHistory(spark, f"{tmp_path}/h", StructType.fromDDL("rule_id string, failed long"))
    run = lambda *x: spark.createDataFrame(x, "rule_id string, failed long")
    day = lambda d: dt.datetime(2024, 1, d, 9)
    h.append(run(("a", 1), ("b", 2)), "r1", day(1))
    h.append(run(("a", 99)), "r2", day(2))
    h.append(run(("a", 3)), "r2", day(2))  # the retry
    h.append(run(("c", 4)), "r3", day(2))
    assert rows(h.latest().select("rule_id", "failed", "run_id")) == [("a", 3, "r2"), ("b", 2, "r1"), ("c", 4, "r3")]
    assert rows(h.read(dt.date(2024, 1, 2)).select("rule_id", "failed")) == [("a", 3), ("c", 4)]
    assert "PartitionFilters: [isnotnull(run_date" in h.read(dt.date(2024, 1, 2))._jdf.queryExecution().toString()


def test_a_broken_batch_resumes_without_loss_or_doubles(spark, tmp_path):
    at = lambda *x: dt.datetime(2024, 1, *x)
    slices = [[("a", at(1)), ("a", at(1, 0, 5)), ("b", at(1))], [("a", at(3)), ("c", at(1))], [("d", at(5)), ("d", at(5, 0, 9))], [("b", at(7)), ("late", at(2))]]
    for s in slices:
        spark.createDataFrame(s, "key string, booked_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: feeds.drop_repeats(spark.readStream.schema("key string, booked_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), ("key",))
    sink = feeds.batch_sink(f"{tmp_path}/out")

    def breaks(batch, number):
        sink(batch, number)
        if number == 2:
            raise OSError("lost after its rows were written")

    with pytest.raises(Exception, match="lost after"):
        feeds.run_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/offsets", breaks)
    out, progress = feeds.run_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/offsets")
    assert sorted(r["key"] for r in out.collect()) == ["a", "b", "b", "c", "d"]  # a is still remembered in the second batch, b no longer in the last
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1
    assert feeds.run_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/offsets")[0].count() == 5


def test_a_slice_is_one_batch_and_no_single_task(spark, sf_dir):
    slices = spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 2).cast("int").alias("slice"))
    out, progress = changes.streamed(Model(spark, sf_dir), slices, lambda s: s.select("id", F.input_file_name().alias("file")))
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [500, 500]
    assert out.select("file").distinct().count() > 2


def test_the_first_of_a_batchs_repeats_is_kept(spark, sf_dir, monkeypatch):
    """In whatever order rows come; a repeat counts from the one before it, also over slices, and late rows count for nothing."""
    at = lambda *x: dt.datetime(2024, 1, *x)
    came = [
        [(1, at(1, 0, 20)), (1, at(1, 0, 0, 30)), (1, at(1, 0, 10, 30)), (1, at(1, 0, 0)), (2, at(1, 0, 0, 30)), (2, at(1)), (2, at(1, 0, 10, 31)), (3, at(3))],
        [(3, at(3, 0, 19)), (3, at(3, 0, 9)), (4, at(2)), (5, at(2, 23, 51)), (5, at(2, 23, 50))],
    ]
    rows = [(k, 1, dt.date(2024, 2, 1), t, 2024 + n) for n, s in enumerate(came) for k, t in s]
    slices = spark.createDataFrame(rows, "guest_key long, unit_key int, check_in_date date, booked_at timestamp_ntz, slice int").coalesce(1)
    monkeypatch.setattr(changes, "submissions", lambda m: slices)
    kept = changes.kept_submissions(Model(spark, sf_dir))
    assert sorted((r["guest_key"], r["booked_at"]) for r in kept.collect()) == [(1, at(1)), (2, at(1)), (2, at(1, 0, 10, 31)), (3, at(3)), (5, at(2, 23, 51))]


def test_silence_is_told_by_timers(spark, tmp_path):
    """Channel a goes silent for good, b for five days; late rows of closed days count for nothing."""
    noon = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(d, 6 * 3600)
    days = {"a": range(6), "b": [*range(6), *range(11, 24)], "c": range(24)}
    events = [(c, noon(d)) for c, ds in days.items() for d in ds for _ in range(2)]
    slices = [[e for e in events if lo <= (e[1] - noon(0)).days < lo + 4] for lo in range(0, 24, 4)] + [[("b", noon(8)), ("end", noon(40))], [("end", noon(41))]]
    for s in slices:
        spark.createDataFrame(s, "channel string, created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("channel string, created_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with feeds.rocksdb(spark):
        out, _ = feeds.run_batches(silence.silent_channels(stream, dt.date(2024, 1, 1)), f"{tmp_path}/out", f"{tmp_path}/offsets")
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(d)
    # a: 12 events in 6 days are a mean of 1 a day until the 12th day
    assert rows(out) == [("a", day(6), day(12), 7), ("b", day(6), day(10), 5)]  # c's silence has not ended yet


def test_logit_is_the_minimum(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(5, 2, 400), rng.random(400) < 0.3, rng.normal(0, 100, 400), np.ones(400)])
    y = rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 2 * x[:, 1])))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, label double")
    m = logit.fit(df.repartition(7), ["a", "b", "c", "d"])
    z = np.column_stack([(x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), np.ones(400)])
    w = np.array([*m.weights, m.intercept])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-5 and m.steps < 15
    assert m.weights == logit.fit(df.repartition(3), ["a", "b", "c", "d"]).weights  # in any layout
    scores = np.array([r[0] for r in df.select(m.score()).collect()])
    assert np.allclose(np.sort(scores), np.sort(1 / (1 + np.exp(-z @ w))), atol=1e-6)


def test_logit_of_one_class_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (None, 1.0)], "a double, label double")
    m = logit.fit(df, ["a"])
    assert m.weights == (0.0,) and m.rows == 2 and df.where("a = 1").select(m.score()).first()[0] < 1e-9
    assert logit.fit(df.where(F.lit(False)), ["a"]).rows == 0
    apart = spark.createDataFrame([(float(i), float(i >= 5)) for i in range(10)], "a double, label double")  # no minimum without the penalty
    assert 0 < logit.fit(apart, ["a"]).weights[0] < 10
