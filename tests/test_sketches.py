"""Stored sketches: merged over any span, within the stated rank error, exact where it must be."""

import random

from pyspark.sql import functions as F

from nightledger.operators import sketches


def test_merged_sketches_keep_ranks(spark):
    rng = random.Random(3)
    rows = [(d, k, int(rng.lognormvariate(6, 2)) if k == "a" else rng.choice([0, 0, 0, 7])) for d in range(40) for k in "ab" for _ in range(500)]
    df = spark.createDataFrame(rows, "day int, key string, v long")
    months = sketches.merged(sketches.stored(df.withColumn("month", F.floor(F.col("day") / 10)), F.col("v"), ("day", "month", "key")), ("month", "key"))
    got = {r["key"]: r for r in sketches.rank_checked(df, F.col("v"), sketches.merged(months, ("key",)), ("key",)).collect()}
    assert set(got) == {"a", "b"}
    for key, r in got.items():
        values = [v for _, k, v in rows if k == key]
        assert (r["n"], r["sketched"], r["least"], r["greatest"]) == (20_000, 20_000, min(values), max(values))
        assert r["p25_within"] and r["p50_within"] and r["p75_within"] and r["p90_within"]


def test_check_sees_a_wrong_quantile(spark):
    df = spark.range(10_000).select(F.lit(1).alias("key"), F.col("id").alias("v"))
    other = sketches.stored(df, F.col("v") + 1000, ("key",))
    r = sketches.rank_checked(df, F.col("v"), other, ("key",)).first()
    assert not r["p25_within"] and not r["p50_within"]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "key int, v long")
    rows = sketches.stored(df, F.col("v"), ("key",)).select("key", "n", sketches.quantile(0.5).alias("q")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 5)]
    empty = sketches.stored(df.where("false"), F.col("v"), ("key",))
    assert sketches.merged(empty, ("key",)).count() == 0
