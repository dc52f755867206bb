"""Exact order statistics of growing sets: the k-th smallest of what was known by each of many dates, without an array of a set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values a group is cut into: COARSE of COARSE finer ones.
COARSE = 32


def ranged(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` (by, v, ...) with the range of values each one lies in, 0 to COARSE^2 - 1, in the order of the values.

    The cuts are approximate quantiles of the group; how good they are decides
    how even the ranges are, never a result. Equal values share a range.
    """
    parts = COARSE * COARSE
    cuts = cells.groupBy(*by).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * parts).alias("cuts"))
    cuts = cuts.withColumn("coarse", F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda i: F.element_at("cuts", i * COARSE)))
    below = lambda a: F.size(F.filter(a, lambda s: s < F.col("v")))
    r = cells.join(F.broadcast(cuts), by)  # 8 KB a group; groups are models by horizons
    r = r.withColumn("above", below(F.col("coarse")))
    return r.withColumn("part", F.col("above") * COARSE + below(F.slice("cuts", F.col("above") * COARSE + 1, F.lit(COARSE)))).drop("cuts", "coarse", "above")


def known_by(values: DataFrame, at: DataFrame, picks: Callable[[Column], list[Column]], by: tuple[str, ...], least: int = 1) -> DataFrame:
    """(by, at, n, i, v): the ``picks(n)[i]``-th smallest ``v`` (counted from 1) among the n rows whose ``day`` is not after ``at``.

    ``values`` has (by, day, v) with whole numbers v, ``at`` (by, at). Rows are
    counted by range of values and day, running counts over the days are read off
    at each ``at``, and running counts over the ranges tell which range holds a
    pick; only that one is looked into again. So a row is read once and then a
    share of 1 / COARSE^2 of the group for each pick. Null values are no members;
    sets of fewer than ``least`` have no rows.
    """
    k = list(by)
    cells = values.where(F.col("v").isNotNull() & F.col("day").isNotNull()).groupBy(*k, "day", "v").agg(F.count("*").alias("c"))
    cells = ranged(cells, k)
    days = cells.groupBy(*k, "part", "day").agg(F.sum("c").alias("c")).withColumn("asked", F.lit(False))
    asked = days.select(*k, "part").distinct().join(at.select(*k, "at").distinct(), k).select(*k, "part", F.col("at").alias("day"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked"))
    upto = Window.partitionBy(*k, "part").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = days.unionByName(asked).withColumn("held", F.sum("c").over(upto)).where("asked and held > 0").select(*k, F.col("day").alias("at"), "part", "held")
    one_set = Window.partitionBy(*k, "at")  # a row a range
    held = held.withColumn("before", F.sum("held").over(one_set.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")).withColumn("n", F.sum("held").over(one_set))
    held = held.where(F.col("n") >= least)
    pick = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.cast("long").alias("nth")) for i, p in enumerate(picks(F.col("n")))])).alias("p")
    wanted = held.select(*k, "at", "part", "n", "before", "held", pick).where((F.col("p.nth") > F.col("before")) & (F.col("p.nth") <= F.col("before") + F.col("held")))
    wanted = wanted.select(*k, "at", "part", "n", "p.i", (F.col("p.nth") - F.col("before")).alias("nth"))
    inside = cells.join(wanted.select(*k, "at", "part").distinct(), [*k, "part"]).where(F.col("day") <= F.col("at")).groupBy(*k, "at", "part", "v").agg(F.sum("c").alias("c"))
    inside = inside.withColumn("last", F.sum("c").over(Window.partitionBy(*k, "at", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = wanted.join(inside, [*k, "at", "part"]).where((F.col("nth") <= F.col("last")) & (F.col("nth") > F.col("last") - F.col("c")))
    return found.select(*k, "at", "n", "i", "v")
