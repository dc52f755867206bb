"""Overbooking outcomes and revenue scenarios over tables of positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import rounded_div


def arrivals(survival: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distribution of how many of independent bookings arrive (Poisson binomial), ``counts`` of them at each chance.

    Bookings of one chance are binomial: the power of [1 - p, p] under convolution, by squaring.
    """
    pmf = np.ones(1)
    for p, n in zip(survival, counts, strict=True):
        power = np.array([1 - p, p])
        while n:
            if n & 1:
                pmf = np.convolve(pmf, power)
            n >>= 1
            if n:
                power = np.convolve(power, power)
    return pmf


def overbook_outcomes(books: DataFrame, most: int = 10) -> DataFrame:
    """For each stay date and property: outcomes of accepting k = 0..most bookings beyond the book.

    ``books`` has stay_date, property_key, capacity and survival (one row per
    booking, 0 to 1). Bookings are counted by survival first, so what a task
    holds of a night is a row per distinct chance, however large its book.
    """
    counted = books.groupBy("stay_date", "property_key", "capacity", "survival").agg(F.count("*").alias("n"))
    nights = counted.groupBy("stay_date", "property_key", "capacity").agg(F.sort_array(F.collect_list(F.struct("survival", "n"))).alias("chances"))
    names = ["stay_date", "property_key", "extra", "book", "capacity", "expected_arrivals", "p_walk", "expected_walks", "expected_empty", "breakeven_ratio"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for date, key, room, chances in zip(*(batch.column(c).to_pylist() for c in ("stay_date", "property_key", "capacity", "chances")), strict=True):
                p, n_p = [c["survival"] for c in chances], [c["n"] for c in chances]
                total = sum(n_p)
                pmf, mean, before = arrivals(p, n_p), sum(x * n for x, n in zip(p, n_p, strict=True)) / total, None
                for k in range(most + 1):
                    n = np.arange(len(pmf))
                    walks, empty = float(pmf @ np.maximum(n - room, 0)), float(pmf @ np.maximum(room - n, 0))
                    more = walks - before[0] if before else 0.0
                    rows.append((date, key, k, total, room, float(pmf @ n), float(pmf[room + 1 :].sum()), walks, empty, round((before[1] - empty) / more, 6) if more > 1e-12 else None))
                    before = walks, empty
                    pmf = np.convolve(pmf, [1 - mean, mean])
            kinds = [pa.date32(), *[pa.int32()] * 4, *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = "stay_date date, property_key int, extra int, book int, capacity int, expected_arrivals double, p_walk double, expected_walks double, expected_empty double, breakeven_ratio double"
    return nights.mapInArrow(run, schema)


def overbook_sensitivity(outcomes: DataFrame, ratios: tuple[float, ...] = (1, 2, 5, 10, 20, 50)) -> DataFrame:
    """For each supplied cost of a walk in empty nights: the cheapest number of extra bookings, and whether it is the last one tried."""
    r = outcomes.sparkSession.createDataFrame([(float(x),) for x in ratios], "cost_ratio double")
    cost = F.round(F.col("expected_walks") * F.col("cost_ratio") + F.col("expected_empty"), 9)
    best = outcomes.crossJoin(F.broadcast(r)).groupBy("stay_date", "property_key", "cost_ratio").agg(F.min(F.struct(cost.alias("cost"), "extra")).alias("b"), F.max("extra").alias("last"))
    return best.select("stay_date", "property_key", "cost_ratio", F.col("b.extra").alias("extra"), (F.col("b.extra") == F.col("last")).alias("at_boundary"))


def apply_levers(positions: DataFrame, levers: DataFrame) -> DataFrame:
    """Every position under every lever, in whole basis points and paise.

    ``positions`` has available, sold, revenue_paise and commission_paise by any
    grain; ``levers`` has occupancy_bp, adr_bp and capacity_bp. Occupancy is held
    between 0 and 100 %; a change of capacity holds rooms sold, up to it.
    """
    p = positions.crossJoin(F.broadcast(levers.select("lever_id", F.col("occupancy_bp").alias("d_occ"), F.col("adr_bp").alias("d_adr"), F.col("capacity_bp").alias("d_cap"))))
    rooms = rounded_div(F.col("available") * (10000 + F.col("d_cap")), 10000)
    held = F.least(F.col("sold"), rooms)
    occ = F.greatest(F.lit(0), F.least(F.lit(10000), rounded_div(held * 10000, rooms) + F.col("d_occ")))
    sold = F.when(F.col("d_occ") == 0, held).otherwise(rounded_div(rooms * occ, 10000))
    adr = rounded_div(rounded_div(F.col("revenue_paise"), F.col("sold")) * (10000 + F.col("d_adr")), 10000)
    p = p.withColumn("new_available", rooms).withColumn("new_sold", sold).withColumn("new_adr_paise", adr).withColumn("new_revenue_paise", F.col("new_adr_paise") * F.col("new_sold"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  # the product of two sums of money is beyond a long
    p = p.withColumn("new_commission_paise", F.call_function("div", wide("new_revenue_paise") * wide("commission_paise"), F.greatest("revenue_paise", F.lit(1)).cast("decimal(19,0)")))
    old_adr = rounded_div(F.col("revenue_paise"), F.col("sold"))
    twice_rate, twice_volume = (F.col("new_adr_paise") - old_adr) * (F.col("sold") + F.col("new_sold")), (F.col("new_sold") - F.col("sold")) * (old_adr + F.col("new_adr_paise"))
    return p.withColumn("twice_rate_effect", twice_rate).withColumn("twice_volume_effect", twice_volume).drop("d_occ", "d_adr", "d_cap")


def sensitivity_levers(spark) -> DataFrame:
    """Steps of 2, 5 and 10 % (points for occupancy) down and up on each lever."""
    steps = [s * 100 for s in (-10, -5, -2, 2, 5, 10)]
    rows = [(f"{name}{s:+d}", *(s if i == j else 0 for j in range(3))) for i, name in enumerate(("occupancy", "adr", "capacity")) for s in steps]
    return spark.createDataFrame(rows, "lever_id string, occupancy_bp long, adr_bp long, capacity_bp long")


def shift_mix(economics: DataFrame, source: str, target: str, share_bp: int) -> DataFrame:
    """Nights moved from one channel to another at the target's net per night; ``economics`` has channel_code, nights and net_per_night_paise."""
    a = economics.where(F.col("channel_code") == source).select(F.col("nights").alias("n"), F.col("net_per_night_paise").alias("from_net"))
    b = economics.where(F.col("channel_code") == target).select(F.col("net_per_night_paise").alias("to_net"))
    moved = rounded_div(F.col("n") * share_bp, 10000)
    return a.crossJoin(b).select(F.lit(source).alias("source"), F.lit(target).alias("target"), moved.alias("nights_moved"), (moved * (F.col("to_net") - F.col("from_net"))).alias("net_gain_paise"))
