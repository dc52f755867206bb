"""Quantiles of any span from stored, mergeable sketches: no second look at the rows.

A day's values are kept as one KLL sketch per key, of a few kilobytes however many
rows it stands for. Sketches of days merge into those of a month or a year, so a
dashboard over a new span reads the sketches alone. The exact quantiles stay beside
them; ``rank_checked`` measures how far a sketch's quantile is from its rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: its rank error is below 0.5 percent with a probability of 99 percent.
SIZE = 800
#: The bound on rank errors that is asked for, some four times as wide.
MOST_ERROR = 0.02


def stored(rows: DataFrame, value: Column, by: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """(*by, n, sketch): one sketch of the whole-number ``value`` for each key; nulls do not count, keys of nulls only have no row."""
    v = value.cast("long")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(v, size).alias("sketch"))


def merged(sketches: DataFrame, by: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """(*by, n, sketch): sketches of a coarser key, from those of a finer one; merging combines map-side."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", size).alias("sketch"))


def quantile(p: float) -> Column:
    """The value at rank ``p`` of the column ``sketch``; 0 and 1 give the exact least and greatest value."""
    return F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p)))


def rank_checked(rows: DataFrame, value: Column, sketches: DataFrame, by: tuple[str, ...], percents: tuple[int, ...] = (25, 50, 75, 90), most: float = MOST_ERROR) -> DataFrame:
    """By key: how many values, the least and the greatest, and whether each quantile's exact rank is within ``most`` of the wanted one.

    The rank of a value that occurs often is a range; any point of it will do. Rows
    with a null in the key are left out.
    """
    q = sketches.select(*by, F.col("n").alias("sketched"), quantile(0).alias("least"), quantile(1).alias("greatest"), *[quantile(p / 100).alias(f"q{p}") for p in percents])
    r = rows.select(*by, value.cast("long").alias("__v")).where("__v is not null").join(q, list(by))
    counts = [x for p in percents for x in (F.count_if(F.col("__v") < F.col(f"q{p}")).alias(f"below{p}"), F.count_if(F.col("__v") <= F.col(f"q{p}")).alias(f"upto{p}"))]
    c = r.groupBy(*by).agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("sketched", "least", "greatest")], *counts)
    n = F.col("n")
    within = [((F.col(f"below{p}") <= n * (p / 100 + most)) & (F.col(f"upto{p}") >= n * (p / 100 - most))).alias(f"p{p}_within") for p in percents]
    return c.select(*by, "n", "sketched", "least", "greatest", *within)
