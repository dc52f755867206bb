"""Why a ratio moved between two windows: exact decompositions, from one conditional aggregate each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = tuple[dt.date, dt.date]


def preceding(cur: Span) -> Span:
    """The window of equal length before."""
    n = (cur[1] - cur[0]).days + 1
    return cur[0] - dt.timedelta(n), cur[0] - dt.timedelta(1)


def _eras(cur: Span, base: Span) -> tuple[Column, Column]:
    d = F.col("stay_date")
    return d.between(*cur), d.between(*base)


def _sum(cond: Column, c: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))


def window_totals(nights: DataFrame, cur: Span, base: Span) -> DataFrame:
    """Both windows: available, sold, revenue, out of order, occupancy, ADR and RevPAR."""
    now, before = _eras(cur, base)
    n = nights.where(now | before).withColumn("era", F.when(now, "current").otherwise("base"))
    t = n.groupBy("era").agg(F.count_if("is_sellable").alias("available"), F.count_if("is_occupied").alias("sold"), F.sum("revenue_paise").alias("revenue_paise"), F.count_if("is_out_of_order").alias("out_of_order"))
    return t.select("*", F.round(F.col("sold") / F.col("available"), 9).alias("occ"), F.round(F.col("revenue_paise") / F.nullif(F.col("sold"), F.lit(0)), 6).alias("adr"), F.round(F.col("revenue_paise") / F.col("available"), 6).alias("revpar"))


def explain_components(nights: DataFrame, cur: Span, base: Span) -> DataFrame:
    """RevPAR's change as a rate and an occupancy part (Shapley), which sum to it."""
    now, before = _eras(cur, base)
    s = nights.where(now | before).agg(*[x for w, e in (("1", now), ("0", before)) for x in (F.count_if(e & F.col("is_sellable")).alias(f"a{w}"), F.count_if(e & F.col("is_occupied")).alias(f"s{w}"), _sum(e, "revenue_paise").alias(f"r{w}"))])
    occ = {w: F.col(f"s{w}") / F.col(f"a{w}") for w in "01"}
    adr = {w: F.col(f"r{w}") / F.col(f"s{w}") for w in "01"}
    rate, volume = (adr["1"] - adr["0"]) * (occ["0"] + occ["1"]) / 2, (occ["1"] - occ["0"]) * (adr["0"] + adr["1"]) / 2
    change = F.col("r1") / F.col("a1") - F.col("r0") / F.col("a0")
    return s.select(F.round(change, 4).alias("change"), F.round(rate, 4).alias("rate_effect"), F.round(volume, 4).alias("occupancy_effect"), F.round(F.abs(change - rate - volume), 3).alias("residual"))


def attribute_revpar(nights: DataFrame, member: Column, cur: Span, base: Span) -> DataFrame:
    """RevPAR's change over a dimension that owns capacity: mix = change of weight x mean RevPAR, performance = mean weight x change of RevPAR."""
    now, before = _eras(cur, base)
    m = nights.where(now | before).groupBy(member.cast("string").alias("member")).agg(*[x for w, e in (("1", now), ("0", before)) for x in (F.count_if(e & F.col("is_sellable")).alias(f"a{w}"), _sum(e, "revenue_paise").alias(f"r{w}"))])
    all_ = F.broadcast(m.agg(F.sum("a0").alias("t0"), F.sum("a1").alias("t1")))
    m = m.crossJoin(all_)
    w = {x: F.col(f"a{x}") / F.col(f"t{x}") for x in "01"}
    p = {x: F.coalesce(F.col(f"r{x}") / F.nullif(F.col(f"a{x}"), F.lit(0)), F.lit(0.0)) for x in "01"}
    mix, perf = (w["1"] - w["0"]) * (p["0"] + p["1"]) / 2, (w["0"] + w["1"]) / 2 * (p["1"] - p["0"])
    m = m.select("member", F.round(p["0"], 4).alias("before"), F.round(p["1"], 4).alias("after"), mix.alias("mix"), perf.alias("perf"))
    total = F.broadcast(m.agg(F.sum(F.col("mix") + F.col("perf")).alias("total")))
    return m.crossJoin(total).select("member", "before", "after", F.round("mix", 4).alias("capacity_mix_effect"), F.round("perf", 4).alias("performance_effect"), F.round((F.col("mix") + F.col("perf")) / F.nullif(F.col("total"), F.lit(0.0)), 4).alias("share_of_movement"))


def attribute_revenue(nights: DataFrame, key: str, cur: Span, base: Span) -> DataFrame:
    """Revenue's and nights' change over a dimension without capacity."""
    now, before = _eras(cur, base)
    m = nights.where((now | before) & F.col("is_occupied")).groupBy(F.col(key).alias("member")).agg(_sum(now, "revenue_paise").alias("r1"), _sum(before, "revenue_paise").alias("r0"), F.count_if(now).alias("n1"), F.count_if(before).alias("n0"))
    return m.select("member", (F.col("r1") - F.col("r0")).alias("revenue_change_paise"), (F.col("n1") - F.col("n0")).alias("nights_change"))


def mix_vs_rate(nights: DataFrame, key: str, cur: Span, base: Span) -> DataFrame:
    """ADR's change as rate at old shares, mix at old rates and their interaction; a verdict where one is twice the other."""
    now, before = _eras(cur, base)
    m = nights.where((now | before) & F.col("is_occupied")).groupBy(key).agg(*[x for w, e in (("1", now), ("0", before)) for x in (F.count_if(e).alias(f"n{w}"), _sum(e, "revenue_paise").alias(f"r{w}"))])
    t = F.broadcast(m.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum("r0").alias("v0"), F.sum("r1").alias("v1")))
    m = m.crossJoin(t)
    s = {w: F.col(f"n{w}") / F.col(f"t{w}") for w in "01"}
    a = {w: F.coalesce(F.col(f"r{w}") / F.nullif(F.col(f"n{w}"), F.lit(0)), F.lit(0.0)) for w in "01"}
    out = m.agg(F.sum(s["0"] * (a["1"] - a["0"])).alias("rate"), F.sum((s["1"] - s["0"]) * a["0"]).alias("mix"), F.max(F.col("v1") / F.col("t1") - F.col("v0") / F.col("t0")).alias("change"))
    r, x = F.abs("rate"), F.abs("mix")
    return out.select(F.round("change", 3).alias("change"), F.round("rate", 3).alias("rate_effect"), F.round("mix", 3).alias("mix_effect"), F.round(F.col("change") - F.col("rate") - F.col("mix"), 3).alias("interaction"), F.when(r >= 2 * x, "rate").when(x >= 2 * r, "mix").otherwise("both").alias("verdict"))


def explain_revpar(nights: DataFrame, cur: Span, base: Span | None = None, noise: float = 0.01, least_share: float = 0.10, top: int = 8, capacity: float = 0.05) -> DataFrame:
    """One row of conclusions: the move against the noise floor, its drivers by property, concentration and confidence."""
    base = base or preceding(cur)
    parts = attribute_revpar(nights, F.col("property_key"), cur, base).withColumn("effect", F.col("capacity_mix_effect") + F.col("performance_effect"))
    totals = window_totals(nights, cur, base).groupBy().pivot("era", ["current", "base"]).agg(F.first("revpar").alias("revpar"), F.first("available").alias("available"))
    by_size = Window.orderBy(F.desc(F.abs("effect")), "member")  # a row per property
    p = parts.withColumn("rank", F.row_number().over(by_size)).agg(
        F.sum("effect").alias("net"), F.sum(F.abs("effect")).alias("gross"), F.array_join(F.sort_array(F.collect_list(F.when((F.abs("share_of_movement") >= least_share) & (F.col("rank") <= top), F.col("member")))), ",").alias("drivers"),
        F.max(F.when(F.col("effect") > 0, F.col("effect"))).alias("up"), F.min(F.when(F.col("effect") < 0, F.col("effect"))).alias("down"),
    )
    both = totals.crossJoin(p)
    move = F.col("current_revpar") / F.col("base_revpar") - 1
    lead = F.when(F.col("net") >= 0, F.col("up")).otherwise(-F.col("down"))
    concentration = F.coalesce(lead / F.nullif(F.col("gross"), F.lit(0.0)), F.lit(0.0))
    grown = F.abs(F.col("current_available") / F.col("base_available") - 1) >= capacity
    sure = F.when(concentration >= 0.5, "high").when(concentration >= 0.3, "medium").otherwise("low")
    return both.select(
        F.round(100 * move, 4).alias("move_pct"), (F.abs(move) >= noise).alias("material"), "drivers", F.round(concentration, 4).alias("concentration"), grown.alias("capacity_material"), F.when(grown & (sure == "high"), "medium").otherwise(sure).alias("confidence")
    )
