"""The lodging model's tables, derived from the given order, event and document tables.

Every expression has one exact meaning in integers, so that other engines can
compute the same rows. Money is whole paise.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import business_date
from ..functions.money import int_div
from ..session import ship

START, END = dt.date(1995, 1, 1), dt.date(2001, 7, 31)
#: Stay tax in percent by first day: at or below and above the threshold per night (paise).
TAX_RATES = ((dt.date(1990, 1, 1), 12, 18), (dt.date(1998, 9, 22), 5, 18))
TAX_THRESHOLD = 750_000
#: Channel types by order priority.
CHANNEL_TYPES = {"1-URGENT": "ota", "2-HIGH": "direct", "3-MEDIUM": "corporate", "4-NOT SPECIFIED": "walk_in", "5-LOW": "hourly"}
UNIT_TYPES = ("studio", "one_bed", "two_bed", "three_bed")
#: Holidays of every year (month, day, name).
HOLIDAYS = ((1, 26, "republic"), (5, 1, "labour"), (8, 15, "independence"), (10, 2, "gandhi"), (12, 25, "christmas"))


def _k(n: int) -> Column:
    return F.col("o_orderkey") * n


@dataclass
class Model:
    """The tables of one data folder, each read when it is asked for."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        ship(self.spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def units_per_property(self) -> int:
        """From the row count, which Parquet's footers hold."""
        return max(1, self.raw("orders").count() // 2500)

    def bookings(self) -> DataFrame:
        customer = self.raw("customer").select("c_custkey", "c_nationkey").join(F.broadcast(self.raw("nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        o = self.raw("orders").hint("merge").join(customer, F.col("o_custkey") == F.col("c_custkey"))  # a query of many branches would hold orders on the driver once a branch
        u = _k(7919) % 1000
        lead = int_div(u * u * u, 16666667).cast("int")
        booked = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(_k(104729) % 86400).cast("decimal(18,6)"))
        drift = F.col("o_orderdate").cast("date").between(dt.date(1998, 1, 12), dt.date(1998, 3, 15))
        nights = F.when(_k(31) % 13 == 0, 0).otherwise(1 + _k(17) % 6).cast("int")
        pending = F.col("o_orderstatus") == "P"
        status = F.when(pending & (F.col("o_orderkey") % 2 == 0), "cancelled").when(pending & (F.col("o_orderkey") % 22 == 1), "no_show").otherwise("checked_out")
        net = int_div(F.round(F.col("o_totalprice") * 100).cast("long"), 20)
        b = o.select(
            F.col("o_orderkey").alias("booking_key"), F.col("o_custkey").alias("guest_key"), (F.col("n_regionkey") + 1).cast("int").alias("property_key"),
            F.col("o_orderpriority").alias("channel_code"), booked.alias("booked_at"), F.when(drift, booked.cast("date")).otherwise(business_date(booked)).alias("booking_date"),
            lead.alias("lead_days"), nights.alias("nights"), (1 + F.col("o_orderkey") % 3).cast("int").alias("adults"), status.alias("status"), net.alias("net_paise"),
        )
        key = F.col("booking_key")
        return b.select(
            "*", (F.col("property_key") * 10000 + key % self.units_per_property()).cast("int").alias("unit_key"),
            F.expr("date_add(booking_date, lead_days)").alias("check_in_date"), F.expr("date_add(booking_date, lead_days + nights)").alias("check_out_date"),
            F.when(F.col("status") == "cancelled", F.expr("date_add(booking_date, cast((booking_key * 13) % (lead_days + 1) as int))")).alias("cancel_date"),
            F.when(F.col("nights") == 0, "microstay").otherwise("nightly").alias("stay_type"), int_div(F.col("net_paise") * 15, 100).alias("commission_paise"),
            F.when(key % 7 == 0, int_div(F.col("net_paise") * 5, 100)).otherwise(0).cast("long").alias("discount_paise"),
        )

    def units(self) -> DataFrame:
        n = self.units_per_property()
        u = self.spark.range(5 * n).select((F.expr(f"id div {n}") + 1).cast("int").alias("property_key"), (F.expr(f"(id div {n} + 1) * 10000 + id % {n}")).cast("int").alias("unit_key"))
        kind = F.col("unit_key") % 4
        return u.select("*", F.get(F.array(*map(F.lit, UNIT_TYPES)), kind).alias("unit_type"), (300_000 + 200_000 * kind).cast("long").alias("base_rate_paise"))

    def channels(self) -> DataFrame:
        return self.spark.createDataFrame(list(CHANNEL_TYPES.items()), "channel_code string, channel_type string")

    def tax_rates(self) -> DataFrame:
        rows = [(a, b[0] - dt.timedelta(1) if b else None, lo, hi) for (a, lo, hi), b in zip(TAX_RATES, [*TAX_RATES[1:], None], strict=True)]
        return self.spark.createDataFrame(rows, "effective_from date, effective_to date, rate_at_or_below int, rate_above int")

    def holidays(self) -> DataFrame:
        rows = [(dt.date(y, m, d), name) for y in range(1995, 2002) for m, d, name in HOLIDAYS]
        return self.spark.createDataFrame(rows, "holiday_date date, holiday_name string")

    def guests(self) -> DataFrame:
        c = F.col("c_custkey")
        x = F.when(c % 25 == 1, c - 1).otherwise(c)
        return self.raw("customer").select(
            c.alias("guest_key"), F.concat(F.lit("+91 9"), F.lpad(x.cast("string"), 9, "0")).alias("phone"), F.when(c % 16 != 0, F.concat(F.lit("Guest."), c.cast("string"), F.lit("@Mail.Example"))).alias("email"), F.col("c_mktsegment").alias("guest_segment")
        )

    def payments(self) -> DataFrame:
        b = self.bookings().where("status <> 'cancelled'")
        k, net = F.col("booking_key"), F.col("net_paise")
        gross = F.when(k % 41 == 0, int_div(net * 105, 100)).otherwise(net)
        p = b.select(
            k.alias("payment_key"), F.when(k % 113 != 0, k).alias("booking_key"), F.concat(F.lit("B"), k.cast("string")).alias("booking_id_raw"), F.col("booking_date").alias("payment_date"),
            F.when(k % 97 != 0, F.date_add("booking_date", 2)).alias("settlement_date"), gross.alias("gross_paise"),
        )
        fee = int_div(F.col("gross_paise") * 2, 100)
        p = p.withColumn("fee_paise", fee).withColumn("gst_on_fee_paise", int_div(F.col("fee_paise") * 18, 100))
        return p.withColumn("credited_paise", F.col("gross_paise") - F.col("fee_paise") - F.col("gst_on_fee_paise"))

    def requests(self) -> DataFrame:
        e, ident = self.raw("events"), F.col("event_id")
        kind = (ident % 10).cast("int")
        r = e.select(
            ident.alias("request_key"), F.col("ts").alias("created_at"), business_date(F.col("ts")).alias("request_date"), F.col("event_type").alias("channel"), (1 + F.col("user_id") % 5).cast("int").alias("property_key"),
            kind.alias("request_type"), F.concat(F.lit("team"), (kind % 3).cast("string")).alias("owning_team"), F.concat(F.lit("category"), int_div(kind, 2).cast("string")).alias("category"), (5 * (1 + kind)).alias("sla_minutes"),
            F.when(ident % 17 != 0, F.floor("value").cast("int")).alias("resolution_minutes"), F.when(ident % 3 == 0, 1 + ident % 5).cast("int").alias("csat"),
        )
        late = F.col("resolution_minutes") > F.col("sla_minutes")
        r = r.withColumn("is_sla_breached", F.when(F.col("request_key") % 101 == 0, ~late).otherwise(late))
        silent = (F.col("channel") == "signup") & F.col("request_date").between(dt.date(2024, 1, 12), dt.date(2024, 1, 20))
        return r.where(~silent)

    def reviews(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            d.alias("review_id"), (1 + d % 5).cast("int").alias("property_key"), F.date_add(F.lit(dt.date(2000, 1, 1)), (d % 365).cast("int")).alias("review_date"),
            (2 + (d * 7) % 9).cast("int").alias("half_stars"), F.col("text").alias("review_text"), F.col("lang").alias("language"),
        )

    def inventory(self) -> DataFrame:
        """Stock movements; the balance is off by one on every 211th order."""
        k = F.col("l_orderkey")
        i = self.raw("lineitem").select(
            k.alias("movement_key"), (1 + F.col("l_suppkey") % 5).cast("int").alias("property_key"), F.col("l_shipdate").cast("date").alias("movement_date"), (F.col("l_partkey") % 20).cast("int").alias("item_code"),
            (k % 50).cast("long").alias("opening"), F.col("l_quantity").cast("long").alias("received"), ((k * 7) % 60).cast("long").alias("consumed"), F.col("l_linenumber").cast("long").alias("wastage"),
        )
        off = (F.col("movement_key") % 211 == 0).cast("long")
        return i.withColumn("closing", F.col("opening") + F.col("received") - F.col("consumed") - F.col("wastage") + off)
