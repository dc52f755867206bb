"""Sources and sinks: typed tables, the daily feed, exports, key resolution and personal data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import bp, rounded_div

FEED = "stay_date date, property_code string, rooms_available int, rooms_sold int, rooms_out_of_order int, room_revenue_paise long, revpar_paise long"
#: What a column holds by its name, first match wins.
PERSONAL = (
    ("email", r"e?mail"), ("phone", r"phone|mobile"), ("name", r"(^|_)name$|first_name|last_name"), ("government_id", r"passport|aadhaar|gov.*id"), ("review_text", r"review_text|comment"),
    ("guest_key", r"guest_(key|id)"), ("booking_key", r"booking_(key|id)"), ("staff", r"staff|employee"),
)
DROPPED = ("email", "phone", "name", "government_id", "review_text")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A table under an explicit schema; CSV files have a header and bad values fail rather than turn null."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("mode", "FAILFAST").csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def feed_flags(df: DataFrame) -> DataFrame:
    """The daily feed cleaned and flagged; a defect is marked and never repaired."""
    code = F.upper(F.trim(F.regexp_replace("property_code", r"\p{Cntrl}", "")))
    f = df.withColumn("property_code", code).where(F.col("stay_date").isNotNull() | (F.col("property_code") != ""))
    recomputed = rounded_div(F.col("room_revenue_paise"), F.col("rooms_available"))
    return f.select(
        "*", (F.col("rooms_sold") <= F.col("rooms_available")).alias("is_valid_occupancy"), ((F.col("rooms_sold") == 0) & (F.col("room_revenue_paise") > 0)).alias("has_revenue_without_sales"),
        recomputed.alias("recomputed_revpar_paise"), recomputed.eqNullSafe(F.col("revpar_paise")).alias("revpar_matches"),
    )


def read_daily_feed(spark: SparkSession, folder: str) -> DataFrame:
    """All .csv files of a folder as one table with the file each row came from; other files are ignored."""
    raw = spark.read.schema(FEED).option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
    return feed_flags(raw.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))


def feed_checks(feed: DataFrame) -> DataFrame:
    """Rows, and rows that fail each check."""
    return feed.agg(F.count("*").alias("rows"), F.count_if(~F.col("is_valid_occupancy")).alias("oversold"), F.count_if("has_revenue_without_sales").alias("revenue_without_sales"), F.count_if(~F.col("revpar_matches")).alias("revpar_mismatches"))


def feed_rows(kpi: DataFrame, days: int) -> DataFrame:
    """The trailing days of the daily KPI in the feed's columns."""
    last = F.broadcast(kpi.agg(F.max("stay_date").alias("last")))
    k = kpi.crossJoin(last).where(F.col("stay_date") > F.date_sub("last", days))
    return k.select("stay_date", F.concat(F.lit("P"), F.col("property_key").cast("string")).alias("property_code"), F.col("available").cast("int").alias("rooms_available"), F.col("sold").cast("int").alias("rooms_sold"),
                    F.col("out_of_order").cast("int").alias("rooms_out_of_order"), F.col("revenue_paise").alias("room_revenue_paise"), "revpar_paise")


def export_daily_feed(kpi: DataFrame, out: str, days: int) -> None:
    """One CSV folder per stay date, all dates written in parallel."""
    f = feed_rows(kpi, days)
    f.withColumn("day", F.col("stay_date")).repartition("day").write.partitionBy("day").option("header", True).mode("overwrite").csv(out)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Holidays of a JSON document: date, name, scope, kind, confidence."""
    schema = "holidays array<struct<date:date,name:string,scope:string,kind:string,confidence:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("holidays").alias("h")).select("h.*")


def public_guests(guests: DataFrame) -> DataFrame:
    """Guests without contact data: only whether there is any."""
    return guests.select("guest_key", "guest_segment", F.col("phone").isNotNull().alias("has_phone"), F.col("email").isNotNull().alias("has_email"))


def export_model(tables: dict[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    """Every table below its own name; a table of guests is reduced to public columns first."""
    for name, df in tables.items():
        safe = public_guests(df) if name == "guest" else drop_personal(df)
        writer = safe.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{out}/{name}")


def budget_extract(kpi: DataFrame, service: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Monthly KPI and service summaries (ratios from sums), and their row count against a cap."""
    m = kpi.groupBy("property_key", F.trunc("stay_date", "month").alias("month")).agg(*[F.sum(c).alias(c) for c in ("available", "sold", "revenue_paise")])
    m = m.withColumn("occupancy_bp", bp(F.col("sold"), F.col("available"))).withColumn("adr_paise", rounded_div(F.col("revenue_paise"), F.col("sold")))
    s = service.groupBy("property_key", "category", "day_part").agg(F.count("*").alias("requests"), F.count_if("is_sla_breached").alias("breaches"))
    size = m.agg(F.count("*").alias("kpi_rows")).crossJoin(s.agg(F.count("*").alias("service_rows")))
    return m, s, size.withColumn("within_cap", F.col("kpi_rows") + F.col("service_rows") <= cap)


def resolve_keys(fact: DataFrame, dim: DataFrame, natural: str, key: str) -> DataFrame:
    """The fact with the dimension's key for a natural one; an unknown value keeps its row with a null key."""
    d = F.broadcast(dim.select(natural, key).dropDuplicates([natural]))  # dimensions are small by definition
    return fact.join(d, natural, "left")


def pending(reviews: DataFrame, done: DataFrame) -> DataFrame:
    """Reviews with text that have no result yet, the newest first."""
    return reviews.where(F.trim(F.coalesce("review_text", F.lit(""))) != "").join(done.select("review_id").distinct(), "review_id", "left_anti").orderBy(F.desc("review_date"), "review_id")


def classify_columns(schema: T.StructType) -> dict[str, str]:
    """What each column holds by its name; "other" if no rule matches."""
    return {f.name: next((kind for kind, p in PERSONAL if re.search(p, f.name, re.I)), "other") for f in schema.fields}


def drop_personal(df: DataFrame) -> DataFrame:
    kinds = classify_columns(df.schema)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if kinds[c] not in DROPPED])


def leaks(df: DataFrame, guests: DataFrame) -> DataFrame:
    """(column, value): e-mail addresses and phone numbers of guests that stand in any string column of an output."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, value string")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in text])).alias("x")).select("x.*")
    tokens = cells.select("column", F.explode(F.split(F.lower("text"), r"[\s,;<>()\"']+")).alias("value"))
    phones = cells.select("column", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"[\s-]", ""), F.lit(r"\d{10,}"), F.lit(0))).alias("value")).select("column", F.right("value", F.lit(10)).alias("value"))
    known = guests.select(F.lower("email").alias("value")).unionByName(guests.select(F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10)).alias("value"))).where("value is not null").distinct()
    return tokens.unionByName(phones).join(known, "value", "left_semi").select("column", "value").distinct()
