"""Three streaming jobs: the folder feed, volumes for the silent-feed rule, and repeated submissions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import FEED, feed_flags


def ingest_feed(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """New .csv files of the daily feed, flagged, appended to Parquet exactly once; ends when it has caught up."""
    raw = spark.readStream.schema(FEED).option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
    return feed_flags(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_volume(requests: DataFrame, late: str = "2 days", offset: str = "18 hours 30 minutes") -> DataFrame:
    """Requests by channel and business day; days begin at 18:30 UTC and close once the watermark has passed."""
    r = requests.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    w = F.window("created_at", "1 day", "1 day", offset)
    return r.groupBy(w.alias("w"), "channel").agg(F.count("*").alias("n")).select(F.to_date(F.col("w.end")).alias("request_date"), "channel", "n")


def drop_repeats(bookings: DataFrame, keys: tuple[str, ...] = ("guest_key", "unit_key", "check_in_date"), within: str = "10 minutes") -> DataFrame:
    """Reservations without those submitted again for the same stay within the watermark; of repeats in one batch, any is kept."""
    b = bookings.withColumn("booked_at", F.col("booked_at").cast("timestamp")).withWatermark("booked_at", within)
    return b.dropDuplicatesWithinWatermark(list(keys))


def first_of_repeats(bookings: DataFrame, keys: tuple[str, ...] = ("guest_key", "unit_key", "check_in_date"), within: str = "10 minutes") -> DataFrame:
    """The earliest of reservations submitted again for the same stay, each no later than ``within`` after the one before, in whatever order they come.

    Late rows are those that drop_repeats drops. A reservation is given out when
    the watermark has passed the time in which a repeat of it can still come.
    """
    b = drop_repeats(bookings, (*keys, "booked_at"), within)  # late rows are dropped here: a session is late only once it has ended
    return b.groupBy(*keys, F.session_window("booked_at", within)).agg(F.min("booked_at").alias("booked_at")).select(*keys, "booked_at")


def caught_up(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a streaming frame over what there is, appends it to ``out`` and reads that."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a folder a batch, which is replaced as a whole, so a batch that runs again leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return write


def run_batches(df: DataFrame, out: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, list[dict]]:
    """Runs a streaming frame over what there is, batch by batch, and returns all rows written to ``out`` so far and the batches' progress.

    A later call with the same checkpoint goes on where the last one ended or broke off.
    """
    query = df.writeStream.foreachBatch(sink or batch_sink(out)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch int").parquet(out).drop("batch"), query.recentProgress


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, and a batch writes the changes to it, not its files."""
    provider, log = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    was = {key: spark.conf.get(key, None) for key in (provider, log)}
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(log, True)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
