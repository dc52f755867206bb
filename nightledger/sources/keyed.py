"""Tables that are written more than once: keyed rows of which the last write wins, and an append-only history of runs.

Both are Parquet folders in a place that all executors share. A write replaces
whole partitions when its job commits, so that one which is repeated after a
failure leaves the same rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def last_writes(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The change of the highest ``seq`` of each key, by an aggregate that combines map-side; equal ones by their other columns."""
    rest = [c for c in changes.columns if c not in keys and c != seq]
    return changes.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r")).select(*[f"r.{c}" if c not in keys else c for c in changes.columns])


@dataclass(frozen=True)
class KeyedTable:
    """Rows by ``keys`` in ``buckets`` partitions; of several changes of a key the one with the highest ``seq`` holds.

    ``schema`` has the keys, the values and ``seq``; changes have a boolean
    ``deleted`` besides. Deleted keys stay as marks, so that an older change that
    comes later does not bring them back. Keys are not null.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    seq: str = "seq"
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _held(self) -> DataFrame:
        return self.spark.read.schema(self._stored()).parquet(self.path)

    def _stored(self) -> StructType:
        out = StructType(list(self.schema.fields))
        return out.add("deleted", "boolean").add("bucket", "integer")

    def merge(self, changes: DataFrame) -> list[int]:
        """Applies a batch of changes, in any order and any number a key; returns the buckets that were rewritten.

        Only buckets that hold a changed key are read and written. A batch that is
        merged again changes nothing.
        """
        new = last_writes(changes.select(*self.schema.names, "deleted"), list(self.keys), self.seq).withColumn("bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        if self._exists():
            new = new.unionByName(self._held().where(F.col("bucket").isin(touched)))
            new = last_writes(new, [*self.keys, "bucket"], self.seq)
        _replace_partitions(new.repartition("bucket"), self.path, "bucket")
        return touched

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        """The rows that hold."""
        return self._held().where("not deleted").select(*self.schema.names)


@dataclass(frozen=True)
class RunHistory:
    """Results of runs, appended under the day and the id of each run; a run that is repeated replaces its own rows."""

    spark: SparkSession
    path: str
    schema: StructType

    def append(self, results: DataFrame, run_id: str, run_at: dt.datetime) -> None:
        at = F.lit(run_at.isoformat(sep=" ")).cast("timestamp_ntz")
        named = results.select(*self.schema.names, at.alias("run_at"), F.lit(run_at.date()).alias("run_date"), F.lit(run_id).alias("run_id"))
        _replace_partitions(named.coalesce(1), self.path, "run_date", "run_id")  # a few rows a run

    def read(self, since: dt.date | None = None) -> DataFrame:
        """All results, or those of runs from a day on, of which alone the folders are listed."""
        schema = StructType(list(self.schema.fields)).add("run_at", "timestamp_ntz").add("run_date", "date").add("run_id", "string")
        out = self.spark.read.schema(schema).parquet(self.path)
        return out if since is None else out.where(F.col("run_date") >= F.lit(since))

    def latest(self, key: str = "rule_id", since: dt.date | None = None) -> DataFrame:
        """The last result of each key over all runs (a key that a run leaves out keeps its earlier one)."""
        rest = [c for c in self.schema.names if c != key]
        last = self.read(since).groupBy(key).agg(F.max(F.struct("run_at", "run_id", *rest)).alias("r"))
        return last.select(key, *[f"r.{c}" for c in (*rest, "run_at", "run_id")])
