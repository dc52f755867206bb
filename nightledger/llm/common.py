"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Spark's own xxhash64() uses this seed, so a hash made in SQL and one made in a task agree.
SEED = 42
U64 = np.uint64
#: No table is dealt into more ranges than this; at 100 TB a range has 3 GB, which a task sorts with spilling.
MOST_PARTS = 1 << 15
#: Tables of at most so many ids are broadcast; larger ones are joined by an exchange.
FEW = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the package goes to the executors along with it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where none is set, in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().contains("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by checkpoint() in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``ids`` (counted first: few are broadcast, so that no text is exchanged)."""
    ids = saved(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_anti")


def join_labels(rows: DataFrame, labels: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined on ``key`` to ``labels``, one row a key with ``n``, the rows it meets.

    Keys of more than one row in a thousand, of which there are fewer than a
    thousand, are broadcast; the rest are joined by an exchange, so no group
    meets in one task however large it is.
    """
    columns = [c for c in labels.columns if c not in (key, "n")]
    many = F.col("n") > max(500, total // 1000)
    marked = rows.join(F.broadcast(labels.where(many).withColumn("hot", F.lit(True)).drop("n")), key, "left")
    hot, rest = marked.where("hot"), marked.where("hot is null").drop(*columns, "hot").join(labels.where(~many).drop("n"), key)
    return hot.drop("hot").unionByName(rest)


def longs(values) -> Column:
    """A constant array of longs (one literal in the plan, whatever its length)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def part_of(a: Column, b: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of the sorted ``bounds`` at or below (a, b), by binary search in a constant array."""
    xs, ys = longs(x for x, _ in bounds), longs(y for _, y in bounds)

    def step(at, jump):
        x, y = F.get(xs, at + jump - 1), F.get(ys, at + jump - 1)
        return F.when((x < a) | ((x == a) & (y <= b)), at + jump).otherwise(at)

    jumps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), step) if bounds else F.lit(0)


def crc_text(doc_id: Column) -> Column:
    """Unsigned CRC-32 of an id written as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def raw_texts(batch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def giving_back(run):
    """``run`` over a task's batches, after which freed memory goes back to the system: workers outlive their tasks."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def release_memory() -> None:
    """Hands what Arrow and the C library keep for reuse back to the system, where it can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, as Spark's xxhash64() gives it, unsigned."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit keys evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
