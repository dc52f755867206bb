"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_labels, shared_folder

#: Edges that a task writes.
EDGES = 1 << 16


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """Each node's neighbours, the larger (or the smaller ones and itself) linked to the least of all of them.

    ``total`` is the number of edges about: nodes with a large part of them are joined by broadcast.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = join_labels(both, least, "a", total)
    if small:  # a is the larger end of each edge
        out = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return out.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node it reaches.

    Nodes are longs; self links and repeats are ignored. Every round is a
    partially aggregated minimum and a join, and its edges are written to the
    shared folder by a task for every ``EDGES`` of them and read again, in the
    place of the last round's: few edges cost few tasks and files, however many
    parts an exchange has. The driver sees a fingerprint of the edge set only.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def kept(e, place):
        e.write.mode("overwrite").parquet(f"{folder}/{place}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{place}")

    def mark(e):
        row = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        return row["n"], row["x"]

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "now")
    was, seen = None, mark(now)
    while seen[0] and was != seen:  # every round lowers a label, so this ends
        tasks = seen[0] // EDGES + 1
        large = kept(_star(now, False, 2 * seen[0]).coalesce(tasks), "large")
        now = kept(_star(large, True, seen[0]).coalesce(tasks), "now")
        was, seen = seen, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
