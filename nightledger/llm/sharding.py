"""Sharding by histogram sort: splitters by exact counts, then one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together. The
splitters between parts are found without sorting: every round broadcasts a
bounded set of candidate boundaries, each partition counts its bytes below them,
the sums come back, and each splitter's interval shrinks to the candidates
around its target, until the count below one of them is within the tolerance.
A group of copies larger than the tolerance is split inside, by doc_id; smaller
groups stay whole. Then rows are exchanged once.

Defined results: a null text has size 1 and no checksum bytes (CRC 0); a null
doc_id sorts as the least; repeated rows get a slot each; an empty table gives no
rows. Columns named like the results are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_PARTS, longs, part_of, saved

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
    )


def _below(keys: DataFrame, probes: list[tuple[int, int]]) -> np.ndarray:
    """Bytes of the rows below each of the sorted probes (h, d), counted in every partition and summed."""
    hs, ds = np.array([p[0] for p in probes]), np.array([p[1] for p in probes])

    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(hs) + 1, np.int64)
        distinct, first = np.unique(hs, return_index=True)
        last = np.append(first[1:], len(hs))
        for batch in batches:
            h, d, size = (batch.column(c).to_numpy() for c in ("h", "d", "size"))
            at = np.searchsorted(hs, h, side="left")  # number of probes whose h is less
            run_of = np.searchsorted(distinct, h)
            tied = np.flatnonzero(distinct[np.minimum(run_of, len(distinct) - 1)] == h)
            for g in np.unique(run_of[tied]):  # rows whose hash is a probe's: by doc_id
                rows = tied[run_of[tied] == g]
                at[rows] = first[g] + np.searchsorted(ds[first[g] : last[g]], d[rows], side="right")
            np.add.at(total, at, size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "bytes"])

    counts = np.zeros(len(probes) + 1, np.int64)
    for row in keys.mapInArrow(run, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect():
        counts[row["at"]] = row["bytes"]
    return np.cumsum(counts)[:-1]


def splitters(keys: DataFrame, targets: list[tuple[float, float]], total: int, most: int = 1 << 18) -> list[tuple[int, int]]:
    """A boundary (h, d) for each of the ascending ``targets`` (bytes, slack): the rows below it hold so many bytes, within the slack.

    About ``most`` candidates at a time go to the workers, 64 for a splitter at
    most and 8 at least, and one count each comes back. The first rounds narrow h
    (whole groups of equal texts); a splitter whose interval is one hash goes on
    within it by d. A splitter also ends when its interval holds no further key.
    """
    probes = max(8, min(64, most // max(1, len(targets))))
    lo, hi = [(LOW, LOW)] * len(targets), [(HIGH, HIGH)] * len(targets)
    at_lo, at_hi = [0] * len(targets), [total] * len(targets)
    found: dict[int, tuple[int, int]] = {}
    while len(found) < len(targets):
        ask = {}
        for i, (target, _) in enumerate(targets):
            if i in found:
                continue
            (h0, d0), (h1, d1) = lo[i], hi[i]
            if h1 - h0 > 1:
                share = (target - at_lo[i]) / max(1, at_hi[i] - at_lo[i])
                guess, width, step = h0 + int((h1 - h0) * share), h1 - h0, (h1 - h0) // probes + 1
                near = [guess + int(width * (k - probes // 4) / probes**2) for k in range(probes // 2)]  # fine around the guess
                ask[i] = sorted({(h, LOW) for h in [*range(h0 + step, h1, 2 * step), *near, h0 + 1] if h0 < h < h1})
            else:
                a, b = (d0, HIGH) if h1 > h0 else (d0, d1)
                if b - a <= 1:
                    found[i] = lo[i] if target - at_lo[i] <= at_hi[i] - target else hi[i]
                    continue
                step = (b - a) // probes + 1
                ask[i] = [(h0, d) for d in range(a + step, b, step)] or [(h0, a + 1)]
                middle = a + int((b - a) * (target - at_lo[i]) / max(1, at_hi[i] - at_lo[i]))
                ask[i] = sorted({*ask[i], *((h0, d) for d in range(max(a + 1, middle - 8), min(b, middle + 8)))})
        if not ask:
            break
        points = sorted({p for x in ask.values() for p in x})
        below = dict(zip(points, _below(keys, points).tolist(), strict=True))
        for i, own in ask.items():
            target, slack = targets[i]
            best = min(own, key=lambda p: (abs(below[p] - target), p))
            if abs(below[best] - target) <= slack:
                found[i] = best
                continue
            for p in own:
                if below[p] <= target:
                    lo[i], at_lo[i] = max(lo[i], p), max(at_lo[i], below[p])
                elif p < hi[i]:
                    hi[i], at_hi[i] = p, below[p]
            if at_lo[i] == at_hi[i]:
                found[i] = lo[i]
    return [found[i] for i in range(len(targets))]


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, task_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with size, shard and slot: shards of near-equal bytes, rows of a shard numbered without gaps.

    The law is "bytes": the size of a shard differs from total / shards by at most
    ``tolerance`` of it and one row. Every shard is made of equal fine parts of
    about ``task_bytes``, found by the same splitters (within a tenth of a part),
    so that sorting and numbering a shard is the work of many tasks. A row finds
    its part by binary search in a constant array of the boundaries.
    """
    keys = saved(_keys(docs))
    total = keys.agg(F.sum("size")).first()[0] or 0
    fine = max(1, min(MOST_PARTS // shards, math.ceil(total / shards / task_bytes)))
    parts = shards * fine
    targets = [(total * i / parts, tolerance * total / shards if i % fine == 0 else 0.1 * total / parts) for i in range(1, parts)]
    bounds = sorted(splitters(keys, targets, total)) if total else []
    counts = keys.groupBy(part_of(F.col("h"), F.col("d"), bounds).alias("part")).agg(F.count("*").alias("n")).collect()
    rows = {r["part"]: r["n"] for r in counts}
    offsets, at = [], 0
    for part in range(parts):
        at = 0 if part % fine == 0 else at
        offsets.append(at)
        at += rows.get(part, 0)
    h, d = F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    out = docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).withColumn("shard", part_of(h, d, bounds))
    out = out.repartitionById(parts, F.col("shard"))  # the one exchange; the window needs no other
    in_part = Window.partitionBy("shard").orderBy(h, d)
    out = out.withColumn("slot", F.row_number().over(in_part).cast("long") - 1 + F.get(longs(offsets), F.col("shard")))
    return out.withColumn("shard", F.expr(f"cast(shard div {fine} as int)"))
