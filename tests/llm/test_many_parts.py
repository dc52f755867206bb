"""Sharding and fingerprints dealt over thousands of ranges, and signatures against plain integers."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from nightledger.llm import fingerprint, sharding
from nightledger.llm.common import part_of

M = 2**64 - 1


def test_part_of_is_a_binary_search(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    bounds = sorted({(rnd.randrange(-50, 50), rnd.randrange(-5, 5)) for _ in range(200)})
    rows = [(rnd.randrange(-60, 60), rnd.randrange(-6, 6)) for _ in range(500)]
    for b in (bounds, bounds[:1], []):
        got = spark.createDataFrame(rows, "a long, b long").select("a", "b", part_of(F.col("a"), F.col("b"), b).alias("p")).collect()
        assert all(r["p"] == sum(x <= (r["a"], r["b"]) for x in b) for r in got)


@pytest.mark.parametrize("task_bytes, hot", [(250, 0), (400, 1500)])
def test_sharding_over_thousands_of_parts(spark, task_bytes, hot):
    rnd = random.Random(8)
    data = [(i, "one text of many" if i < hot else f"text {i} " * rnd.randrange(1, 20)) for i in range(3000)]
    began = time.time()
    df = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string"), task_bytes=task_bytes)
    got = df.collect()
    assert time.time() - began < 300
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(got) == 3000 and set(by) == set(range(16)) and max(sizes) < 1.1 * min(sizes)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())


@pytest.mark.parametrize("nulls", [0, 700])
def test_next_text_over_many_ranges(spark, nulls):
    data = [(None if i < nulls else 7 * i, f"text {i}") for i in range(2000)]
    got = fingerprint.with_next(spark.createDataFrame(data, "doc_id long, text string"), 500).collect()
    signed = lambda t: (lambda x: x - (1 << 64) * (x >> 63))(xxhash.xxh64_intdigest(t.encode(), 42))
    order = [t for _, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))]
    assert len(got) == 2000
    assert {r["text"]: r["next_text"] for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def brute_signature(text, k, depth, multipliers):
    """All k-mers numbered by occurrence, sorted whole for every entry."""
    kmers = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()] or [0]
    n, seen, numbered = max(1, len(kmers) - k + 1), defaultdict(int), []
    for i in range(n):
        joined = kmers[i]
        for x in kmers[i + 1 : i + k]:
            joined = mixed((joined * 3 + x) & M)
        numbered.append(mixed(joined ^ (seen[joined] * 0x9E3779B97F4A7C15 & M)))
        seen[joined] += 1
    out = []
    for m in multipliers:
        picked = sorted(sorted(range(n), key=lambda i: (numbered[i] * m & M, i))[:depth])
        entry = min(depth, n)
        for i in picked:
            entry = mixed((entry * 5 + numbered[i] * m) & M)
        out.append(entry >> 32)
    return out


def test_signatures_match_plain_integers():
    m = np.random.default_rng(1).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 10, 300, 5000):
        for words in (4, 10**6):
            text = " ".join(f"w{rnd.randrange(words)}" for _ in range(n))
            for k, depth in ((2, 2), (3, 4)):
                assert fingerprint.order_minhash(text.encode().split(), k, depth, m).tolist() == brute_signature(text, k, depth, m.tolist())


def test_few_edges_cost_few_tasks_in_many_parts(spark):
    """Rounds over a small graph: only the exchanges have a task for every part, not what reads and writes its edges."""
    from nightledger.llm.components import components

    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (50, 40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    sc, status = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few edges", "components")
        got = {r["node"]: r["component"] for r in components(frame).collect()}
        stages = {s for j in status.getJobIdsForGroup("few edges") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 30)} | {50: 40}
    assert tasks < 4000, tasks
