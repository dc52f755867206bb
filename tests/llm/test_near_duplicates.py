"""Near duplicates of the pipeline against brute force, on both sides of a similarity of 0.8."""

import random

import pytest
from pyspark.sql import functions as F

from nightledger.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(5)))) if len(w) > 5 else {tuple(w)}


def brute(data):
    """{doc_id: smallest doc_id of its component} over all pairs of at least 0.8."""
    sets, root = [(d, shingles(t)) for d, t in data], {d: d for d, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if 5 * len(x & y) >= 4 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def components(spark, data, **options):
    got = simhash.similar_documents(spark.createDataFrame(data, "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


def fresh(rnd, n):
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def near(rnd, words, similarity):
    """A copy with other words at its end, at about this similarity."""
    n = round(len(words) * 2 * similarity / (1 + similarity))
    return words[:n] + fresh(rnd, len(words) - n)


def test_pairs_on_both_sides_of_the_threshold(spark):
    rnd, data = random.Random(5), []
    for i in range(200):
        words = fresh(rnd, rnd.randrange(60, 300))
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near(rnd, words, rnd.uniform(0.75, 0.85))))]
    want = brute(data)
    assert 40 < sum(d != c for d, c in want.items()) < 160
    assert components(spark, data) == want


@pytest.mark.parametrize("most", [2, 8])
def test_crowded_keys_lose_no_link(spark, most):
    """Many texts share a long passage; some are alike to each other and to no other of the crowd."""
    rnd, data, passage = random.Random(6), [], fresh(random.Random(7), 100)
    for _ in range(60):
        words = passage + fresh(rnd, rnd.randrange(20, 60))
        data.append(" ".join(words))
        if rnd.random() < 0.5:
            data.append(" ".join(near(rnd, words, rnd.uniform(0.78, 0.9))))
    chain = fresh(rnd, 120)
    for _ in range(30):  # each like the one before it, the ends unlike
        data.append(" ".join(chain))
        chain = chain[6:] + fresh(rnd, 6)
    rnd.shuffle(data)
    data = list(enumerate(data))
    want = brute(data)
    assert 10 < len(set(want.values())) < len(data) - 40
    assert components(spark, data, most=most) == want


def test_small_table(spark, sf_dir):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert components(spark, data) == brute(data)


def test_fingerprints_link_the_nearest_copies(spark, monkeypatch):
    """Copies within two bits need no candidate of the prefix filter; what is grouped and unlike is not linked."""
    rnd, data = random.Random(8), []
    for i in range(20):
        words = fresh(rnd, 2000)
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    prints = [simhash.majority(simhash.shingle_hashes(t.encode().split(), 5)) for _, t in data]
    close = {a: (prints[a] ^ prints[a + 1]) % 2**64 for a in range(0, 40, 2)}
    close = {a for a, x in close.items() if x.bit_count() <= 2}
    assert len(close) > 10
    monkeypatch.setattr(simhash, "_likely", lambda pairs, *_: pairs.where("false"))
    assert components(spark, data) == {d: d - d % 2 if d - d % 2 in close else d for d, _ in data}
    # however they are grouped, only what is alike is linked
    monkeypatch.setattr(simhash, "linked", lambda prints: prints.withColumn("component_id", F.lit(0).cast("long")))
    assert components(spark, data[:4]) == {0: 0, 1: 0, 2: 2, 3: 3}
