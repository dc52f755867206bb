"""Whitening against a dense eigensolver and exact whole numbers."""

import math

import numpy as np
import pytest

from nightledger.llm import queries, whitening
from nightledger.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, whitened string, n string"


def dense(vectors):
    """(n, x, mean, eigenvalues, eigenvectors) by numpy, in whole numbers as far as they go."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    base = [s // n for s in sums]
    c = np.array([[a - b for a, b in zip(r, base, strict=True)] for r in x], float) - np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
    values, units = np.linalg.eigh(c.T @ c / n)
    return n, x, sums, c, values[::-1], units[:, ::-1]


def rows_of(df, components=8):
    out = whitening.whitened(df, components)
    return [] if out is None else out.collect()


def check(got, vectors, components=8):
    n, x, sums, c, values, units = dense(vectors)
    k = len(got[0]["whitened"])
    assert k == min(components, sum(values > 1e-12 * values[0]))
    want = {tuple(map(int, r)): w for r, w in zip(x, c @ (units[:, :k] / np.sqrt(values[:k])), strict=True)}
    deviation = {tuple(map(int, r)): sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x}
    by_id = {i: tuple(r) for i, r in enumerate(x)}
    signs = None
    for r in got:
        key = by_id[r["vec_id"]]
        w = np.array(r["whitened"])
        if signs is None and (np.abs(want[key]) > 1e-3).all():
            signs = np.sign(w) * np.sign(want[key])
        assert r["n"] == n and int(r["deviation"]) == deviation[key]
        assert np.allclose(np.abs(w), np.abs(want[key]), atol=1e-9)
        assert signs is None or np.allclose(w * signs, want[key], atol=1e-9)
        assert np.allclose(r["explained"], values[:k] / values.sum(), rtol=1e-12)
        assert r["identity_error"] < 1e-11
    assert len(got) == n


@pytest.mark.parametrize(("n", "dim", "parts"), [(300, 20, 2), (90, 5, 70), (40, 60, 2), (200, 1, 1)])  # more tasks than slots; fewer rows than dimensions
def test_against_dense(spark, n, dim, parts):
    rng = np.random.default_rng(n)
    v = (rng.standard_normal((n, dim)) @ np.diag(np.linspace(2, 0.5, dim))).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(v)], SCHEMA).repartition(parts)
    check(rows_of(df), v)


def test_residuals_of_hard_spectra():
    """Clustered and equal eigenvalues, a steep fall, and few steps."""
    rng = np.random.default_rng(2)
    for values in (np.r_[np.ones(5) * 10, np.linspace(9.99, 1, 195)], 0.5 ** np.arange(120.0), np.r_[np.full(12, 3.0), np.full(60, 1.0)], np.linspace(1, 1.001, 400)):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        a = (q * values) @ q.T
        passes = []
        found, units = whitening.leading_pairs(lambda v, a=a, p=passes: p.append(v.shape[1]) or a @ v, len(values), 8)
        top = np.sort(values)[::-1][:8]
        assert np.allclose(found, top, rtol=1e-12)
        assert np.linalg.norm(a @ units - units * found, axis=0).max() <= 1e-13 * top[0]
        assert np.abs(units.T @ units - np.eye(8)).max() < 1e-13
        print(len(values), len(passes))


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    assert np.allclose(whitening.minres(lambda v: a @ v, b, 200, 1e-14), np.linalg.solve(a, b), atol=1e-8)


def test_awkward(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 4)).astype(np.float32).tolist()
    v[7] = v[8] = v[9]
    rows = [(i, x, "clash", "clash") for i, x in enumerate(v)]
    bad = [(100, None, "", ""), (101, [1.0, None, 0.0, 0.0], "", ""), (102, [1.0, float("nan"), 0.0, 0.0], "", ""), (103, [float("inf"), 0.0, 0.0, 0.0], "", ""), (104, [], "", ""), (105, [1.0, 2.0], "", "")]
    check(rows_of(spark.createDataFrame(rows + bad, SCHEMA)), v)
    one = spark.createDataFrame(rows[:1] * 5, SCHEMA)
    assert rows_of(one) == [] and rows_of(spark.createDataFrame(bad[:5], SCHEMA)) == [] and rows_of(one.where("false")) == []
    big = [[1e9, 1.0], [-1e9, 2.0], [3e37, -1.0]]
    got = rows_of(spark.createDataFrame([(None, x, "", "") for x in big], SCHEMA))
    assert len(got) == 3 and all(r["vec_id"] is None and r["deviation"] > 2**63 for r in got)


def test_query(spark, sf_dir):
    got = queries.queries()["op12_whitening"](spark, sf_dir).collect()
    v = {r["vec_id"]: r["embedding"] for r in table(spark, sf_dir, "embeddings").collect()}
    n, x, sums, c, values, units = dense(list(v.values()))
    place = {i: k for k, i in enumerate(v)}
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9))
    w = c @ (units[:, :8] / np.sqrt(values[:8]))
    found = np.zeros_like(w)
    for r in got:
        found[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-10 and math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-12)
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[place[r["vec_id"]]], sums, strict=True))
    assert np.allclose(found * np.sign((found * w).sum(axis=0)), w, atol=1e-9)
