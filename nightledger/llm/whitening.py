"""Embedding whitening: leading components of a table of vectors by block Jacobi-Davidson.

The covariance is never formed. Its product with a few vectors is a pass over the
table: every task centres its rows and adds up ``c' (c v)``, and the tasks' sums
are added in a tree. The search space grows by corrections, solved for all wanted
pairs at once by a few MINRES steps on the projected operator, each step one such
pass. Rayleigh-Ritz gives the pairs; they are locked, largest first, when their
residual is down to double precision, and checked with a fresh product at the end.

Entries are counted in whole numbers, so a row's centred entries are exact but for
one rounding: the whole part of the mean is subtracted as an integer.

Defined results: vectors that are null, hold a null or a non-finite entry, or have
another length than most, are dropped; components of no variance are left out (one
vector alone, or equal ones, have none, and give no rows); repeated rows count as
often as they occur; a null vec_id is carried; entries count as at most 2^40 in
size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Residuals at most so large, as a part of the largest eigenvalue, are double precision.
TIGHT = 64 * np.finfo(float).eps
#: Components of less than this part of the largest eigenvalue have no variance.
NOTHING = 1e-12
_MOST = 1 << 40


def minres(operator: Callable, b: np.ndarray, steps: int, tight: float) -> np.ndarray:
    """Solutions of ``operator(x) = b`` for all columns at once; the operator is symmetric and may be indefinite."""
    first = np.linalg.norm(b, axis=0)
    some = lambda x: np.where(x > 0, x, 1.0)
    v, before = b / some(first), np.zeros_like(b)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    left, beta, c, s, d_bar, eps = first.copy(), np.zeros_like(first), -np.ones_like(first), np.zeros_like(first), np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        y = operator(v) - beta * before
        alpha = (v * y).sum(axis=0)
        y -= alpha * v
        beta = np.linalg.norm(y, axis=0)
        beta = np.where(beta > 1e-14 * np.abs(alpha), beta, 0.0)
        eps_old, delta, g_bar = eps, c * d_bar + s * alpha, s * d_bar - c * alpha
        eps, d_bar, gamma = s * beta, -c * beta, some(np.hypot(g_bar, beta))
        c, s = g_bar / gamma, beta / gamma
        w, w_old = (v - eps_old * w_old - delta * w) / gamma, w
        x += c * left * w
        left = s * left
        before, v = v, np.where(beta > 0, y / some(beta), 0.0)
        if (left <= tight * first).all():
            break
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``new`` outside the spaces ``against``; what is inside is left out."""
    out = np.zeros((len(new), 0))
    for i in range(new.shape[1]):
        t = new[:, i] / (np.linalg.norm(new[:, i]) or 1.0)
        size = 1.0
        for _ in range(3):
            for space in (*against, out):
                t = t - space @ (space.T @ t)
            now = np.linalg.norm(t)
            if now < 1e-10:
                break
            t, size = t / now, size * now
        if now >= 1e-10 and size > 1e-10:
            out = np.column_stack([out, t])
    return out


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, count: int, inner: int = 8, seed: int = 7, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``count`` largest, by falling value.

    ``product`` multiplies a positive semi-definite matrix of ``dim`` rows with the
    columns that it is given. Raises an error if a residual stays above double
    precision.
    """
    count, rng = min(count, dim), np.random.default_rng(seed)
    most = min(dim, max(4 * count, count + 24))
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = _orthonormal(rng.standard_normal((dim, min(dim, count + 4))))
    image, scale = product(space), 0.0
    for k in range(rounds):
        ritz, turn = np.linalg.eigh(_even(space.T @ image))
        space, image, ritz = space @ turn[:, ::-1], image @ turn[:, ::-1], ritz[::-1]
        scale = max(scale, ritz[0] if len(ritz) else 0.0, values[0] if len(values) else 0.0)
        residual = _outside(image - space * ritz, locked)
        small = np.linalg.norm(residual, axis=0) <= TIGHT * scale
        done = int(np.argmin(np.append(small, False)[: count - len(values) + 1])) if not small[: count - len(values)].all() else count - len(values)
        if done:
            locked, values = np.column_stack([locked, space[:, :done]]), np.append(values, ritz[:done])
            space, image, residual, ritz = space[:, done:], image[:, done:], residual[:, done:], ritz[done:]
        want = count - len(values)
        if want == 0:
            # a fresh product tells whether all hold together; else they are the next space
            fresh = product(locked)
            values, turn = np.linalg.eigh(_even(locked.T @ fresh))
            values, locked, fresh = values[::-1], locked @ turn[:, ::-1], fresh @ turn[:, ::-1]
            if (np.linalg.norm(fresh - locked * values, axis=0) <= TIGHT * scale).all():
                return values, locked
            space, image, locked, values = locked, fresh, np.zeros((dim, 0)), np.zeros(0)
            continue
        if space.shape[1] + want > most and space.shape[1] > want + 4:  # restart with the best
            space, image = space[:, : want + 4], image[:, : want + 4]
        near = np.column_stack([locked, space[:, :want]])

        def projected(v, theta=ritz[:want], near=near):
            v = _outside(v, near)
            return _outside(product(v) - v * theta, near)

        steps = minres(projected, _outside(-residual[:, :want], near), inner, 0.5 ** (k + 2))
        new = _orthonormal(np.column_stack([steps, residual[:, :want]]), locked, space)[:, :want]
        if not new.shape[1]:  # nothing new: an invariant space, of which a fresh image is taken
            new = _orthonormal(rng.standard_normal((dim, want)), locked, space)
            if not new.shape[1]:
                image = product(space)
                continue
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"residuals are above double precision after {rounds} rounds")


def _even(h: np.ndarray) -> np.ndarray:
    return (h + h.T) / 2


def _outside(v: np.ndarray, space: np.ndarray) -> np.ndarray:
    """``v`` without its part in an orthonormal ``space``."""
    return v - space @ (space.T @ v)


@dataclass
class Vectors:
    """The remaining vectors of a table in whole numbers, as saved blocks, with their number and exact sums."""

    blocks: DataFrame
    dim: int
    n: int
    sums: list[int]

    def passed(self, made: Callable[[np.ndarray], np.ndarray], slots: int = 64) -> np.ndarray:
        """The sum over all blocks of what ``made`` gives for their centred rows, added in the order of the tasks."""
        dim, base, rest = self.dim, *self.mean()

        def partial(batches):
            import pyarrow as pa

            total = None
            for batch in batches:
                for block in batch.column("x"):
                    one = made(centred(block.as_buffer(), dim, base, rest))
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

        def added(batches):
            import pyarrow as pa

            part, total = None, None
            for batch in batches:
                for p, x in zip(batch.column("part").to_pylist(), batch.column("sum").to_pylist(), strict=True):
                    one = np.frombuffer(x)
                    part, total = (p, one) if total is None else (part, total + one)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

        schema = "part int, sum binary"
        sums = self.blocks.select("x").mapInArrow(partial, schema)
        if self.blocks.rdd.getNumPartitions() > slots:
            sums = sums.repartitionByRange(slots, "part").sortWithinPartitions("part").mapInArrow(added, schema)
        return sum(np.frombuffer(r["sum"]) for r in sorted(sums.collect()))

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean's whole part and the rest."""
        base = [s // self.n for s in self.sums]
        return np.array(base, np.int64), np.array([(s - self.n * b) / self.n for s, b in zip(self.sums, base, strict=True)])

    def product(self, v: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``v``."""
        return self.passed(lambda c: (c.T @ (c @ v)).ravel()).reshape(v.shape) / self.n

    def trace(self) -> float:
        return float(self.passed(lambda c: np.array([np.square(c).sum()]))[0]) / self.n


def centred(block, dim: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (np.frombuffer(block, np.int64).reshape(-1, dim) - base).astype(float) - rest


def whole_vectors(table: DataFrame, column: str = "embedding", key: str = "vec_id", scale: int = 1024, shift: int = 100_000, rows: int = 1024) -> Vectors | None:
    """The rows of ``table`` with every entry c as floor(scale * c) + shift; None if no row remains."""
    entry = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(_MOST))), F.lit(float(-_MOST)))) + shift
    v = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    common = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return None
    dim = common["dim"]

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                some = batch.slice(lo, rows)
                x = some.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sums = x.reshape(-1, dim).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([some.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["ids", "x", "sums"])

    packed = v.where(F.size("v") == dim).select("id", F.transform("v", entry).alias("x")).mapInArrow(pack, "ids array<long>, x binary, sums array<long>")
    blocks = saved(packed)
    sums = blocks.select(F.posexplode("sums"), F.size("ids").alias("n")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()  # a row a dimension
    return Vectors(blocks.select("ids", "x"), dim, sums[0]["n"], [r["s"] for r in sums])


def whitened(table: DataFrame, components: int = 8, column: str = "embedding", key: str = "vec_id") -> DataFrame | None:
    """vec_id, n, deviation (decimal), whitened (array, a component an entry), explained (array), identity_error of every remaining row.

    deviation is the row's exact sum of (n x - S)^2; None if no vector or no
    component remains.
    """
    vectors = whole_vectors(table, column, key)
    if vectors is None:
        return None
    values, units = leading_pairs(vectors.product, vectors.dim, components)
    kept = values > NOTHING * max(values[0], 0.0)
    values, units = values[kept], units[:, kept]
    if not len(values):
        return None
    to = units / np.sqrt(values)
    mean = vectors.passed(lambda c: (c @ to).sum(axis=0)) / vectors.n

    def spread(c):
        w = c @ to - mean
        return (w.T @ w).ravel()

    covariance = vectors.passed(spread).reshape(len(values), -1) / vectors.n
    error = float(np.abs(covariance - np.eye(len(values))).max())
    dim, n, (base, rest) = vectors.dim, vectors.n, vectors.mean()
    over = np.array([s - n * int(b) for s, b in zip(vectors.sums, base, strict=True)], np.int64)
    squares = sum(int(r) ** 2 for r in over)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, block in zip(batch.column("ids").to_pylist(), batch.column("x"), strict=True):
                w = centred(block.as_buffer(), dim, base, rest) @ to
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dim) - base
                if np.abs(x).max() * float(max(n, np.abs(x).max())) * dim >= 2**62:
                    x = x.astype(object)
                own, with_over = (x * x).sum(axis=1).tolist(), (x * over).sum(axis=1).tolist()
                deviation = [Decimal(n * n * a - 2 * n * b + squares) for a, b in zip(own, with_over, strict=True)]
                arrays = [pa.array(ids, pa.int64()), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "deviation", "whitened"])

    out = vectors.blocks.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(x)) for x in values / vectors.trace()])
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
