"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers x = floor(SCALE * c) + OFFSET, so their number n and sums S are exact. Blockwise QR: every task
folds its centred rows x - S/n, block by block, into one triangular factor, and factors meet in a tree of FAN_IN at a time until
one is left; its size is fixed by the dimension. Householder reflections reduce that R to an upper bidiagonal B, dqds finds the
squares of B's singular values (n times the eigenvalues of the covariance) from positive numbers alone, and a twisted
factorisation of B^T B - s I recovers each vector where its largest entry lies; the reflections carry it back to the
directions of the rows. Vectors of values that lie close together are made orthogonal to one another, by inverse iteration where
one factorisation can't tell them apart. The covariance itself is never formed.

Rows with a null vector, with null or non-finite entries, or with another dimension than most vectors have (ties: the larger) are
left out. Repeated rows, also of one vec_id, count as often as they occur; a null vec_id is carried. Directions without variance
(the rank of the centred rows is lower than `most`) have no whitened values and are not returned; so a table of equal vectors, or
an empty one, gives an empty result. deviation is null where it exceeds a long. Entries up to 2**43 are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Factors that one task of the tree merges.
FAN_IN = 32
EPS = np.finfo(float).eps
#: Values closer than this, relative to the larger, form a cluster.
CLOSE = 1e-3


# --- from bidiagonal matrices to directions: d x d, whatever the number of rows ---


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = U B v^T with B upper bidiagonal, diagonal a, superdiagonal b, by Householder reflections."""
    r, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def reflection(x: np.ndarray) -> np.ndarray:
        w, size = x.copy(), np.linalg.norm(x)
        w[0] += size if w[0] >= 0 else -size
        norm = np.linalg.norm(w)
        return w / norm if norm else w

    for k in range(d):
        w = reflection(r[k:, k])
        r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k < d - 2:
            w = reflection(r[k, k + 1 :])
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step with a shift; None if the shift exceeds the least value."""
    out_q, out_e, d = np.empty_like(q), np.empty_like(e), q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        ratio = q[i + 1] / out_q[i] if out_q[i] else math.inf
        if not math.isfinite(ratio):
            return None
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    out_q[-1] = d
    return out_q, out_e


def dqds(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    found, parts = [], [(np.square(a.astype(float)), np.square(b.astype(float)), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while True:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            # an off-diagonal is negligible if it can't change a value in its last digits
            split = np.flatnonzero(e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:])))
            if not len(split):
                split = np.flatnonzero(e <= EPS * EPS * np.maximum(moved, np.finfo(float).tiny))
            if len(split):
                k = int(split[-1])
                parts.append((q[: k + 1], e[:k], moved))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # the least value is found at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            # the lower right 2 x 2 of B B^T bounds the least value from above
            x, y, z = q[-2] + e[-1], q[-1], math.sqrt(q[-1] * e[-1])
            shift = (x + y) / 2 - math.hypot((x - y) / 2, z)
            shift = max(0.0, min(shift, q[-1])) * (1 - 4 * EPS)
            step = _dqds_step(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > EPS * moved and shift > 1e-3 * q[-1] else 0.0
                step = _dqds_step(q, e, shift)
                if step is None and not shift:  # a zero within q
                    q = np.maximum(q, np.finfo(float).tiny)
            (q, e), moved = step, moved + shift
    return sorted((max(0.0, float(x)) for x in found), reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, gamma) of the twisted factorisations of B^T B - s I, by differential qd forms both ways."""
    n, tiny = len(a), EPS * EPS * (s + np.finfo(float).tiny)
    least = max(np.abs(a).max(), np.finfo(float).tiny) * EPS * EPS
    a = np.where(np.abs(a) < least, least, a)
    d, l = np.square(a), b / a[:-1]  # noqa: E741  B^T B = L diag(d) L^T
    off = a[:-1] * b
    lower, upper, left, right = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    left[0] = -s
    for i in range(n - 1):
        pivot = left[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        lower[i] = off[i] / pivot
        left[i + 1] = lower[i] * l[i] * left[i] - s
    right[-1] = d[-1] - s
    for i in range(n - 2, -1, -1):
        pivot = off[i] * l[i] + right[i + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        upper[i] = off[i] / pivot
        right[i] = d[i] * right[i + 1] / pivot - s
    return lower, upper, left + right + s


def _vector(a: np.ndarray, b: np.ndarray, s: float) -> np.ndarray:
    """The unit eigenvector of B^T B to the value s, built from the twist at which the factorisation is nearest to singular."""
    n = len(a)
    z = np.zeros(n)
    if n == 1:
        return np.ones(1)
    lower, upper, gamma = _twisted(a, b, s)
    k = int(np.argmin(np.abs(gamma)))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _iterated(a: np.ndarray, b: np.ndarray, s: float, others: np.ndarray) -> np.ndarray:
    """A unit eigenvector to s that is orthogonal to others, by inverse iteration with the factorisation L D L^T."""
    n = len(a)
    diagonal = np.square(a) + np.r_[0.0, np.square(b)]
    off = a[:-1] * b
    shifted = np.diag(diagonal - s * (1 + 4 * EPS)) + np.diag(off, 1) + np.diag(off, -1)
    shifted += EPS * max(s, np.finfo(float).tiny) * np.eye(n)
    x = np.random.default_rng(n).standard_normal(n)
    for _ in range(4):
        for _ in range(2):
            x = x - others @ (others.T @ x)
        x = np.linalg.solve(shifted, x / np.linalg.norm(x))
    for _ in range(2):
        x = x - others @ (others.T @ x)
    return x / np.linalg.norm(x)


def directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the `most` greatest squared singular values of r that aren't zero, falling, and their right
    singular vectors in columns, each with its largest entry positive."""
    d = r.shape[1]
    a, b, v = bidiagonalise(r)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    b = np.where(np.abs(b) <= EPS * EPS * scale, 0.0, b)
    cuts = [0, *(np.flatnonzero(b == 0) + 1).tolist(), d]
    pairs = sorted(((s, i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for s in dqds(a[i:j], b[i : j - 1])), reverse=True)
    pairs = [p for p in pairs[:most] if p[0] > (d * EPS) ** 2 * pairs[0][0]]
    vectors = np.zeros((d, len(pairs)))
    for k, (s, i, j) in enumerate(pairs):
        near = [m for m in range(k) if pairs[m][1] == i and pairs[m][0] - s <= CLOSE * pairs[m][0]]
        z, others = _vector(a[i:j], b[i : j - 1], s), vectors[i:j, near]
        for _ in range(2):
            z = z - others @ (others.T @ z)
        z = z / np.linalg.norm(z) if np.linalg.norm(z) > 0.1 else _iterated(a[i:j], b[i : j - 1], s, others)
        vectors[i:j, k] = z
    vectors = v @ vectors
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(pairs))])
    return np.array([p[0] for p in pairs]), vectors * signs


# --- over all rows ---


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """x of a column of vectors without nulls, n x d."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) * SCALE).astype(np.int64) + OFFSET


def usable(df: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of rows whose vector has neither nulls nor non-finite entries."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = F.coalesce(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))), F.lit(False))
    return df.select("vec_id", entries.alias("vector")).where(fine & (F.size("vector") > 0))


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of x by dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("vector"), d)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(np.r_[n, total])], names=["i", "total"])

    found = dict(rows.select("vector").mapInArrow(run, "i int, total long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(d)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n in doubles, from whole numbers."""
    whole = np.array([s // n for s in total])
    part = np.array([(s % n) / n for s in total])
    return (x - whole) - part


def triangular(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the centred rows: folded block by block in each task, merged in a tree."""
    d = len(total)

    def fold(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = fold(centred(_matrix(b.column("vector"), d), n, total) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merge(table: pa.Table) -> pa.Table:
        r = fold(np.frombuffer(x, dtype=np.float64).reshape(d, d) for x in table.column("r").to_pylist())
        return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = rows.select("vector").mapInArrow(leaf, "r binary")
    level = written(level.withColumn("node", F.expr(f"spark_partition_id() DIV {FAN_IN}").cast("long")).select("node", "r"), "factors")
    most = level.agg(F.max("node")).first()[0]
    while most is not None:
        level = level.groupBy("node").applyInArrow(merge, "node long, r binary")
        if not most:
            break
        most //= FAN_IN
    found = level.select("r").collect()  # one factor, or none
    return np.frombuffer(found[0][0], dtype=np.float64).reshape(d, d) if found else np.zeros((d, d))


def whiten(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component."""
    spark, rows = df.sparkSession, usable(df, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    rows = rows.where(F.size("vector") == d)
    n, total = sums(rows, d)
    r = triangular(rows, n, total)
    values, vectors = directions(r, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = values / np.square(r).sum()
    scaled = vectors / np.sqrt(values / n)
    #: beyond this a square sum may not fit, so it is taken in whole numbers of any size
    safe = math.isqrt(((1 << 63) - 1) // d)

    def deviations(x: np.ndarray) -> pa.Array:
        if np.abs(x).max(initial=0) <= (1 << 62) // n and max(map(abs, total)) < 1 << 62:
            y = n * x - np.array(total)
            if np.abs(y).max(initial=0) <= safe:
                return pa.array(np.square(y).sum(axis=1))
        each = (sum((n * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x)
        return pa.array([v if v < 1 << 63 else None for v in each], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), d)
            w = centred(x, n, total) @ scaled
            flat = pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviations(x), flat], names=["vec_id", "deviation", "w"])

    projected = written(rows.mapInArrow(project, f"vec_id {df.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>"), "whitened")
    k = len(values)
    at = [F.col("w")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = projected.agg(*[F.avg(x) for x in at]).first()
    moment = projected.agg(*[F.avg((at[i] - F.lit(means[i])) * (at[j] - F.lit(means[j]))) for i, j in pairs]).first()
    error = max(abs(m - (i == j)) for m, (i, j) in zip(moment, pairs, strict=True))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in explained]), F.col("component"))
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return each.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
