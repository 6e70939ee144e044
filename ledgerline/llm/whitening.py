"""Embedding whitening with a bidiagonal qd solver.

1. The distinct integer vectors (the fit list) are written once; exact sums give
   the means.
2. Tasks reduce their centred rows to one triangular factor each by blockwise QR;
   factors of ``FAN_IN`` tasks at a time are stacked and reduced again until one
   is left. Rows never meet in one place, only triangles of d x d do.
3. On the driver, Householder reflections make that triangle R bidiagonal, dqds
   finds its singular values to high relative accuracy, and a twisted
   factorisation of the shifted B'B gives each direction. Directions of a tight
   cluster of singular values are made orthogonal, and found by inverse
   iteration where that leaves too little.
4. Every row is projected; the covariance of the projections over the fit list
   is measured in a pass of its own.

The driver holds O(d^2) numbers: R, the directions and the means.

Defined results: rows whose vector is null, or holds a null, a non-finite entry
or one outside the range of a long after scaling, are dropped; a vector shorter
than the longest counts as 0 beyond its end; directions without variance
(numerically: a singular value under eps * max(n, d) * the largest) have no rows,
so one distinct vector, or none, gives no rows; ``deviation`` is null where it
exceeds a long; equal or null vec_ids each get their rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import group_arrow, map_arrow, stored

#: An entry c becomes floor(SCALE * c) (fixed by the contract).
SCALE = 256.0
COMPONENTS = 4
#: Factors that one task reduces, and rows that one QR step takes.
FAN_IN, STEP = 64, 4096
EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


class Fit(NamedTuple):
    """What whitening needs: sizes, exact sums, unit directions (rows) and their eigenvalues."""

    n: int
    sums: list  # exact, one a dimension
    directions: np.ndarray
    values: np.ndarray
    trace: float


# --- rows ---

def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose entries are all finite and fit a long."""
    scaled = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    good = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < float(1 << 62)))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(
        F.coalesce(good, F.lit(False)))
    rows = kept.select("vec_id", scaled.cast("array<long>").alias("x"))
    longest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if longest[0] == longest[1]:
        return rows
    padded = F.slice(F.concat("x", F.array_repeat(F.lit(0).cast("long"), longest[0] or 0)), 1, longest[0] or 1)
    return rows.withColumn("x", padded if longest[0] else F.col("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d) if d else np.empty((len(column), 0), np.int64)


def centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x - S/n, from the exact integer n*x - S where that fits."""
    if bound(x, n, sums) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / float(n)
    return x - np.array([s / n for s in sums])


def bound(x: np.ndarray, n: int, sums: list) -> int:
    largest = int(max(x.max(initial=0), -x.min(initial=0)))
    return n * largest + max((abs(s) for s in sums), default=0)


def deviations(x: np.ndarray, n: int, sums: list) -> list:
    """The exact sum over the dimensions of (n*x - S)^2, None beyond a long."""
    top = bound(x, n, sums)
    if top * top * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


# --- blockwise QR ---

def triangle(parts, d: int) -> np.ndarray:
    """The triangular factor of stacked rows, some at a time."""
    r = np.zeros((0, d))
    for part in parts:
        for at in range(0, len(part), STEP):
            r = np.linalg.qr(np.vstack([r, part[at:at + STEP]]), mode="r")
    return r


def blockwise_qr(fit: DataFrame, n: int, sums: list) -> np.ndarray:
    """R of all centred rows: a factor a task, then reduced ``FAN_IN`` at a time."""
    d = len(sums)

    def first(batches):
        r, task = np.zeros((0, d)), 0
        for b in batches:
            if len(b):
                task = b.column(0)[0].as_py()
                r = triangle([r, centred(matrix(b.column(1), d), n, sums)], d)
        if len(r):
            yield factor_rows(task, r)

    def reduce(table: pa.Table) -> pa.Table:
        # in the order of the factors, so that a second run gives the same numbers
        table = table.sort_by("task")
        r = triangle((np.frombuffer(b.as_py()).reshape(-1, d) for b in table["r"]), d)
        return pa.Table.from_batches([factor_rows(int(table["block"][0].as_py()), r)])

    schema = "task long, r binary"
    factors = stored(map_arrow(fit.select(F.spark_partition_id().cast("long"), "x"), first, schema), "whitening-r")
    while (top := factors.agg(F.max("task")).first()[0]) is not None and top > 0:
        blocks = factors.select(F.floor(F.col("task") / FAN_IN).cast("long").alias("block"), "task", "r")
        factors = stored(group_arrow(blocks, "block", reduce, schema), "whitening-r")
    last = factors.first()
    return np.frombuffer(last["r"]).reshape(-1, d) if last else np.zeros((0, d))


def factor_rows(task: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()],
                                                                             pa.binary())], names=["task", "r"])


# --- the bidiagonal solver ---

def reflector(x: np.ndarray):
    """(v, beta, alpha) with (I - beta v v') x = alpha e1."""
    norm = math.sqrt(float(x @ x))
    if norm == 0.0:
        return x, 0.0, 0.0
    alpha = -math.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonal(r: np.ndarray):
    """(diagonal, superdiagonal, W) of B with R = U B W', by Householder reflections."""
    d = r.shape[1]
    a = np.zeros((d, d))
    a[:len(r)] = r
    w = np.eye(d)
    for k in range(d):
        v, beta, alpha = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
            a[k:, k] = 0.0
            a[k, k] = alpha
        if k < d - 2:
            v, beta, alpha = reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
                a[k, k + 1:] = 0.0
                a[k, k + 1] = alpha
                w[:, k + 1:] -= beta * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def dqds_step(q: list, e: list, shift: float):
    """One differential qd step with a shift; None if the shift was too large."""
    d = q[0] - shift
    qs, es = [], []
    for i, ei in enumerate(e):
        if d < 0.0 or not math.isfinite(d):
            return None
        now = d + ei
        qs.append(now)
        if now == 0.0:  # d and e vanish: nothing is coupled beyond here
            es.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / now
            es.append(ei * t)
            d = d * t - shift
    if d < 0.0 or not math.isfinite(d):
        return None
    qs.append(d)
    return qs, es


def singular_squares(diagonal, above) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, largest first."""
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    out = []
    todo = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    while todo:
        q, e, moved = todo.pop()
        rounds = 0
        while q:
            if len(q) == 1:
                out.append(moved + q[0])
                break
            # a negligible coupling splits the matrix
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= EPS * EPS * (moved + q[i + 1]) or e[i] <= EPS * EPS * q[i] and moved == 0.0
                        or e[i] < TINY), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = lower_guess(q, e) if rounds else 0.0
            step = dqds_step(q, e, shift)
            while step is None and shift > 0.0:
                shift = shift / 4 if shift > EPS * EPS * (moved + q[-1]) else 0.0
                step = dqds_step(q, e, shift)
            if step is None:
                raise ArithmeticError("a qd step without shift gave a negative number")
            q, e = step
            moved += shift
            rounds += 1
            if rounds % 2 == 0 and q[0] < q[-1] / 2:  # graded the wrong way round: turn it
                q, e = turned(q, e)
            if rounds > 200 * (len(q) + 10):
                raise ArithmeticError("the qd iteration doesn't converge")
    return np.sort(np.array(out))[::-1] * scale * scale


def turned(q: list, e: list):
    """The qd array of the matrix read from its other end (the same singular values)."""
    size = len(q)
    return [q[size - 1 - i] for i in range(size)], [e[size - 2 - i] for i in range(size - 1)]


def lower_guess(q: list, e: list) -> float:
    """A shift a little under the smaller eigenvalue of the last two rows of B B'."""
    a, c, b2 = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1], e[-1]
    a, b2 = a + e[-1], q[-1] * e[-1]
    half = (a - c) / 2
    root = math.sqrt(half * half + b2)
    low = c - b2 / (half + root) if half + root > 0 else c - root
    return max(0.0, low * (1.0 - 4 * EPS) - math.sqrt(b2) * 1e-3 if low < c * 0.99 else low * 0.98)


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float):
    """(unit vector, correction): B'B - value I in twisted form, solved at its smallest pivot."""
    n = len(diagonal)
    d, b2, ab = diagonal * diagonal, above * above, diagonal[:-1] * above
    floor = max(EPS * EPS * max(value, float(d.max(initial=0.0))), TINY)
    solid = lambda x: x if abs(x) > floor else math.copysign(floor, x)
    s, down, p, up = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # from the top: stationary qd
        down[i] = solid(d[i] + s[i])
        s[i + 1] = b2[i] * s[i] / down[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):  # from the bottom: progressive qd
        up[i + 1] = solid(b2[i] + p[i + 1])
        p[i] = p[i + 1] * d[i] / up[i + 1] - value
    gamma = s + np.append(d[:-1] * p[1:] / up[1:], d[-1]) if n > 1 else s + d
    k = int(np.abs(gamma).argmin())
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -ab[i] / down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -ab[i] / up[i + 1] * z[i]
    size = float(z @ z)
    return z / math.sqrt(size), float(gamma[k]) / size


def blocks_of(diagonal: np.ndarray, above: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows between negligible superdiagonal entries."""
    top = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    cuts = [i + 1 for i, b in enumerate(above) if abs(b) <= EPS * EPS * top]
    return list(zip([0, *cuts], [*cuts, len(diagonal)]))


def directions(diagonal: np.ndarray, above: np.ndarray, count: int, w: np.ndarray):
    """(squares of the ``count`` largest singular values, their unit directions as rows, sum of all squares)."""
    found = []
    for lo, hi in blocks_of(diagonal, above):
        found += [(v, lo, hi) for v in singular_squares(diagonal[lo:hi], above[lo:hi - 1])]
    found.sort(key=lambda f: (-f[0], f[1]))
    out = []
    for value, lo, hi in found[:count]:
        z = np.zeros(len(diagonal))
        z[lo:hi], _ = twisted(diagonal[lo:hi], above[lo:hi - 1], value)
        near = [y for v, y in out if v - value <= 1e-3 * v]
        rest = z - sum((float(y @ z) * y for y in near), np.zeros(len(z)))
        if near and float(rest @ rest) < 0.25:
            rest = inverse_iteration(diagonal, above, value, near)
        out.append((value, rest / math.sqrt(float(rest @ rest))))
    vectors = np.array([w @ z for _, z in out]).reshape(len(out), len(diagonal))
    for v in vectors:  # a sign of its own: the largest entry is positive
        if v[np.abs(v).argmax()] < 0:
            v *= -1.0
    return np.array([v for v, _ in out]), vectors, math.fsum(v for v, _, _ in found)


def inverse_iteration(diagonal, above, value: float, near: list) -> np.ndarray:
    """A direction for ``value`` at right angles to those found in its cluster."""
    n = len(diagonal)
    b = np.diag(diagonal) + np.diag(above, 1)
    t = b.T @ b
    top = float(np.abs(t).max(initial=0.0)) or 1.0
    known = np.array(near)
    outside = lambda z: z - known.T @ (known @ z)
    best, least = None, math.inf
    # a start with a part in all directions; else the axes, least covered first
    axes = np.eye(n)[np.argsort((known ** 2).sum(axis=0), kind="stable")]
    for start in (np.cos(np.arange(1, n + 1) * 1.7), *axes):
        z = outside(outside(start / math.sqrt(float(start @ start))))
        for _ in range(4):
            size = float(z @ z)
            if not EPS * EPS < size < math.inf:
                break
            z = z / math.sqrt(size)
            error = float(np.abs(t @ z - value * z).max())
            if error < least:
                best, least = z, error
            try:
                moved = np.linalg.solve(t - (value + EPS * top) * np.eye(n), z)
            except np.linalg.LinAlgError:
                break
            size = math.sqrt(float(moved @ moved))
            if not 0.0 < size < math.inf:
                break
            z = outside(outside(moved / size))
        if least <= 64 * EPS * top:
            break
    return best


# --- over a table ---

def fit_rows(rows: DataFrame) -> DataFrame:
    """The distinct vectors of ``rows``."""
    return stored(rows.select("x").distinct(), "whitening-fit")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Learns from the distinct vectors; None without a direction of any variance."""
    n = distinct.count()
    if not n:
        return None
    sums = [int(r["s"]) for r in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()]  # a number a dimension
    if not sums:
        return None
    diagonal, above, w = bidiagonal(blockwise_qr(distinct, n, sums))
    squares, vectors, total = directions(diagonal, above, min(components, len(sums)), w)
    real = np.sqrt(squares) > EPS * max(n, len(sums)) * math.sqrt(max(squares.max(initial=0.0), TINY))
    if not real.any():
        return None
    return Fit(n, sums, vectors[real], squares[real] / n, total / n)


def projected(x: np.ndarray, model: Fit) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.directions.T / np.sqrt(model.values)


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """The largest entry of the projections' covariance minus the identity, over the fit list."""
    d, k = len(model.sums), len(model.values)

    def moments(batches):
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                y = projected(matrix(b.column(0), d), model)
                n, mean, square = merged((n, mean, square), (len(y), y.mean(axis=0),
                                                             (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([square.ravel().tolist()])],
                names=["n", "mean", "square"])

    parts = stored(map_arrow(distinct.select("x"), moments, "n long, mean array<double>, square array<double>"),
                   "whitening-moments")
    # sums over tasks of the centred moments: n m m' moves a task's square to the common mean
    at = F.expr("element_at(mean, i) - element_at(middle, i)"), F.expr("element_at(mean, j) - element_at(middle, j)")
    middle = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    common = [r["m"] for r in middle.orderBy("i").collect()]
    cells = parts.select("n", "mean", F.posexplode("square").alias("c", "s")).select(
        "c", "n", "s", "mean", F.array(*[F.lit(v) for v in common]).alias("middle"),
        (F.floor(F.col("c") / k) + 1).cast("int").alias("i"), (F.col("c") % k + 1).cast("int").alias("j"))
    total = cells.groupBy("c").agg(F.sum(F.col("s") + F.col("n") * at[0] * at[1]).alias("s")).orderBy("c").collect()
    cov = np.array([r["s"] for r in total]).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def merged(a, b):
    """Moments (n, mean, centred square) of two groups together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per kept vector and component, numbered from 1 by falling eigenvalue."""
    rows = integer_vectors(vectors)
    distinct = fit_rows(rows)
    model = fit(distinct, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(distinct, model)
    d, k = len(model.sums), len(model.values)
    explained = model.values / model.trace

    def values(batches):
        for b in batches:
            x = matrix(b.column(1), d)
            m = len(x)
            take = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(take)),
                pa.array(projected(x, model).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_arrow(rows.select(F.col("vec_id").cast("long"), "x"), values, SCHEMA)
