"""Whitening: the bidiagonal solver and the table operator against numpy."""

import math

import numpy as np
import pytest

from ledgerline.llm import whitening
from ledgerline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def solve(r, k=None):
    d, above, w = whitening.bidiagonal(np.asarray(r, float))
    return whitening.directions(d, above, k or r.shape[1], w)


def agrees(r, orthogonal=1e-8):
    r = np.asarray(r, float)
    squares, vectors, total = solve(r)
    want = np.append(np.linalg.svd(r, compute_uv=False) ** 2, np.zeros(r.shape[1]))[:r.shape[1]]
    top = max(want[0], 1e-300)
    assert np.abs(squares - want).max() <= 1e-13 * top * len(want)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() <= orthogonal
    assert max(np.abs(r.T @ (r @ v) - s * v).max() for s, v in zip(squares, vectors)) <= 1e-11 * top
    assert total == pytest.approx(want.sum(), rel=1e-12)


@pytest.mark.parametrize("seed", range(5))
def test_random_triangles(seed):
    rnd = np.random.default_rng(seed)
    for d in (1, 2, 3, 8, 33):
        agrees(np.linalg.qr(rnd.normal(size=(rnd.integers(1, 3 * d + 1), d)), mode="r"))


def test_special_triangles():
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.normal(size=(20, 20)))[0]
    agrees(np.eye(6))
    agrees(np.diag([3.0, 3, 3, 1, 1, 0, 0]))
    agrees(np.zeros((4, 4)))
    agrees(np.outer(np.ones(5), np.arange(5.0)))
    agrees(np.diag([5.0] * 10 + [5 + 1e-9] * 5 + [1.0] * 5) @ turn)  # clusters
    agrees(np.diag(np.abs(np.arange(21) - 10.0) + 1e-3) + np.diag(np.ones(20), 1))  # pairs that almost agree
    agrees(np.diag(10.0 ** -np.arange(12.0)) @ rnd.normal(size=(12, 12)))


@pytest.mark.parametrize("seed", range(60))
def test_small_integer_matrices(seed):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(-2, 3, size=(rnd.integers(1, 12), rnd.integers(1, 12))).astype(float)
    agrees(np.linalg.qr(a, mode="r"), 1e-7)


def test_small_singular_values_keep_their_relative_accuracy():
    d, above = 10.0 ** -np.arange(10.0), 10.0 ** -np.arange(1.0, 10.0)
    b = np.diag(d) + np.diag(above, 1)
    from fractions import Fraction
    got = whitening.singular_squares(d, above)
    # the determinant is the product of the singular values, exactly known for a bidiagonal matrix
    want = math.prod(Fraction(float(x)) for x in d) ** 2
    assert math.prod(Fraction(float(x)) for x in got) == pytest.approx(float(want), rel=1e-12)
    assert got[0] == pytest.approx(np.linalg.svd(b, compute_uv=False)[0] ** 2, rel=1e-13)


def brute(vectors, k=4):
    """{vec_id: rows} by numpy, from [(vec_id, vector)]."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return kept, x, n, sums, values[::-1][:k], vecs[:, ::-1][:, :k], values.sum()


def check(rows, vectors):
    kept, x, n, sums, values, vecs, trace = brute(vectors)
    y = (x - sums / n) @ vecs / np.sqrt(values)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == 4 * len(kept)
    for c in range(4):
        mine = np.array([by[i, c + 1]["whitened"] for i, _ in kept])
        sign = np.sign(mine @ y[:, c])
        assert np.abs(mine - sign * y[:, c]).max() < 1e-9
        for j, (i, _) in enumerate(kept):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == int(((n * x[j] - sums) ** 2).sum())
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9) and r["identity_error"] < 1e-9


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(QUERIES["op12_whitening"](spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_dropped_rows_repeats_and_clashing_names(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(0, 3, 6).astype(np.float32).tolist(), 1, 2) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1, 2) for i in range(200)]  # copies count once in the fit
    rows += [(2000, None, 1, 2), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (2002, [math.inf] * 6, 1, 2),
             (2003, [math.nan] * 6, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, component int").repartition(7)
    out = whitening.whiten(df)
    check(out.collect(), [(r[0], r[1]) for r in rows])
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 1000")).count() == 0  # one distinct vector has no variance
    assert out.schema == whitening.whiten(df.limit(0)).schema


def test_many_factors_reduce_like_one(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    x = rnd.integers(-50, 50, size=(400, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(13)
    n, sums = len(x), x.sum(axis=0).tolist()
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several rounds
    r = whitening.blockwise_qr(df, n, sums)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)


def test_few_dimensions_and_short_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [0.5, -2.0]), (None, [0.25, 1.0]), (4, [0.5, -2.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 12 and {r["component"] for r in out} == {1, 2} and {r["n"] for r in out} == {5}
    assert max(r["identity_error"] for r in out) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0


def test_large_entries_stay_exact(spark):
    big = float(1 << 50)
    rows = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [0.0, 5.0]), (4, [1e300, 0.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in out} == {1, 2, 3} and {r["deviation"] for r in out if r["vec_id"] == 1} == {None}
    x = [[int(256 * c) for c in v] for _, v in rows[:3]]
    assert whitening.deviations(np.array([[3, 4]]), 2, [1, 2]) == [25 + 36]
    assert whitening.deviations(np.array(x), 3, [0, 1536])[2] == (3 * 1280 - 1536) ** 2
