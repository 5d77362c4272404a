import math

import numpy as np
import pytest

from repolens.llm.queries import QUERIES
from repolens.llm.whitening import (
    deviations, fit, identity_error, jacobi, pivoted_cholesky, products, with_whitened)

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>"


def brute(vectors):
    """Whole numbers of the vectors, eigenvalues falling, unit eigenvectors as rows."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], axes.T[::-1]


def white(rows, n_components=8):
    """``{vec_id: [(deviation, whitened values)]}`` and the model."""
    model = fit(rows, n_components)
    out = {}
    for r in with_whitened(rows, model).collect():
        out.setdefault(r["vec_id"], []).append((r["deviation"], r["whitened"]))
    return model, out


def test_equals_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    model, found = white(rows)
    x, values, axes = brute(vectors)
    assert np.allclose(model.values, values[:8], rtol=1e-12)
    assert math.isclose(model.trace, values.sum(), rel_tol=1e-12)
    assert np.allclose(np.abs((model.axes * axes[:8]).sum(axis=1)), 1, atol=1e-12)
    centred = x - x.mean(axis=0)
    want = centred @ model.axes.T / np.sqrt(values[:8])
    exact = [sum((len(x) * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    for i in range(len(x)):
        assert found[i][0][0] == exact[i]
        assert np.allclose(found[i][0][1], want[i], atol=1e-10)
    assert identity_error(with_whitened(rows, model), 8) < 1e-10


def test_rows_without_a_usable_vector_are_left_out(spark):
    good = [(i, [float(i % 3), float(i % 5), i / 7]) for i in range(30)]
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [1.0, math.inf, 2.0]),
        (105, [1.0, -math.inf, 2.0]), (106, [1e300, 0.0, 0.0]), (107, [1.0, 2.0]), (108, [1.0, 2.0, 3.0, 4.0])]
    model, found = white(spark.createDataFrame(good + bad, SCHEMA))
    assert sorted(found) == list(range(30)) and model.n == 30 and len(model.values) == 3


def test_repeated_rows_count_and_come_back(spark):
    once = [(i, [float(i % 3), float(i % 4)]) for i in range(12)]
    model, found = white(spark.createDataFrame(once + once + [(None, [1.0, 1.0])], SCHEMA))
    assert model.n == 25 and all(len(v) == 2 for k, v in found.items() if k is not None) and len(found[None]) == 1


def test_directions_without_variance_have_no_component(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], SCHEMA)
    model = fit(flat)
    assert len(model.values) == 1 and identity_error(with_whitened(flat, model), 1) < 1e-12
    assert fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)) is None
    assert fit(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)) is None
    assert fit(spark.createDataFrame([], SCHEMA)) is None
    assert fit(spark.createDataFrame([(1, None)], SCHEMA)) is None


def test_equal_eigenvalues_are_still_white(spark):
    corners = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)]) for i in range(8)]
    rows = spark.createDataFrame(corners, SCHEMA)
    model = fit(rows)
    assert np.allclose(model.values, 512.0**2) and identity_error(with_whitened(rows, model), 3) < 1e-12


def test_clashing_columns_are_replaced_and_others_kept(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 2)], "x", -1, "keep") for i in range(6)],
                                 SCHEMA + ", whitened STRING, deviation LONG, n STRING")
    out = with_whitened(rows, fit(rows))
    assert out.columns == ["vec_id", "embedding", "n", "whitened", "deviation"]
    assert {r["n"] for r in out.collect()} == {"keep"} and all(r["deviation"] >= 0 for r in out.collect())


def test_products_and_deviations_are_exact_beyond_floats():
    big = np.array([[2**40 + 1, 3], [-(2**40), 5]])
    assert products(big).tolist() == [[(2**40 + 1) ** 2 + 2**80, 3 * (2**40 + 1) - 5 * 2**40], [3 * (2**40 + 1) - 5 * 2**40, 34]]
    assert deviations(np.array([[10, 20], [13, 20]]), 2, (23, 40)) == [9, 9]
    assert deviations(np.array([[2**40], [0]]), 2, (2**40,)) == [None, None]


@pytest.mark.parametrize("rank", [1, 2, 7, 8])
def test_factor_and_rotations(rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(8, rank)) * 10.0 ** rng.integers(-3, 3, rank)
    a = b @ b.T
    factor = pivoted_cholesky(a)
    assert factor.shape == (8, rank) and np.allclose(factor @ factor.T, a, rtol=1e-9, atol=1e-9)
    values, axes = jacobi(factor)
    assert (np.diff(values) <= 0).all() and np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)
    assert np.allclose(a @ axes, axes * values, atol=1e-9 * values[0])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    ids = sorted(given)
    x, values, axes = brute([given[i] for i in ids])
    assert len(rows) == 8 * len(ids)
    got = np.zeros((len(ids), 8))
    for r in rows:
        at = ids.index(r["vec_id"])
        got[at, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(ids) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-10)
    assert np.allclose(got.T @ got / len(ids), np.eye(8), atol=1e-9)
    want = (x - x.mean(axis=0)) @ axes[:8].T / np.sqrt(values[:8])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-7)
