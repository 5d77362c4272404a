import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import pivot_index
from repolens.llm.pivot_index import choose_pivots, near_duplicates, normalised, roots_of

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"
COSINE = 0.93


def rotated(vectors, cosine, rng):
    """Vectors at exactly this cosine from the given ones."""
    other = rng.normal(size=vectors.shape)
    other -= (other * vectors).sum(axis=1)[:, None] * vectors
    return cosine * vectors + math.sqrt(1 - cosine**2) * normalised(other)


def brute(rows):
    """``{vec_id: (n_links, component_id)}`` of ``(vec_id, vector, label)``, from all pairs."""
    u = normalised(np.array([r[1] for r in rows]))
    labels = np.array([r[2] for r in rows])
    linked = (u @ u.T >= COSINE) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], ids.max() + 1).min(axis=1))
        if (new == least).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), least, strict=True)}
        least = new


def found(spark, rows, parts=4):
    out = near_duplicates(spark.createDataFrame([(i, list(map(float, v)), k) for i, v, k in rows], SCHEMA).repartition(parts)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_crowds_chains_and_loose_pairs(spark, monkeypatch):
    """A crowd that holds a third of the rows, exact copies, chains of links and single vectors, in lists of many blocks."""
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "TILE", 5)
    rng = np.random.default_rng(3)
    base = normalised(rng.normal(size=(120, 24)))
    crowd = normalised(base[:1] + 0.02 * rng.normal(size=(130, 24)))
    copies = np.repeat(base[1:2], 20, axis=0)
    chain = [base[2:3]]
    for _ in range(12):
        chain.append(rotated(chain[-1], 0.95, rng))
    edge = rotated(crowd[:20], 0.94, rng)
    vectors = np.concatenate([base, crowd, copies, *chain, edge])
    order = rng.permutation(len(vectors))
    rows = [(int(order[i]), vectors[i] * rng.uniform(0.1, 9), int(i % 7 == 0)) for i in range(len(vectors))]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("pivots", [64, 512])
def test_recall_at_the_threshold(spark, monkeypatch, pivots):
    """Pairs just above the threshold, the hardest ones, in lists of very many and of few vectors."""
    monkeypatch.setattr(pivot_index, "ROWS_A_PIVOT", 2400 // pivots)
    rng = np.random.default_rng(5)
    base = normalised(rng.normal(size=(1200, 32)))
    pairs = np.concatenate([base, rotated(base, 0.931, rng)])
    rows = [(i, v, 1) for i, v in enumerate(pairs)]
    want, got = brute(rows), found(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.93 * sum(n for n, _ in want.values())


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [1.0, math.nan, 3.0], 1), (9, [math.inf, 2.0, 3.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1),
        (13, [1e300, 2e300, 3e300], 1), (14, [1e-300, 2e-300, 3e-300], 1)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    linked = {1: 1, 2: 1, 13: 1, 14: 1, 11: 11, 12: 11}
    for r in out:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == ({1: 3, 11: 1}.get(linked.get(i), 0), linked.get(i, i), linked.get(i, i) == i)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (1, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out) == [
        (0, 0, 0, False), (0, 2, 1, False), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True)]


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    more = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], SCHEMA).withColumns(
        {"uid": F.lit("a"), "row": F.lit("b"), "kept": F.lit("c"), "n": F.lit(0), "root": F.lit(9)})
    out = near_duplicates(more)
    assert out.columns == ["vec_id", "embedding", "label", "uid", "row", "n", "root", "n_links", "component_id", "kept"]
    assert sorted((r["vec_id"], r["uid"], r["n_links"], r["kept"]) for r in out.collect()) == [(1, "a", 1, True), (2, "a", 1, False)]


def test_lengths_that_no_pivot_has(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "fit", lambda rows, cosine: {})
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, [0.1, 1.0], 1)]
    assert found(spark, rows) == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_pivots_are_apart_and_central():
    rng = np.random.default_rng(0)
    crowd = normalised(normalised(rng.normal(size=(1, 16))) + 0.05 * rng.normal(size=(50, 16)))
    sample = np.concatenate([crowd, normalised(rng.normal(size=(20, 16)))])
    pivots = choose_pivots(sample, 100, COSINE)
    assert len(pivots) == 21 and (crowd @ pivots[0]).min() > 0.965
    assert choose_pivots(sample, 5, COSINE).shape == (5, 16) and choose_pivots(sample[:0], 5, COSINE).shape == (0, 16)


def test_roots_join_rows_and_columns():
    linked = np.zeros((4, 3), dtype=bool)
    linked[1, 0] = linked[3, 0] = linked[3, 2] = linked[2, 1] = True
    row, column = roots_of(linked)
    assert row.tolist() == [0, 1, 2, 1] and column.tolist() == [1, 2, 1]
