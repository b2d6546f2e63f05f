import numpy as np
import pytest

from quillon.llm import knn

DDL = "vec_id long, vector array<float>"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], DDL)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((60, 64))
    v = np.concatenate([c + 0.25 * rng.standard_normal((n, 64)) for c, n in zip(centers, rng.integers(1, 40, 60))])
    return (v * rng.uniform(0.3, 3, len(v))[:, None]).astype(np.float32)


def exact(v, k=5, least=-2.0):
    u = v.astype(np.float64) / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(v)) for j in top[i] if s[i, j] >= least}


def test_recall_of_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 60)  # several cells on a small table
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)  # and several blocks of a cell
    truth = exact(clustered, least=0.9)
    got = {tuple(r) for r in knn.similar_pairs(table(spark, clustered), "vec_id", "vector").collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(truth) + 2


def test_open_search_with_chosen_queries(spark, clustered):
    found = knn.nearest(table(spark, clustered), "vec_id", "vector", margin=None, max_probes=8, every_query=20)
    rows = found.collect()
    assert {r.a for r in rows} == {i for i in range(len(clustered)) if i % 20 == 0}
    u = clustered.astype(np.float64) / np.linalg.norm(clustered, axis=1)[:, None]
    hits = sum(r.b in np.argsort(-(u[r.a] @ u.T))[:6] for r in rows)
    assert hits >= 0.9 * len(rows)
    assert all(abs(r.similarity - u[r.a] @ u[r.b]) < 1e-4 for r in rows)


def test_estimate_stays_in_its_bound(clustered):
    u = clustered.astype(np.float32) / np.linalg.norm(clustered, axis=1)[:, None]
    turn = knn.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-5)
    c = u.mean(axis=0)
    r = u - c
    rho = np.linalg.norm(r, axis=1)
    turned = r @ turn
    fit = np.abs(turned).sum(axis=1) / rho / 8
    signs = np.where(turned > 0, 1.0, -1.0)
    estimate = (turned @ signs.T) / 8 / fit * rho
    bound = knn.EPSILON * rho[:, None] * (rho * np.sqrt(1 - fit**2) / fit / np.sqrt(63))
    assert (np.abs(estimate - r @ r.T) <= bound).mean() > 0.9


def test_unusable_vectors_take_no_part(spark):
    good = np.eye(64)[:3] + 0.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(good)]
    rows += [(10, None), (11, []), (12, [1.0] * 63), (13, [0.0] * 64), (14, [float("nan")] + [1.0] * 63), (15, [float("inf")] + [1.0] * 63), (16, [None] + [1.0] * 63)]
    got = knn.nearest(spark.createDataFrame(rows, DDL), "vec_id", "vector", margin=None).collect()
    assert {r.a for r in got} == {0, 1, 2} == {r.b for r in got}


def test_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 64))
    v[10:18] = v[9]  # nine copies
    v[20:22] = v[19]  # three copies
    got = {}
    for r in knn.nearest(table(spark, v), "vec_id", "vector", margin=None).collect():
        got.setdefault(r.a, []).append(r)
    assert all(len(x) == 5 for x in got.values()) and len(got) == 40
    assert {r.b for r in got[17]} == {9, 10, 11, 12, 13} and {r.b for r in got[9]} == {10, 11, 12, 13, 14}
    assert {r.b for r in got[20] if r.rank <= 2} == {19, 21}


def test_empty_table(spark):
    empty = spark.createDataFrame([], DDL + ", cell int, k long")
    assert knn.similar_pairs(empty, "vec_id", "vector").count() == 0


def test_pairs_across_cell_borders(spark, monkeypatch):
    """Rows that form no clusters: most pairs lie near a border, many near several."""
    monkeypatch.setattr(knn, "CELL_ROWS", 60)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 8)) @ rng.standard_normal((8, 64)) + 0.2 * rng.standard_normal((3000, 64))
    truth = exact(v, least=0.9)
    got = {tuple(r) for r in knn.similar_pairs(table(spark, v), "vec_id", "vector").collect()}
    assert len(got & truth) >= 0.93 * len(truth)


@pytest.mark.parametrize("limits", [{"ONE_LEVEL": 4}, {"MAX_CELLS": 4}])
def test_many_cells_go_below_roots_and_into_regions(spark, clustered, monkeypatch, limits):
    monkeypatch.setattr(knn, "CELL_ROWS", 60)
    for name, value in limits.items():
        monkeypatch.setattr(knn, name, value)
    truth = exact(clustered, least=0.9)
    got = {tuple(r) for r in knn.similar_pairs(table(spark, clustered), "vec_id", "vector").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.02 * len(truth) + 2


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 64))
    v[30:60] = v[0]
    got = {}
    for r in knn.nearest(table(spark, v), "vec_id", "vector", margin=None).collect():
        got.setdefault(r.a, []).append(r)
    assert all(len(x) == 5 for x in got.values()) and len(got) == 90
    assert {r.b for r in got[45]} == {0, 30, 31, 32, 33} and {r.b for r in got[0]} == {30, 31, 32, 33, 34}


def test_best_partners_keep_ties_by_key_and_no_repeats():
    best = knn._Best(2, 3)
    best.add(np.array([0, 0, 0]), np.array([9, 4, 9]), np.array([0.5, 0.5, 0.5], np.float32))
    best.add(np.array([0, 0, 1]), np.array([1, 4, 7]), np.array([0.5, 0.5, 0.9], np.float32))
    assert best.keys.tolist() == [[1, 4, 9], [7, -1, -1]]
    assert best.floor(np.array([0, 1]), 0.2).tolist() == pytest.approx([0.5, 0.2])


@pytest.mark.parametrize("dim", [64, 65, 1])
def test_packed_numbers_keep_21_bits(dim):
    u = np.random.default_rng(6).uniform(-1, 1, (50, dim))
    u[0], u[1] = 1.0, -1.0
    assert np.abs(knn._unpack(knn._pack(u), dim) - u).max() < 6e-7
