"""Embedding whitening against dense eigenvectors in double precision."""

import math

import numpy as np
import pytest

from tickloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "n") for i, v in rows], SCHEMA).repartition(5)


def brute(rows, most=16):
    """vec_id -> (deviation, whitened up to sign), and explained shares."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((fit * n - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    project = vectors[:, :k] / np.sqrt(values[:k])
    out = []
    for i, x in kept:
        away = np.array(x, dtype=object) * n - s
        out.append((i, int((away * away).sum()), (away / n).astype(float) @ project))
    return n, out, values[:k] / values.sum()


def check(spark, rows, most=16):
    n, wanted, explained = brute(rows, most)
    found = whitening.whiten(table(spark, rows), most).collect()
    assert len(found) == len(wanted) * len(explained)
    by_row = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-8
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for i, deviation, white in wanted:
        got = np.array([by_row[i, deviation][c + 1].pop() for c in range(len(white))])
        if signs is None or (signs == 0).any():
            signs = np.where(np.abs(white) > 1e-3, np.sign(got * white), 0)
            continue
        assert np.allclose(got, signs * white, atol=1e-7)
    return found


def test_a_random_table(spark):
    some = np.random.default_rng(0)
    check(spark, [(i, v.tolist()) for i, v in enumerate(some.standard_normal((900, 24)) * (1 + np.arange(24)))])


def test_repeated_vectors_count_once(spark):
    some = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(some.standard_normal((40, 5)) * 3)]
    found = check(spark, [*rows, *[(1000 + k, rows[0][1]) for k in range(500)]])
    assert {r.n for r in found} == {40}


def test_the_given_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(spark, rows)


def test_rows_that_take_no_part(spark):
    some = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(some.standard_normal((30, 3)) * 5)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, [1e30, 0.0, 0.0]), (105, []), (106, [1.0])]
    odd = [(None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1])]
    found = whitening.whiten(table(spark, [*rows, *bad, *odd])).collect()
    assert {r.vec_id for r in found} == {*range(30), None} and len(found) == 3 * 33


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]])
def test_tables_without_a_direction(spark, rows):
    found = whitening.whiten(table(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.collect() == []


def test_constant_and_dependent_entries_have_no_component(spark):
    rows = [(i, [i / 4, 7.0, i / 2 + 1, (i * i % 11) / 4]) for i in range(60)]
    assert {r.component for r in check(spark, rows)} == {1, 2}


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**33 + 1024 * i), float(i % 3)]) for i in range(9)]
    assert len(check(spark, rows)) == 18


def test_a_deviation_beyond_64_bits_is_null(spark):
    found = whitening.whiten(table(spark, [(i, [float(2**32 * (i % 3)), float(i)]) for i in range(9)])).collect()
    assert len(found) == 18 and {r.deviation for r in found if r.vec_id != 1 and r.vec_id % 3 != 1} == {None}
    assert all(r.identity_error < 1e-8 for r in found)


@pytest.mark.parametrize("parts", [1, 40])
def test_the_tree_of_tasks(spark, parts):
    some = np.random.default_rng(3)
    rows = whitening.whole_vectors(table(spark, [(i, v.tolist()) for i, v in enumerate(some.standard_normal((400, 6)))]).repartition(parts))
    x = np.array([r.x for r in rows.collect()])
    n, s = whitening.sums(rows)
    r = whitening.triangle(rows, n, s)
    own = x - x.mean(axis=0)
    assert (n, s) == (400, x.sum(axis=0).tolist()) and np.allclose(r.T @ r, own.T @ own)


def matrices():
    some = np.random.default_rng(4)
    q, p = np.linalg.qr(some.standard_normal((90, 30)))[0], np.linalg.qr(some.standard_normal((30, 30)))[0]
    spread = np.ones(30)
    spread[:4], spread[4:9], spread[9:12] = 10, 10 * (1 - 1e-10), 3
    return {
        "random": some.standard_normal((90, 30)),
        "graded": some.standard_normal((90, 30)) * 2.0 ** -np.arange(30),
        "equal values": q,
        "clusters": q * spread @ p,
        "falling": q * np.exp(-np.arange(30) / 3.0) @ p,
        "low rank": some.standard_normal((90, 6)) @ some.standard_normal((6, 30)),
        "blocks": np.diag([5.0, 5, 5, 3, 3, 1, 0, 0]),
        "band": np.diag(np.ones(30)) + np.diag(np.ones(29), 1),
        "wide": some.standard_normal((4, 30)),
        "one column": some.standard_normal((9, 1)),
        "zero": np.zeros((5, 3)),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_the_solver(name):
    a = matrices()[name]
    values, vectors = whitening.right_singular(np.linalg.qr(a, mode="r"), 30)
    wanted = np.linalg.svd(a, compute_uv=False)
    assert len(values) == np.linalg.matrix_rank(a) and np.allclose(values, wanted[: len(values)], rtol=1e-12, atol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values**2).max(initial=0) <= 1e-13 * wanted[0] ** 2


def test_dqds_has_high_relative_accuracy():
    """Values of a graded matrix far below double precision of the largest one."""
    diagonal, above = 10.0 ** -np.arange(0, 60, 3.0), 10.0 ** -np.arange(1, 58, 3.0)
    values = whitening.dqds(diagonal, above)
    # the product of all values is the product of the diagonal
    assert np.log(values).sum() == pytest.approx(np.log(diagonal).sum(), rel=1e-14)
    assert (values > 0).all() and values[-1] < 1e-50
