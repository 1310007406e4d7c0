"""Whitening against numpy's eigenvectors, and FEAST's parts on planted matrices."""

from __future__ import annotations

import math

import numpy as np
import pytest

from evkit.llm.whitening import count_above, feast, fit_whitening, intervals, leading, whiten

SCHEMA = "vec_id long, embedding array<float>, n string"


def planted(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [1, 1, 1, 1], [9, 3, 3, 3, 3, 3, 0], [0, 0, 2], [-1, 2, -3, 4, 0.0]])
def test_inertia_counts_eigenvalues(values):
    matrix = planted(np.array(values, dtype=float))
    for shift in (-4, -0.7, 0.3, 1.5, 2.5, 3.5, 8, 10):
        assert count_above(matrix, shift) == sum(v > shift for v in values)
    assert count_above(np.zeros((3, 3)), 0.0) == 0
    assert count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_intervals_cut_at_gaps_and_keep_clusters_whole():
    matrix = planted(np.array([9, 8, 7, 5, 5, 5, 5, 5, 2, 1.0]))
    found = intervals(matrix, 6, per=4)
    assert [n for _, _, n in found] == [8]
    assert [n for _, _, n in intervals(matrix, 3, per=2)] == [2, 1]


@pytest.mark.parametrize("values", [
    np.linspace(10, 1, 40), np.r_[np.full(8, 4.0), np.full(20, 1.0)], np.r_[1e6, 1e3, np.linspace(2, 1, 30)],
    np.r_[3, 3, 2, 2, np.zeros(20)], np.array([2.0]), np.exp(-np.arange(60.0) / 4), np.ones(12)])
def test_feast_finds_the_leading_pairs(values):
    matrix = planted(values, 3)
    wanted = min(8, len(values))
    found, vectors = leading(matrix, wanted)
    assert found == pytest.approx(np.sort(values)[::-1][:wanted], rel=1e-9, abs=1e-12 * values.max())
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-8
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-9 * values.max()


def test_feast_says_if_the_count_is_wrong():
    with pytest.raises(ArithmeticError):
        feast(planted(np.array([4.0, 3, 2, 1])), 2.5, 3.5, 2)


def brute(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    off = [[n * row[i] - s[i] for i in range(d)] for row in x]
    centred = np.array([[o / n for o in row] for row in off])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return [sum(o * o for o in row) for row in off], centred, values[::-1], columns[:, ::-1]


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12) + 5).astype("float32")
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(good)]
    bad = [None, [], [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] * 12]
    data += [(1000 + i, v, "x") for i, v in enumerate(bad)]
    data[7] = (None, data[7][1], "x")
    frame = spark.createDataFrame(data, SCHEMA).repartition(6)
    rows = whiten(frame, fit_whitening(frame)).collect()
    deviation, centred, values, columns = brute(good)
    place = {None: 7} | {i: i for i in range(400)}
    assert sorted(place[r["vec_id"]] for r in rows) == list(range(400))
    signs = None
    for r in rows:
        i = place[r["vec_id"]]
        want = centred[i] @ columns[:, :8] / np.sqrt(values[:8])
        if signs is None:
            signs = np.sign(want * np.array(r["whitened"]))
        assert np.array(r["whitened"]) * signs == pytest.approx(want, abs=1e-8)
        assert (r["n"], r["deviation"]) == (400, deviation[i]) and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[:8] / values.sum(), rel=1e-9)


def test_repeats_few_rows_and_other_lengths(spark):
    data = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [3.0, 2.0], "b"), (3, [5.0], "c"), (4, [0.0] * 3, "d"), (5, [0.0] * 3, "d")]
    frame = spark.createDataFrame(data, SCHEMA)
    fitted = fit_whitening(frame)
    got = {(r["vec_id"], len(r["embedding"])): r for r in whiten(frame, fitted).collect()}
    assert set(fitted) == {1, 2, 3} and len(got) == 5
    # One direction varies among the pairs, none among single or equal vectors.
    assert [len(got[k]["whitened"]) for k in sorted(got)] == [1, 1, 0, 0, 0]
    assert got[(2, 2)]["deviation"] == (3 * 3072 - 5120) ** 2 and got[(2, 2)]["n"] == 3
    assert abs(got[(2, 2)]["whitened"][0]) == pytest.approx(math.sqrt(2))


def test_empty_table_and_no_usable_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_whitening(empty) == {} and whiten(empty, {}).count() == 0
    nulls = spark.createDataFrame([(1, None, "x")], SCHEMA)
    assert whiten(nulls, fit_whitening(nulls)).count() == 0
