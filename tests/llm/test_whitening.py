import math
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import whitening
from emberline.llm.common import table
from tests.llm.helpers import with_clashes

SCHEMA = "vec_id long, embedding array<float>"


def check(rows, got, components=4):
    """Against exact sums and numpy's eigenvectors of the formed covariance."""
    kept = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit]).reshape(n, width)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    total = values.sum()
    count = sum(v > 1e-10 * total for v in values[:components])
    by_row = {}
    for r in got:
        by_row.setdefault(r["component"], []).append(r)
    assert sorted(by_row) == list(range(1, count + 1))
    for k in range(count):
        mine = sorted(by_row[k + 1], key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]))
        want = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), x) for i, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert [(r["vec_id"], r["n"], r["deviation"]) for r in mine] == [(i, n, d) for i, d, _ in want]
        scores = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, _, x in want]) @ vectors[:, k] / np.sqrt(values[k])
        found = np.array([r["whitened"] for r in mine])
        assert min(np.abs(found - scores).max(), np.abs(found + scores).max()) < 1e-7
        assert all(abs(r["explained"] - values[k] / total) < 1e-10 and r["identity_error"] < 1e-9 for r in mine)


def test_whole_table_equals_numpy(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    check([tuple(r) for r in rows.collect()], whitening.whiten(rows).collect())


def test_nulls_copies_lengths_and_clashing_columns(spark):
    pick = np.random.default_rng(3)
    rows = [(k, (pick.standard_normal(9) * np.arange(1, 10)).round(3).tolist()) for k in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 9), (103, [float("inf")] * 9), (None, rows[0][1]), (5, rows[7][1]), (104, [1.0, 2.0]), (105, []), (106, [-0.0] * 9)]
    rows += [(200 + k, rows[1][1]) for k in range(40)]
    check(rows, whitening.whiten(with_clashes(spark.createDataFrame(rows, SCHEMA))).collect())


def test_fewer_dimensions_than_components_and_nothing_to_find(spark):
    rows = [(k, [float(k % 5), float(k * k % 7)]) for k in range(30)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    for rows in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviation_is_exact_or_null(spark):
    rows = [(1, [3e7, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [9e15, 9e15])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows[:3], SCHEMA)).collect()}
    x = [[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v in rows[:3]]
    for i, v in enumerate(x):
        exact = sum((3 * a - s) ** 2 for a, s in zip(v, map(sum, zip(*x))))
        assert got[i + 1] == (exact if exact < 1 << 63 else None)
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() if r["vec_id"] == 4} == {None}


@pytest.mark.parametrize("spectrum", ["near ties", "ties", "steep"])
def test_pairs_of_a_known_matrix(spectrum):
    pick = np.random.default_rng(5)
    q, _ = np.linalg.qr(pick.standard_normal((40, 40)))
    values = {"near ties": np.array([9, 9 - 1e-7, 8, 8 - 1e-5] + [7.9] * 3 + [1.0] * 33), "ties": np.array([5.0] * 6 + [2.0] * 34), "steep": 10.0 ** -np.arange(40)}[spectrum]
    matrix = (q * values) @ q.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors, residuals = whitening.leading_pairs(product, 40, 4, values.sum())
    assert np.abs(found - values[:4]).max() < 1e-12 * values[0] and residuals.max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12 and len(calls) < 150
