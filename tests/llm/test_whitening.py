from __future__ import annotations

import math
import os
from fractions import Fraction

import numpy as np
import pytest

from tallymark.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, x string, v int"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "clash", 2) for i, v in rows], VECTORS).repartition(3)


def made(seed=0, n=200, dim=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ np.diag(np.geomspace(8, 0.2, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows + [(n + k, rows[3][1]) for k in range(90)]


def check(rows, got, k):
    """All columns against exact sums and a plain singular value decomposition."""
    dim = max(len(v) for _, v in rows)
    whole = [[math.floor(64 * c) + 1_000_000 for c in v + [0.0] * (dim - len(v))] for _, v in rows]
    fit = [list(t) for t in {tuple(w) for w in whole}]
    n = len(fit)
    s = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(w, s, strict=True)] for w in fit])
    _, singular, right = np.linalg.svd(centred, full_matrices=False)
    values, vectors = singular**2 / n, right.T
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == sorted({i for i, _ in rows}) and len(got) == k * len(rows)
    signs = {}
    for (i, _), w in zip(rows, whole, strict=True):
        for r in by[i]:
            c = r.component - 1
            deviation = sum((n * x - t) ** 2 for x, t in zip(w, s, strict=True))
            assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            want = float(np.array([float(Fraction(n * x - t, n)) for x, t in zip(w, s, strict=True)]) @ vectors[:, c] / math.sqrt(values[c]))
            if abs(want) > 1e-3:
                assert signs.setdefault(c, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7, abs=1e-7)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_columns_equal_a_plain_decomposition(spark):
    rows = made()
    bad = [(900, None), (901, [1.0] * 19 + [None]), (902, [math.nan] * 20), (903, [math.inf] * 20), (904, [3e38] * 20)]
    rows.append((905, [1.0, 2.0]))  # shorter: padded
    rows.append((906, []))
    check(rows, whitening.whiten(frame(spark, rows + bad)).collect(), 16)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, whitening.op12_whitening(spark, SF).collect(), 16)


def test_few_dimensions_and_ill_conditioned_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 3))
    x = np.stack([base[:, 0] * 1e5, base[:, 0] * 1e5 + base[:, 1], base[:, 2]], 1)  # nearly equal columns
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 900 and got[0].identity_error < 1e-6
    check(rows, got, 3)


def test_directions_without_spread_have_no_value(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), float(2 * a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.component, r.whitened is None, r.explained == 0) for r in got} == {(1, False, False), (2, False, False), (3, True, True), (4, True, True)}
    assert got[0].identity_error < 1e-9
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (0, 1) for c in (1, 2)]


def test_empty_tables_and_great_deviations(spark):
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [])])).collect() == []
    rng = np.random.default_rng(8)
    wide = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(700, 2)) * [1e7, 1.0])]
    check(wide, whitening.whiten(frame(spark, wide)).collect(), 2)
    big = [(i, [float(np.float32(v)), 0.0]) for i, v in enumerate((-1e12, 1e12, 0.0))]
    got = whitening.whiten(frame(spark, big), 1).collect()
    assert [r.deviation for r in sorted(got)] == [None, None, 0]
    assert sorted(round(r.whitened, 6) for r in got) == [-1.224745, 0.0, 1.224745]


def test_triangular_solves_and_shifted_factors():
    rng = np.random.default_rng(7)
    r = np.triu(rng.normal(size=(9, 9))) + 4 * np.eye(9)
    x = rng.normal(size=(30, 9))
    assert np.allclose(whitening.solve(x, r) @ r, x)
    g = np.ones((5, 5))  # of rank one
    f = whitening.factor(g, False)
    assert np.allclose(f.T @ f, g, atol=1e-10) and np.allclose(np.tril(f, -1), 0)
