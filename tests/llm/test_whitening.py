"""Whitening against a dense solver and plain sums; contour integration on hard spectra; edge rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from idloom.llm import feast, whitening
from idloom.llm.queries import QUERIES


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [[5.0], [3, 3, 3], np.linspace(1, 2, 40), 0.6 ** np.arange(48), [2.0] * 12 + [1.0] * 12, [7, 5 + 1e-9, 5, 1] + [0.0] * 20, [1.0] * 30, np.r_[1e6, np.ones(20)]],
    ids=["one", "equal", "even", "falling", "clusters", "close", "identity", "outlier"],
)
def test_largest_pairs_equal_a_dense_solver(values):
    a = spectrum(values)
    got, vectors = feast.largest_pairs(a, 16)
    want = np.sort(np.asarray(values, float))[::-1]
    rank = int((want > 1e-13 * want[0]).sum())
    assert len(got) == min(16, rank) and np.abs(got - want[: len(got)]).max() < 1e-12 * want[0]
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


def test_inertia_counts():
    a = spectrum([3, 2, 2, 1, -1])
    diag, off = feast.tridiagonal(a)
    assert feast.count_above(diag, off, np.array([-2, 0, 1.5, 2.5, 4])).tolist() == [5, 4, 3, 1, 0]
    assert feast.largest_pairs(np.zeros((3, 3)), 16)[0].size == 0 and feast.largest_pairs(np.zeros((0, 0)), 16)[0].size == 0
    with pytest.raises(ArithmeticError):
        feast.interval_pairs(a, 1.5, 2.5, 4, 3.0)


def expected(vectors, most=16):
    """{vec_id: (deviation, whitened)} by plain sums and a dense solver; n; explained."""
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(a - m) for a, m in zip(v, mean, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(most, int((values > 1e-13 * values[0]).sum()))
    out = {i: (sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), np.array([float(a - m) for a, m in zip(v, mean, strict=True)]) @ vecs[:, :k] / np.sqrt(values[:k])) for i, v in x.items()}
    return out, n, values[:k] / values.sum()


def compare(rows, vectors):
    want, n, explained = expected(vectors)
    k = len(explained)
    assert len(rows) == k * len(want) and {r.n for r in rows} == {n}
    assert {(r.vec_id, r.component) for r in rows} == {(i, c + 1) for i in want for c in range(k)}
    signs = {}
    for r in rows:
        value = want[r.vec_id][1][r.component - 1]
        assert r.deviation == want[r.vec_id][0] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(value) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * value))
        assert abs(abs(r.whitened) - abs(value)) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


SCHEMA = "vec_id bigint, embedding array<float>, n string, x int, component array<int>"


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((300, 20)) * 0.85 ** np.arange(20)).astype(np.float32).astype(float).tolist()
    vectors = list(enumerate(base)) + [(400 + i, base[0]) for i in range(200)]  # a group of copies
    vectors += [(700, None), (701, [float("nan")] + base[0][1:]), (702, [float("inf")] + base[0][1:]), (703, [None] + base[0][1:]), (704, [])]
    rows = [(i, v, "a", 1, [1]) for i, v in vectors]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    compare(QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect(), vectors)
    repeated = spark.createDataFrame([*rows[:40], rows[0], (None, base[1], None, None, None)], SCHEMA)
    got = whitening.whiten(repeated).collect()
    assert len(got) == 42 * 16 and sum(r.vec_id == 0 for r in got) == 32 and sum(r.vec_id is None for r in got) == 16


def test_whitening_without_spread(spark):
    make = lambda vs: spark.createDataFrame([(i, v, "", 1, None) for i, v in enumerate(vs)], SCHEMA)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vs in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [None, 1.0]]):
        got = whitening.whiten(make(vs))
        assert got.columns == names and got.collect() == []
    compare(whitening.whiten(make([[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]])).collect(), [(0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 1.0])])  # one component
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(make([[1.0, 2.0], [1.0]])).collect()
    huge = whitening.whiten(make([[1e30, 0.0], [-1e30, 1.0], [0.0, 5.0]])).collect()
    assert [(r.vec_id, r.deviation is None, r.identity_error < 1e-4) for r in sorted(huge)] == [(0, True, True), (1, True, True), (2, False, True)]  # the other dimension is lost in rounding


def test_products_are_exact():
    x = np.array([[1 << 40, 3], [-(1 << 41), 5]], np.int64)
    assert whitening._products(x).tolist() == [[(1 << 80) + (1 << 82), 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 34]]
