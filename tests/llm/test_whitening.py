"""Components, whitened values and exact deviations against numpy; odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from mound.llm import whitening
from mound.llm.queries import QUERIES
from mound.llm.tables import settle
from tests.conftest import SF

KIND = "vec_id long, embedding array<double>, n string"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], "own") for i, v in enumerate(vectors)], KIND)


def exact(vectors):
    y = np.array([[math.floor(64 * x) + 1_000_000 for x in v] for v in vectors], dtype=object)
    n, s = len(y), y.sum(axis=0)
    return y, n, s


def compare(rows, vectors, first=0, components=32):
    y, n, s = exact(vectors)
    centred = ((y * n - s) / n).astype(float)
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1]
    k = min(components, int((values > 1e-12 * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * k
    for j in range(k):
        column = np.array([got[first + i, j + 1].whitened for i in range(len(vectors))])
        want = centred @ u[:, j] / math.sqrt(values[j])
        assert min(abs(column - want).max(), abs(column + want).max()) < 1e-8
        assert got[first, j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
    for i in range(len(vectors)) if k else ():
        row = got[first + i, 1]
        assert row.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[i], s))
        assert row.n == n and row.identity_error < 1e-9


@pytest.mark.parametrize("shape", [(300, 5), (400, 64), (60, 90)])
def test_against_numpy(spark, shape):
    rng = np.random.default_rng(shape[0])
    vectors = rng.standard_normal(shape) * np.linspace(3, 0.2, shape[1]) + 5
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_filtered_iteration_is_certified(spark):
    """A flat spectrum, with a block much smaller than the space."""
    rng = np.random.default_rng(3)
    table = settle(whitening.whole(frame(spark, rng.standard_normal((2_000, 40)))))
    (model,) = whitening.fit(table, components=6, guard=6)
    y = np.stack([r.y for r in table.orderBy("vec_id").collect()]).astype(float)
    values, u = np.linalg.eigh(np.cov(y.T, bias=True))
    assert np.allclose(model.values, values[::-1][:6], rtol=1e-12)
    assert abs(abs((u[:, ::-1][:, :6] * model.vectors).sum(axis=0)) - 1).max() < 1e-12
    assert model.residual < 1e-12 and model.passes > 12
    with pytest.raises(ArithmeticError):
        whitening.fit(table, components=6, guard=1, degree=2, rounds=2)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [1.5, -2.0], [1.5, -2.0], [0.0, 7.25]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")]]
    rows = frame(spark, good).unionByName(frame(spark, bad, 100))
    compare(whitening.whiten(rows).collect(), good)
    again = whitening.whiten(frame(spark, good).unionByName(frame(spark, good))).collect()
    assert len(again) == 16 and {r.n for r in again} == {8}


def test_lengths_are_lists_of_their_own(spark):
    rng = np.random.default_rng(5)
    short, long = rng.standard_normal((30, 3)), rng.standard_normal((40, 7))
    out = whitening.whiten(frame(spark, short).unionByName(frame(spark, long, 1_000))).collect()
    compare([r for r in out if r.vec_id < 1_000], short)
    compare([r for r in out if r.vec_id >= 1_000], long, 1_000)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_without_variance_there_is_no_component(spark, vectors):
    out = whitening.whiten(frame(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_rank_below_dims(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-9, 9, (200, 3)) / 8
    vectors = np.concatenate([base, base[:, :1], np.zeros((200, 60))], axis=1)
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40, 1.0], [0.0, 3.0], [-(2.0**41), 5.0]]
    out = whitening.whiten(frame(spark, vectors)).collect()
    y, n, s = exact(vectors)
    for r in out:
        want = sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[r.vec_id], s))
        assert r.deviation == (want if want < 2**63 else None)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    compare(QUERIES["op12_whitening"](spark, SF).collect(), [r.embedding for r in rows], rows[0].vec_id)
