"""Whitening against numpy's eigenvectors and Python integers; the polar iteration on hard spectra."""

import math

import numpy as np
import pytest

from pedalytics.llm.qdwh import eigen, polar_factor
from pedalytics.llm.whitening import Centre, whiten

VECTORS = "vec_id long, embedding array<float>"


def plain(rows, components=16):
    """Rows (vec_id, list) as the operator should return them, signs by the largest entry."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    out = []
    for dims in {len(x) for _, x in good}:
        own = [(i, x) for i, x in good if len(x) == dims]
        fit = sorted({tuple(x) for _, x in own})
        n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        mean = [t / n for t in total]
        m = np.array([[(x - t // n) - (t % n) / n for x, t in zip(row, total, strict=True)] for row in fit])
        v = m.T @ m / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for k in range(min(components, dims)):
            if e[k] > 1e-11 * np.trace(v):
                axis = u[:, k] * np.sign(u[np.abs(u[:, k]).argmax(), k])
                out += [(i, k + 1, n, sum((n * a - t) ** 2 for a, t in zip(x, total, strict=True)),
                         float((np.array(x) - mean) @ axis / math.sqrt(e[k])), float(e[k] / np.trace(v))) for i, x in own]
    return sorted(out, key=lambda r: (r[0] is not None, r[:4]))


def compare(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[:4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4] == pytest.approx(b[4], abs=1e-6) and a[5] == pytest.approx(b[5], rel=1e-4)
        assert a[6] <= 1e-4


def vectors(n, dims, seed=5):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.standard_normal(dims) * np.linspace(3, 0.5, dims) + 1]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_equals_plain(spark, dims):
    rows = vectors(300, dims)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)]  # copies count once in the fit
    compare(whiten(spark.createDataFrame(rows, VECTORS).repartition(4)), plain(rows))


def test_odd_rows(spark):
    rows = vectors(60, 4) + [(None, [1.0, 2.0, 3.0, 4.0]), (7, None), (8, []), (9, [1.0, None, 2.0, 3.0]), (5, [0.0] * 4),
                             (10, [float("nan")] * 4), (11, [float("inf"), 0.0, 0.0, 0.0]), (5, [0.0] * 4)]
    rows += [(100 + i, v) for i, v in vectors(20, 2, 8)] + [(200, [1.0] * 7)]  # lengths of their own; one single vector
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", component string")
    compare(whiten(df.withColumnRenamed("component", "n")), plain(rows))
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id = 200")).count() == 0


def test_fewer_vectors_than_dimensions(spark):
    rows = vectors(5, 12)
    got = whiten(spark.createDataFrame(rows, VECTORS))
    assert got.agg({"component": "max"}).first()[0] == 4
    compare(got, plain(rows))


def test_table_of_the_driver(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    compare(whiten(df), plain(rows))


def test_deviation_is_exact_or_null():
    big = 1 << 31
    x = np.array([[big, 0], [0, 0], [5, 7]], np.int64)
    total = np.array([int(c) for c in x.sum(axis=0)], object)
    want = [sum((3 * int(a) - int(t)) ** 2 for a, t in zip(row, total, strict=True)) for row in x]
    assert Centre(3, total).deviation(x) == [v if v < 1 << 63 else None for v in want]
    assert any(v >= 1 << 63 for v in want) and any(v < 1 << 63 for v in want)


SPECTRA = {"spread": np.linspace(1, 2, 40), "steep": np.geomspace(1, 1e-9, 40), "repeated": np.repeat([5, 3, 1, 0.0], 10),
           "equal": np.ones(9), "zero": np.zeros(4), "one": np.array([2.0]), "signs": np.linspace(-1, 1, 31),
           "near": np.concatenate([2 + np.arange(10) * 1e-12, np.linspace(0, 1, 20)])}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigen(name):
    values = SPECTRA[name]
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    got, u = eigen((a + a.T) / 2)
    size = max(np.linalg.norm(values), 1e-300)
    assert np.abs(got - np.sort(values)[::-1]).max() <= 1e-14 * size
    assert np.linalg.norm(a @ u - u * got) <= 1e-13 * size
    assert np.abs(u.T @ u - np.eye(len(u))).max() < 1e-13


def test_polar_factor_is_the_sign():
    values = np.array([3.0, 1.0, 1e-6, -1e-6, -2.0])
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((5, 5)))
    sign = polar_factor(q @ np.diag(values) @ q.T)
    assert np.abs(sign - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-8
