"""Whitening against plain numpy over all rows."""

import numpy as np
import pytest

from quirefold.llm import whitening
from quirefold.llm.whitening import Shape, Whitening

VECTORS = "vec_id bigint, embedding array<float>, n bigint, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 5, "x") for k, v in enumerate(vectors)], VECTORS)


def plain(vectors):
    """vec_id -> rows, as the contract says them."""
    fine = {k: v for k, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    d = max(len(v) for v in fine.values())
    x = {k: [int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for k, v in fine.items()}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=float)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    v = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return {
        (k, c + 1): (n, sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)), abs((np.array(r) - np.array(s) / n) @ axes[:, c]) / np.sqrt(e[c]), e[c] / np.trace(v))
        for k, r in x.items() for c in range(min(4, d)) if e[c] > 1e-9
    }


def check(spark, vectors, **more):
    df = whitening.whitening(frame(spark, vectors), **more)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, want = {(r[0], r[1]): r for r in df.collect()}, plain(vectors)
    assert set(got) == set(want)
    for k, (n, deviation, white, share) in want.items():
        assert (got[k].n, got[k].deviation) == (n, deviation)
        assert abs(got[k].whitened) == pytest.approx(white, abs=1e-9)
        assert got[k].explained == pytest.approx(share, rel=1e-9) and got[k].identity_error < 1e-9
    return got


@pytest.fixture
def vectors():
    r = np.random.default_rng(3)
    v = (r.normal(size=(300, 11)) * np.linspace(2, 0.1, 11)).tolist()
    v += v[:50] * 4  # copies
    v += [None, [1.0, None] + [0.0] * 9, [float("nan")] * 11, [float("inf")] + [0.0] * 10, [], [0.5, -0.25], [-0.0] * 11]
    return v


def test_whitening_equals_numpy(spark, vectors):
    assert len(check(spark, vectors)) == 4 * (500 + 3)


def test_tiles_of_any_width(spark, vectors):
    one = check(spark, vectors, width=11)
    for width in (1, 3, 10):
        other = check(spark, vectors, width=width)
        assert all(other[k].whitened == pytest.approx(one[k].whitened, abs=1e-9) for k in one)


def test_little_variance(spark):
    assert whitening.whitening(frame(spark, [])).count() == 0
    assert whitening.whitening(frame(spark, [None, [float("nan")]])).count() == 0
    assert whitening.whitening(frame(spark, [[], []])).count() == 0
    assert whitening.whitening(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    line = [[float(k), 2.0 * k, 0.0] for k in range(9)]
    assert {k[1] for k in check(spark, line)} == {1}


def test_large_entries_and_counts(spark):
    got = whitening.whitening(frame(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and all(r.deviation is None for r in got if r.vec_id < 2)
    shape = Shape(2, -(10**9), 10**9, 256.0)
    w = Whitening(shape, 10**6, [7, -(10**9)], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[3, 4], [10**9, 5]], dtype="<i4")
    assert w.deviations(x) == [(3 * 10**6 - 7) ** 2 + (4 * 10**6 + 10**9) ** 2, None]
