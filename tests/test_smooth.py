"""Neighbourhood filters against a numpy gather with reflected edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec
from cellcast.operators import smooth as S

SMALL = GridSpec(0.0, 0.0, 12.0, 9.0, 1.0, 1.0, n_rows=9, n_cols=12)


def reflect(i, n):
    m = i % (2 * n)
    return m if m < n else 2 * n - 1 - m


def gather_1d(arr, kernel, axis):
    out = np.zeros_like(arr)
    n = arr.shape[axis]
    for i in range(n):
        for k, w in kernel:
            src = reflect(i + k, n)
            if axis == 0:
                out[i, :] += w * arr[src, :]
            else:
                out[:, i] += w * arr[:, src]
    return out


def brute(arr, kernel):
    return gather_1d(gather_1d(arr, kernel, 0), kernel, 1)


def run(spark, arr, kernel):
    rows = [("l", 0, int(r), int(c), float(arr[r, c])) for r, c in zip(*np.nonzero(arr))]
    df = spark.createDataFrame(rows, "layer string, period_h int, row int, col int, value double")
    out = np.zeros_like(arr)
    for r in S.separable_filter(df, kernel, SMALL).collect():
        out[r["row"], r["col"]] += r["value"]
    return out


@pytest.fixture(scope="module")
def raster():
    rng = np.random.default_rng(3)
    a = np.zeros((9, 12))
    for _ in range(14):
        a[rng.integers(0, 9), rng.integers(0, 12)] += rng.integers(1, 6)
    a[0, 0] = 4.0
    a[8, 11] = 2.0
    return a


@pytest.mark.parametrize("kernel", [S.gaussian_kernel(1.0, 4.0), S.uniform_kernel(3), S.uniform_kernel(2),
                                    S.uniform_kernel(1)])
def test_matches_gather(spark, raster, kernel):
    np.testing.assert_allclose(run(spark, raster, kernel), brute(raster, kernel), atol=1e-12)


def test_mass_preserved(spark, raster):
    out = run(spark, raster, S.gaussian_kernel())
    assert out.sum() == pytest.approx(raster.sum(), rel=1e-12)


def test_gaussian_corner_value(spark):
    a = np.zeros((9, 12))
    a[0, 0] = 1.0
    out = run(spark, a, S.gaussian_kernel())
    assert out[0, 0] == pytest.approx((0.398943469 + 0.241971446) ** 2, abs=1e-8)
    assert out.sum() == pytest.approx(1.0)


def test_gaussian_weights():
    w = [x for _, x in S.gaussian_kernel()]
    assert w[:5] == pytest.approx([0.000133831, 0.004431862, 0.053991127, 0.241971446, 0.398943469], abs=1e-9)


def test_focal_size_one_is_identity(spark, raster):
    np.testing.assert_array_equal(run(spark, raster, S.uniform_kernel(1)), raster)


@pytest.mark.parametrize("size", [1, 2, 5, 25, 26, 40])
def test_running_sums_equal_the_gather(spark, size):
    rng = np.random.default_rng(size)
    arr = np.where(rng.random((9, 12)) < 0.1, rng.integers(1, 9, (9, 12)), 0).astype(float)
    rows = [("l", 0, int(r), int(c), float(arr[r, c])) for r, c in zip(*np.nonzero(arr), strict=True)]
    df = spark.createDataFrame(rows, "layer string, period_h int, row int, col int, value double")
    out = np.zeros_like(arr)
    found = S.wide_focal_mean(df, SMALL, size).collect()
    for r in found:
        out[r["row"], r["col"]] += r["value"]
    want = brute(arr, S.uniform_kernel(size))
    assert np.allclose(out, want) and len(found) == (want > 1e-12).sum()


def test_running_sums_of_no_cells(spark):
    df = spark.createDataFrame([], "layer string, period_h int, row int, col int, value double")
    assert S.wide_focal_mean(df, SMALL, 5).count() == 0
