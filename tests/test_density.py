"""Density curves against the kernel summed over all rows."""

import math

import numpy as np
import pytest

from cardpulse.operators import profile


def plain(x, points):
    h = np.std(x, ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), points)
    return grid, np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("shape", ["normal", "skewed", "two far groups", "few rows", "ties"])
def test_curve_is_the_sum_over_rows(spark, shape):
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(5, 2, 4000), "skewed": rng.lognormal(3, 1.5, 3000),
         "two far groups": np.concatenate([rng.normal(0, 1, 2000), rng.normal(1e5, 1, 5)]),
         "few rows": np.array([1.0, 4.0]), "ties": rng.integers(0, 4, 900).astype(float)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "A double")
    got = sorted((r["I"], r["X"], r["DENSITY"]) for r in profile.density(df, [("A", 10, None, False)], 120).collect())
    grid, want, h = plain(x, 120)
    assert [i for i, _, _ in got] == list(range(120))
    assert np.allclose([v for _, v, _ in got], grid, rtol=1e-12)
    error = np.abs(np.array([d for _, _, d in got]) - want).max() * h * math.sqrt(2 * math.pi)
    assert error <= profile.density_error() + 1e-13 and profile.density_error() < 1e-12


def test_trims_and_columns_without_spread(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.normal(size=500))
    df = spark.createDataFrame([(float(v), 3.0, None) for v in x], "A double, B double, C double")
    out = profile.density(df, [("A", 10, 0.9, True), ("B", 10, None, False), ("C", 10, None, False), ("Z", 1, None, False)], 50)
    rows = sorted((r["I"], r["X"], r["DENSITY"]) for r in out.collect())
    grid, want, _ = plain(x[x < np.quantile(x, 0.9)], 50)
    assert len(rows) == 50 and np.allclose([d for _, _, d in rows], want, atol=1e-12)
    assert profile.density(df.where("A > 100"), [("A", 10, None, False)]).count() == 0


def test_hermite_polynomials():
    assert [profile._hermite(k) for k in range(5)] == [[1], [0, 1], [-1, 0, 1], [0, -3, 0, 1], [3, 0, -6, 0, 1]]
