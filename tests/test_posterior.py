"""Extremes of kurtosis against a dense grid, and the posterior of known tensors."""

import math

import numpy as np
import pytest

from voxelweave.operators import diffusion, posterior


def fits(n, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 3, 3))
    d = np.einsum("nij,nkj->nik", a, a) + 0.5 * np.eye(3)
    return np.concatenate([np.stack([d[:, i, j] for i, j in diffusion.SIX], axis=1), rng.normal(size=(n, 15))], axis=1)


def test_extremes_equal_a_dense_grid():
    fit = fits(300)
    low, high, sure = posterior.kurtosis_extremes(fit)
    k = diffusion.along(fit, diffusion.directions(60_000))[1]
    span = k.max(axis=1) - k.min(axis=1)
    assert sure.all()
    assert (low <= k.min(axis=1) + 1e-9 * span).all() and (high >= k.max(axis=1) - 1e-9 * span).all()
    assert np.allclose(low, k.min(axis=1), atol=2e-3 * span.max()) and (np.abs(high - k.max(axis=1)) <= 2e-3 * span).all()


def test_slope_and_bend_equal_differences():
    fit, rng = fits(5, 2), np.random.default_rng(3)
    d, w = diffusion.matrices(fit[:, :6]), fit[:, 6:][:, diffusion.ENTRY]
    n = rng.normal(size=(5, 2, 3))
    _, slope, bend = posterior.kurtosis_along(d, w, n)
    for a in range(3):
        h = 1e-5 * np.eye(3)[a]
        up, down = posterior.kurtosis_along(d, w, n + h), posterior.kurtosis_along(d, w, n - h)
        assert np.allclose((up[0] - down[0]) / 2e-5, slope[..., a], rtol=1e-5, atol=1e-5) and np.allclose((up[1] - down[1]) / 2e-5, bend[..., a], rtol=1e-4, atol=1e-4)


def test_no_bounds_without_a_positive_tensor():
    fit = fits(3)
    fit[1, :6] = [1, 1, -1, 0, 0, 0]
    fit[2, 3] = np.nan
    low, high, sure = posterior.kurtosis_extremes(fit)
    assert np.isnan(low[1:]).all() and np.isnan(high[1:]).all() and sure.tolist() == [True, False, False]
    flat = np.concatenate([np.tile([1.0, 1, 1, 0, 0, 0], (1, 1)), np.zeros((1, 15))], axis=1)
    low, high, sure = posterior.kurtosis_extremes(flat)
    assert (low[0], high[0], sure[0]) == (0, 0, True) and posterior.kurtosis_extremes(flat[:0])[0].shape == (0,)


def scan():
    at = diffusion.directions(40)
    return [(0.0, 0.0, 0.0, 0.0)] * 4 + [(b, *map(float, v)) for b in (1000.0, 2000.0) for v in at]


def test_posterior_of_known_tensors(spark):
    g = scan()
    d, k = 1e-3, 0.9
    clean = np.array([1000 * math.exp(-b * d + b * b * d * d * k / 6) for b, *_ in g])
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(2, len(g)))
    series = [clean, clean * np.exp(0.002 * noise[0]), clean * np.exp(0.004 * noise[0]), clean * np.exp(0.002 * noise[0]), np.full(len(g), 5.0) * np.exp(noise[1])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(series)], "voxel_id long, series array<double>")
    got = posterior.bayesian_kurtosis(df, g, draws=150).orderBy("voxel_id").collect()
    for m in ("mean_k", "k_min", "k_max"):
        assert got[0][f"{m}_mean"] == pytest.approx(k, rel=1e-5) and got[0][f"{m}_sd"] < 1e-5
    one, two = got[1], got[2]
    assert one["accepted"] == two["accepted"] == 1 and one["converged"] > 0.99
    assert abs(one["mean_k_mean"] - k) < 5 * one["mean_k_sd"] and abs(one["trace_mean"] - 3 * d) < 5 * one["trace_sd"]
    assert two["mean_k_sd"] == pytest.approx(2 * one["mean_k_sd"], rel=0.1)
    assert one["k_min_mean"] < one["mean_k_mean"] < one["k_max_mean"] and two["k_max_mean"] > one["k_max_mean"]
    assert list(got[3])[1:] == pytest.approx(list(one)[1:], rel=1e-5)
    assert got[4]["accepted"] < 0.5
    with pytest.raises(ValueError):
        posterior.bayesian_kurtosis(df, g[:30])


def test_one_file_is_dealt_to_all_cores(spark):
    df = spark.range(400, numPartitions=1).selectExpr("id AS voxel_id", "array(1D) AS series")
    assert posterior.dealt(df).rdd.getNumPartitions() == 4 and posterior.dealt(df.limit(0)).rdd.getNumPartitions() == 1
    assert posterior.dealt(df).count() == 400


def test_starts_are_the_least_local_minima():
    rng = np.random.default_rng(6)
    f = np.round(rng.normal(size=(len(posterior.GRID), 30)), 1)  # with ties
    row, point = posterior.grid_starts(f)
    for r in range(30):
        best = [p for p, close in enumerate(posterior.CLOSE) if f[p, r] <= f[close, r].min()]
        assert point[row == r].tolist() == sorted(best, key=lambda p: (f[p, r], p))[: posterior.STARTS]


def test_steps_equal_those_of_eigenvectors():
    rng = np.random.default_rng(7)
    h, g = rng.normal(size=(50, 2, 2)), rng.normal(size=(50, 2))
    h = h + np.swapaxes(h, 1, 2)
    h[:3] = [np.eye(2), -2 * np.eye(2), np.zeros((2, 2))]
    values, axes = np.linalg.eigh(h)
    want = -np.einsum("nij,nj,nkj,nk->ni", axes, 1 / np.maximum(np.abs(values), 0.1), axes, g)
    assert np.allclose(posterior.against_slope(h, g, np.full(50, 0.1)), want)
