"""Special functions against tabulated values and quadrature, and the maps that use them."""

import math

import numpy as np
import pytest

from voxelweave import functions as fx
from voxelweave.functions import special
from voxelweave.operators import diffusion


def test_carlson_integrals():
    # Published check values of RF and RD.
    assert special.carlson_rf(1.0, 2.0, 0.0) == pytest.approx(1.3110287771461, rel=1e-12)
    assert special.carlson_rf(2.0, 3.0, 4.0) == pytest.approx(0.58408284167715, rel=1e-12)
    assert special.carlson_rd(0.0, 2.0, 1.0) == pytest.approx(1.7972103521034, rel=1e-12)
    assert special.carlson_rd(2.0, 3.0, 4.0) == pytest.approx(0.16510527294261, rel=1e-12)
    assert special.carlson_rf(4.0, 4.0, 4.0) == pytest.approx(0.5) and special.carlson_rd(4.0, 4.0, 4.0) == pytest.approx(0.125)
    x = np.array([1e-8, 1.0, 1e6])
    assert np.allclose(special.carlson_rf(x, x, x), x**-0.5, rtol=1e-12) and special.carlson_rf(x[:0], 1, 1).shape == (0,)
    assert np.isinf(special.carlson_rf(0.0, 0.0, 1.0)) and np.isinf(special.carlson_rd(1.0, 1.0, 0.0)) and np.isnan(special.carlson_rd(-1.0, 1.0, 1.0))
    rng = np.random.default_rng(0)
    a, b, c = rng.random((3, 50)) * [[1], [10], [100]]
    total = special.carlson_rd(a, b, c) + special.carlson_rd(b, c, a) + special.carlson_rd(c, a, b)
    assert np.allclose(total, 3 / np.sqrt(a * b * c), rtol=1e-10)


def test_incomplete_gamma():
    a = np.array([0.5, 1.0, 3.0, 100.0, 0.1, 20.0])
    x = np.array([0.5, 2.0, 2.5, 90.0, 1e-3, 60.0])
    want = [math.erf(math.sqrt(0.5)), 1 - math.exp(-2), 1 - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2), 1 - sum(math.exp(-90 + k * math.log(90) - math.lgamma(k + 1)) for k in range(100))]
    p, q = special.incomplete_gamma(a, x)
    assert np.allclose(p[:4], want, rtol=1e-12) and np.allclose(p + q, 1) and q[5] == pytest.approx(sum(math.exp(-60 + k * math.log(60) - math.lgamma(k + 1)) for k in range(20)), rel=1e-10)
    assert special.incomplete_gamma(2.0, 0.0)[0] == 0 and special.incomplete_gamma(2.0, np.inf)[0] == 1 and np.isnan(special.incomplete_gamma(-1.0, 1.0)[0])
    # Tabulated 5 % points of chi-square.
    assert np.allclose(special.chi2_tail([3.841459, 11.070498, 18.307038, 124.342113], [1, 5, 10, 100]), 0.05, atol=1e-7)
    assert special.gamma_cdf(4.0, 1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert np.allclose(special.log_gamma([0.1, 0.5, 1, 2.5, 30]), [math.lgamma(v) for v in (0.1, 0.5, 1, 2.5, 30)], atol=1e-12)


def dense_means(fit):
    """Mean and radial kurtosis by Gauss-Legendre and trapezoid rules."""
    z, w = np.polynomial.legendre.leggauss(120)
    turn = 2 * np.pi * np.arange(240) / 240
    r = np.sqrt(1 - z * z)
    at = np.stack([np.outer(r, np.cos(turn)), np.outer(r, np.sin(turn)), np.outer(z, np.ones(240))], axis=2).reshape(-1, 3)
    mean = diffusion.along(fit, at)[1] @ (np.repeat(w, 240) / 480)
    maps = diffusion.tensor_maps(diffusion.matrices(fit[:, :6]))
    radial = [diffusion.along(f[None], np.outer(np.cos(turn), m[9:12]) + np.outer(np.sin(turn), m[12:15]))[1].mean() for f, m in zip(fit, maps, strict=True)]
    return mean, np.array(radial)


def test_mean_and_radial_kurtosis_equal_directional_means():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(60, 3, 3)))[0]
    values = np.sort(rng.uniform(0.3, 2.5, (60, 3)), axis=1)[:, ::-1].copy()
    values[:6] = [[1, 1, 1], [2, 2, 1], [2, 1, 1], [1 + 1e-7, 1, 1 - 1e-7], [2, 1 + 1e-5, 1], [2, 2 - 3e-4, 0.7]]
    d = (q * values[:, None, :]) @ np.swapaxes(q, 1, 2)
    fit = np.concatenate([np.stack([d[:, i, j] for i, j in diffusion.SIX], axis=1), rng.normal(1, 0.5, (60, 15))], axis=1)
    mean, radial = dense_means(fit)
    maps = diffusion.kurtosis_maps(fit)
    assert np.allclose(maps[:, 4], mean, rtol=1e-6, atol=1e-6)
    apart = values[:, 0] - values[:, 1] > 1e-2  # else the first direction is any of several
    assert np.allclose(maps[apart, 6], radial[apart], rtol=1e-6, atol=1e-6) and apart.sum() > 50
    first = diffusion.tensor_maps(d)[:, 6:9]
    axial = [diffusion.along(f[None], v[None])[1][0, 0] for f, v in zip(fit, first, strict=True)]
    assert np.allclose(maps[:, 5], axial)
    flat = fit[:3].copy()
    flat[:, :6] = [1, 1, -0.1, 0, 0, 0]
    assert np.isfinite(diffusion.kurtosis_maps(flat)).all() and diffusion.kurtosis_maps(fit[:0]).shape == (0, 7)


def test_p_values_of_columns(spark):
    from pyspark.sql import functions as F

    z = [0.0, 1e-9, -0.3, 1.959963984540054, 5.0, -12.0, 40.0, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double")
    got = {r["i"]: (r["p"], r["q"]) for r in df.select("i", fx.upper_tail(F.col("z")).alias("p"), fx.correlation_p(F.col("z"), 12).alias("q")).collect()}
    for i, v in enumerate(z[:-1]):
        assert got[i][0] == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=1e-10, abs=1e-300)
        assert got[i][1] == pytest.approx(math.erfc(abs(v) * 3 / math.sqrt(2)), rel=1e-10, abs=1e-300)
    assert got[len(z) - 1][0] is None or math.isnan(got[len(z) - 1][0])
