"""Curvature diffusion in closed form."""

import numpy as np
import pytest

from voxelweave.operators import curvature


def grid(spark, v):
    rows = [(int(x), int(y), int(z), float(v[x, y, z])) for x, y, z in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, value double")


def cube(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r["value"]
    return out


def test_a_ramp_stays_and_spheres_shrink(spark):
    x, y, z = np.mgrid[0:9, 0:8, 0:7].astype(float)
    ramp = 2 * x + 3 * y - z
    inner = (slice(2, -2),) * 3
    assert np.allclose(cube(curvature.curvature_diffusion(grid(spark, ramp), 1), ramp.shape)[inner], ramp[inner])
    x, y, z = np.mgrid[-8:9, -8:9, -8:9].astype(float)
    r = np.sqrt(x * x + y * y + z * z)
    after = cube(curvature.curvature_diffusion(grid(spark, r), 1, 0.05, 1e3), r.shape)
    shell = (r > 4) & (np.maximum(np.maximum(abs(x), abs(y)), abs(z)) < 7)
    # Without edges to keep, f changes by step times the sum of the curvatures, 2 / r; the upwind
    # gradient is of first order, and too steep by up to h / (2 r) where r is convex.
    excess = (after - r)[shell] / 0.05 / (2 / r[shell]) - 1
    assert excess.min() > -0.02 and excess.max() < 0.12


def test_edges_stay_and_noise_goes(spark):
    rng = np.random.default_rng(0)
    step = np.zeros((8, 6, 3))
    step[4:] = 100
    noisy = step + rng.normal(0, 1, step.shape)
    after = cube(curvature.curvature_diffusion(grid(spark, noisy), 4, conductance=1.0), step.shape)
    assert after[:3].std() < 0.8 * noisy[:3].std() and after[5:].mean() - after[:3].mean() == pytest.approx(100, abs=1)
    flat = grid(spark, np.ones((3, 3, 1)))
    assert {r["value"] for r in curvature.curvature_diffusion(flat, 2).collect()} == {1.0}
    assert curvature.curvature_diffusion(flat.limit(0), 1).count() == 0
