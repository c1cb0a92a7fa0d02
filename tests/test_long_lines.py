"""Filters on long lines."""

import time

import numpy as np
import pytest

from voxelweave.operators import filters


@pytest.mark.parametrize("n", [65, 300])
def test_envelope_of_a_long_line_is_that_of_all_pairs(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.02, 0.5, 1.0):
        at = np.sort(rng.integers(-2 * n, 2 * n, n)).astype(float) * 0.5  # some places twice
        d = np.where(rng.random(n) < share, rng.integers(0, n * n, n).astype(float), np.inf)
        assert np.array_equal(filters.lower_envelope(at, d), ((at[:, None] - at) ** 2 + d).min(axis=1))


def test_distance_along_a_line_of_200000_voxels(spark):
    n = 200_000  # all pairs of one line would be 4e10
    mask = spark.range(n).selectExpr("0 AS x", "0 AS y", "CAST(id AS INT) AS z", "CAST(id % 1000 = 0 AS INT) AS value")
    began = time.time()
    got = {r["z"]: r["distance"] for r in filters.distance_map(mask).filter("z % 777 = 0").collect()}
    assert got == {z: (-1.0 if z % 1000 == 0 else float(min(z % 1000, 1000 - z % 1000 if z < n - 1000 else z % 1000))) for z in range(0, n, 777)}
    assert time.time() - began < 60
