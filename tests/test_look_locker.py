"""From Look-Locker traces to T1 maps, and lines given twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import fits, kspace


def lines_of_image(image):
    return np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(image)))


def scan(slices, echoes, n, t1, first, step, scale):
    """Traces of one scan: a square with its own T1 in each slice, signs lost by the magnitude."""
    k = np.zeros((n, echoes, slices, n), complex)
    for s in range(slices):
        for e in range(echoes):
            image = np.zeros((n, n))
            image[2:5, 1:4] = scale * (1 - 2 * np.exp(-(first + (s + e * slices) * step) / t1[s]))
            k[:, e, s] = lines_of_image(image)
    return k.reshape(n * echoes * slices, n)


def test_t1_is_recovered_in_every_slice(spark):
    slices, echoes, n, first, step = 3, 24, 6, 0.03, 0.04
    t1, positions = [0.5, 0.8, 1.1], [0.2, 0.0, 0.1]
    k = np.stack([scan(slices, echoes, n, t1, first, step, a) for a in (100, 300)])
    rows = [("f", b, t, k[b, t].real.tolist(), k[b, t].imag.tolist()) for b in range(2) for t in range(k.shape[1])]
    images = kspace.look_locker(spark.createDataFrame(rows, kspace.TRACE), slices, echoes, positions)
    got = {(r["scan"], r["z"], r["y"], r["x"]): r for r in fits.look_locker_maps(images, slices, first, step).collect()}
    assert len(got) == 2 * slices * n * n
    for b, a in ((0, 100), (1, 300)):
        for z, s in enumerate([1, 2, 0]):  # slices by position
            for y, x in np.ndindex(n, n):
                r = got[b, z, y, x]
                if 2 <= y < 5 and 1 <= x < 4:
                    assert r["t1"] == pytest.approx(t1[s], rel=0.03) and r["a"] == pytest.approx(a, rel=0.03) and r["r2"] > 0.99
    cut = fits.look_locker_maps(images, slices, first, step, max_t1=0.6)
    assert cut.agg(F.max("t1")).first()[0] <= 0.6
    assert fits.look_locker_maps(images.limit(0), slices, first, step).count() == 0


def test_own_times_give_what_common_times_give(spark):
    t = np.arange(1, 31) * 0.1
    y = [(900 * (1 - 1.8 * np.exp(-t / x))).tolist() for x in (0.4, 0.9)]
    rows = spark.createDataFrame([(i, v, t.tolist()) for i, v in enumerate(y)], "voxel_id long, series array<double>, times array<double>")
    assert fits.t1_fit(rows, None, "look_locker").collect() == fits.t1_fit(rows, t.tolist(), "look_locker").collect()


def test_lines_given_twice(spark):
    rows = [("f", b, t, [float(10 * b + t)] * 2, [0.0] * 2) for b in (1, 0) for t in (1, 0)]
    lines = kspace.lines_of(spark.createDataFrame(rows, kspace.TRACE), F.lit(0), F.col("trace"))
    last = kspace.reconstruct(lines.filter("block = 1")).orderBy("y", "x").collect()
    assert kspace.reconstruct(lines).orderBy("y", "x").collect() == last
    for bad in (lines.drop("block", "trace"), lines.unionAll(lines)):
        with pytest.raises(Exception, match="has a line twice"):
            kspace.reconstruct(bad).collect()
