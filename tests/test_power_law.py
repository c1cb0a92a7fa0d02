"""Power laws against all candidates times all values in NumPy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import power_law as pl


def brute(x, discrete, grid=pl.GRID, small=True):
    x = np.sort(np.asarray(x, float))
    steps = np.round(np.arange(grid[0], grid[2] + grid[1] / 2, grid[1]), 10)
    best = None
    for xmin in np.unique(x)[:-1]:
        z = x[x >= xmin]
        n, logs = len(z), np.log(z).sum()
        if discrete:
            span = np.arange(xmin, z[-1] + 1)
            zeta = np.array([pl.hurwitz(a, xmin) for a in steps])
            alpha = steps[np.argmax(-steps * logs - n * np.log(zeta))]
            fit = np.cumsum(span**-alpha) / pl.hurwitz(alpha, xmin)
            have = np.searchsorted(z, span, side="right") / n
            ks, top = np.abs(fit - have).max(), -alpha * logs - n * np.log(pl.hurwitz(alpha, xmin))
        else:
            alpha = 1 + n / (logs - n * np.log(xmin))
            fit = 1 - (z / xmin) ** (1 - alpha)
            ks = max(np.abs(fit - np.searchsorted(z, z, side=s) / n).max() for s in ("left", "right"))
            top = n * np.log((alpha - 1) / xmin) - alpha * (np.log(z) - np.log(xmin)).sum()
        if not small and (alpha - 1) / np.sqrt(n) > 0.1:
            break
        best = min(best or (ks, xmin, alpha, top, n), (ks, xmin, alpha, top, n))
    return best


def fitted(spark, x, **options):
    df = spark.createDataFrame([(float(v),) for v in x], "value double").repartition(3)
    return [(r["ks"], r["xmin"], r["alpha"], r["log_likelihood"], r["n"]) for r in pl.power_law(df, **options).collect()]


def test_zeta_has_its_known_values():
    assert pl.hurwitz(2.0, 1.0) == pytest.approx(np.pi**2 / 6, rel=1e-14) and pl.hurwitz(4.0, 1.0) == pytest.approx(np.pi**4 / 90, rel=1e-14)
    assert pl.hurwitz(1.5, 1.0) == pytest.approx(2.6123753486854883, rel=1e-13) and pl.hurwitz(3.0, 0.5) == pytest.approx(7 * 1.2020569031595942, rel=1e-13)
    q = np.array([1.0, 7.0, 1e6])
    assert np.allclose(pl.hurwitz(2.3, q) - pl.hurwitz(2.3, q + 1), q**-2.3, rtol=1e-6, atol=1e-16)


@pytest.mark.parametrize("seed", [1, 2])
def test_fits_equal_all_candidates_times_all_values(spark, monkeypatch, seed):
    monkeypatch.setattr(pl, "BATCH", 3)
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.floor((1 - rng.random(1500)) ** (-1 / 1.4) * 6 + 0.5), rng.integers(1, 9, 400)])
    for options in ({}, {"small": False}):
        assert fitted(spark, x, **options) == [pytest.approx(brute(x, True, **options), rel=1e-9)]
    y = np.concatenate([(1 - rng.random(700)) ** (-1 / 1.4) * 6, rng.random(300) * 8])
    assert fitted(spark, y) == [pytest.approx(brute(y, False), rel=1e-9)]
    assert fitted(spark, x, discrete=False) == [pytest.approx(brute(x, False), rel=1e-9)]
    n, alpha = brute(x, True)[4], brute(x, True)[2]
    assert fitted(spark, x, finite_size=True)[0][2] == pytest.approx(alpha * (n - 1) / n + 1 / n)


def test_values_without_a_law(spark):
    assert fitted(spark, []) == fitted(spark, [3.0] * 5) == fitted(spark, [0.0, -1.0, 4.0, float("inf")]) == []
    assert len(fitted(spark, [1.0, 2.0])) == 1


def test_many_distinct_values_take_no_quadratic_join(spark):
    df = spark.range(300_000).selectExpr("floor(pow(1 - (id + 0.5) / 300000, -1 / 1.5D) * 1000) AS value")
    got = pl.power_law(df).first()
    assert abs(got["alpha"] - 2.5) < 0.02 and got["ks"] < 0.002


def test_values_close_together_take_few_passes(spark, monkeypatch):
    """All of them lie within a 64th of a doubling, where blocks of values would tell none apart."""
    asked, exact = [], pl.distances
    monkeypatch.setattr(pl, "distances", lambda v, some, discrete: asked.append(len(some)) or exact(v, some, discrete))
    x = 1000 + 10 * np.random.default_rng(7).random(2000)
    assert fitted(spark, x) == [pytest.approx(brute(x, False), rel=1e-9)]
    assert len(asked) <= 3


def test_bootstrap_fits_every_sample_anew(spark):
    rng = np.random.default_rng(5)
    x = np.floor((1 - rng.random(3000)) ** (-1 / 1.5) * 3 + 0.5)
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    got = pl.power_law_bootstrap(df, 12).first()
    one = pl.resampled(df, 12, 1).toPandas()
    assert sorted(one["sample"].unique()) == list(range(12)) and abs(one["c"].sum() / 12 - 3000) < 100
    own = [brute(np.repeat(g["value"].to_numpy(), g["c"].to_numpy()), True) for _, g in one.groupby("sample")]
    assert got["samples"] == 12 and got["sd_xmin"] == pytest.approx(np.std([x[1] for x in own], ddof=1))
    assert got["mean_alpha"] == pytest.approx(np.mean([x[2] for x in own])) and got["sd_alpha"] == pytest.approx(np.std([x[2] for x in own], ddof=1))


def test_suffix_sums_of_many_values_in_one_block_take_one_pass(spark):
    """A frame from the row to the end was summed anew for each row: 80,000 values of a block took minutes."""
    df = spark.range(80_000).selectExpr("0 AS sample", "400000.0D + id / 100.0D AS value", "1L AS c")
    began = time.time()
    got = pl.suffix_sums(df).agg(F.min("n"), F.max("n"), F.sum("n"), F.max("logs")).first()
    want = np.log(400000.0 + np.arange(80_000) / 100).sum()
    assert tuple(got) == (1, 80_000, 80_000 * 80_001 // 2, pytest.approx(want, rel=1e-9))
    assert time.time() - began < 20


def test_few_candidates_are_bounded_by_all_blocks(spark, monkeypatch):
    seen, plain = [], pl.bounded

    def spied(rows, ends, discrete, few=False):
        seen.append((few, rows.count()))
        return plain(rows, ends, discrete, few)

    monkeypatch.setattr(pl, "bounded", spied)
    y = np.random.default_rng(3).random(4000) * 1e5 + 1000
    assert fitted(spark, y) == [pytest.approx(brute(y, False), rel=1e-9)]
    assert seen[0] == (True, 3999) and all(n < 2000 for few, n in seen[1:] if not few), seen
