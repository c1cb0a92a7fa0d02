"""Pair matrices in large blocks and tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import connectivity


def test_tiles_equal_numpy_and_rows_are_sent_seldom(spark, monkeypatch):
    monkeypatch.setattr(connectivity, "TILE", 7)
    x = np.random.default_rng(1).normal(size=(60, 5))
    x[9] = 1.0
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "voxel_id long, series array<double>")
    want = np.linalg.norm(x[:, None] - x[None], axis=2)
    for numbers in (1 << 20, 100):  # one to eight blocks, then three at least
        monkeypatch.setattr(connectivity, "NUMBERS", numbers)
        got = connectivity.distance_matrix(df).collect()
        assert len(got) == 60 * 59 // 2 == len({(r["i"], r["j"]) for r in got})
        assert all(r["i"] < r["j"] and r["value"] == pytest.approx(want[r["i"] // 3, r["j"] // 3], abs=1e-6) for r in got)
    assert connectivity.correlation_matrix(df.limit(0)).count() == 0
    nan = connectivity.correlation_matrix(df).filter(F.isnan("value"))
    assert nan.count() == 59


def test_large_tables_make_few_blocks(spark, monkeypatch):
    """Rows of 20,000 series were sent to 79 blocks each."""
    sent = []
    plain = connectivity.F.sequence
    monkeypatch.setattr(connectivity.F, "sequence", lambda a, b: sent.append(b) or plain(a, b))
    df = spark.range(20_000).selectExpr("id AS voxel_id", "array(1.0D, 2.0D) AS series")
    connectivity.correlation_matrix(df, 2.0)
    assert int(str(sent[0]).split("'")[1]) + 1 == 8
