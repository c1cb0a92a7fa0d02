"""Exact neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import neighbours

SCHEMA = "id long, features array<double>, label int, extra string"


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(a) for a in r], int(i % 3) if labels is None else labels[i], "e") for i, r in enumerate(x)], SCHEMA)


def blobs(n=900, d=6, groups=9, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=20, size=(groups, d))
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, d))


def brute(x, queries, k):
    out = {}
    for q in queries:
        d = np.cumsum((x - x[q]) ** 2, axis=1)[:, -1]
        out[q] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def nearest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["near"], r["d2"]))
    return out


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_knn_equals_brute_force(spark, block):
    x = blobs()
    x[100:160] = x[100]  # a group of equal rows, larger than a ring
    t = table(spark, x)
    rows = neighbours.knn(t, t.filter("id % 20 = 0"), 7, block).collect()
    got, want = nearest(rows), brute(x, range(0, 900, 20), 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], rel=1e-12)
    assert all(r["label"] == r["near"] % 3 for r in rows)


def test_radius_equals_brute_force(spark):
    x = blobs(seed=2)
    t = table(spark, x)
    pairs = {(q, int(i)) for q in range(0, 900, 20) for i in np.nonzero(((x - x[q]) ** 2).sum(axis=1) <= 9.0)[0]}
    for block in (16, 4096):
        found = neighbours.within_radius(t, t.filter("id % 20 = 0"), 3.0, block=block).collect()
        assert len(found) == len(pairs) and {(r["id"], r["near"]) for r in found} == pairs
    two = neighbours.within_radius(t, t.filter("id = 0"), 3.0, k=2, block=16).collect()
    assert [r["near"] for r in sorted(two, key=lambda r: (r["d2"], r["near"]))] == [i for i, _ in brute(x, [0], 2)[0]]


def test_clustered_rows_meet_few_rings(spark):
    x = blobs(seed=3)
    t = table(spark, x)
    index = neighbours.build(t, 16)
    q = neighbours.asked(t.filter("id % 20 = 0")).withColumn("radius", F.lit(3.0))
    met = neighbours.meetings(index, q).groupBy("ring").count().collect()
    compared = sum(r["count"] * int(index.n[r["ring"]]) for r in met)
    assert index.n.sum() == 900 and compared < 0.3 * 45 * 900


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0], None, "a"), (2, [0.0, 0.0], 4, None), (3, None, 1, "a"), (4, [float("nan"), 1.0], 1, "a"), (5, [None, 1.0], 1, "a"), (6, [3.0, 4.0], 2, "a"), (None, [1.0, 1.0], 2, "a")]
    t = spark.createDataFrame(rows, SCHEMA)
    for block in (1, 4096):
        got = {(r["id"], r["rank"]): (r["near"], r["label"], r["d2"]) for r in neighbours.knn(t, t, 2, block).collect()}
        assert got == {(1, 1): (1, None, 0.0), (1, 2): (2, 4, 0.0), (2, 1): (1, None, 0.0), (2, 2): (2, 4, 0.0), (6, 1): (6, 2, 0.0), (6, 2): (1, None, 25.0)}
        assert {(r["id"], r["near"]) for r in neighbours.within_radius(t, t, 5.0, block=block).collect()} == {(a, b) for a in (1, 2, 6) for b in (1, 2, 6)}
    none = t.filter("id > 99")
    assert neighbours.knn(none, t, 2).count() == neighbours.knn(t, none, 2).count() == neighbours.within_radius(none, t, 1.0).count() == 0
    assert neighbours.knn(t, t, 9, 1).count() == 9
