import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, uid string, q int"


def brute(rows, every, low=hn.LOW, high=hn.HIGH):
    good = [(v, y, [math.floor(256 * float(np.float32(x))) for x in e]) for v, y, e in rows if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    best = lambda found: sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    for i, (v, y, q) in enumerate(good):
        if v is None or v % every:
            continue
        score = [(w, dot(q, r), z) for j, (w, z, r) in enumerate(good) if j != i]
        for p, s, _ in best(x for x in score if x[2] == y)[: hn.POSITIVES]:
            hard = best(x for x in score if x[2] != y and low * s <= 100 * x[1] <= high * s)[: hn.NEGATIVES]
            yield from ((v, p, k + 1, n, s, t) for k, (n, t, _) in enumerate(hard))


def mined(spark, rows, every):
    df = spark.createDataFrame([(*x, "u", 0) for x in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % every == 0)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize(("tree", "leaf"), [(4096, 64), (20, 4)])
def test_random_vectors_against_all_pairs(spark, monkeypatch, tree, leaf):
    monkeypatch.setattr(hn, "TREE", tree)
    monkeypatch.setattr(hn, "ANCHORS", leaf)
    rng = np.random.default_rng(leaf)
    rows = [(i, int(rng.integers(0, 4)), (rng.integers(-3, 4, 5) / 100).tolist()) for i in range(240)]  # many ties
    rows += [(i, int(rng.integers(0, 2)), rng.normal(size=5).tolist()) for i in range(240, 400)]
    rows += [(400 + i, i % 3, [0.25] * 5) for i in range(120)] + [(700 + i, 7, [-1.0] + [0.0] * 4) for i in range(3)]
    want = sorted(brute(rows, 9), key=str)
    assert len(want) > 100 and mined(spark, rows, 9) == want


def test_odd_rows(spark):
    one = [0.5, 0.25]
    rows = [
        (0, 1, one), (0, 1, one), (None, 1, one), (7, 1, [0.5]), (8, 2, [0.4, 0.2]), (8, 2, [0.4, 0.2]), (None, 2, [0.4, 0.2]), (9, 3, [0.3, 0.3, 9.0]),
        (10, None, one), (11, 1, None), (20, 1, [None, 1.0]), (30, 2, [float("nan"), 1.0]), (40, 2, [float("inf"), 1.0]), (50, 3, []), (60, 3, [0.0, -0.1]),
    ]
    assert mined(spark, rows, 10) == sorted(brute(rows, 10), key=str) != []
    assert mined(spark, [], 10) == [] and mined(spark, [(0, 1, one)], 10) == [] and mined(spark, [(1, 1, []), (2, 2, [])], 1) == []
    large = [(i, i % 2, [float(2**40 + i * 2**20), 1.0]) for i in range(0, 8)]
    got = mined(spark, large, 4)
    assert all(r[4] == (1 << 63) - 1 for r in got)


def test_walk_prunes_but_loses_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 50
    q = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 8)))
    order, balls = hn.split_balls(q, 16)
    first, last, left, right, centre, radius = (np.array(x) for x in zip(*balls, strict=True))
    asked = np.floor(centres[:5] + 1)
    looked = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            looked.append(key)
            return np.ndarray.__getitem__(self, key)

    i, j, s = hn.walk(asked, np.arange(5), np.full(5, -np.inf), np.full(5, np.inf), q[order].view(Seen), dict(first=first, last=last, left=left, right=right, centre=centre, radius=radius), 3)
    for k in range(5):
        assert sorted(s[i == k].tolist())[-3:] == np.sort(q @ asked[k])[-3:].tolist()
    assert len([x for x in looked if isinstance(x, slice)]) < 0.7 * (left < 0).sum()
