"""Watershed against a flood in plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import watershed as ws


def flood(h, level, threshold):
    """Labels by sorted union of basins; ``h`` maps (x, y) to heights."""
    lo, hi = min(h.values()), max(h.values())
    depth = level * (hi - lo)
    h = {p: max(v, lo + threshold * (hi - lo)) for p, v in h.items()}
    key = lambda p: (h[p], p[1], p[0])
    near = lambda p: [q for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if q in h]
    root = {}
    for p in sorted(h, key=key):
        q = min([p, *near(p)], key=key)
        root[p] = p if q == p else root[q]
    number = lambda p: (p[1], p[0])
    saddles = {}
    for p in h:
        for q in near(p):
            if root[p] != root[q]:
                pair = tuple(sorted((root[p], root[q]), key=number))
                saddles[pair] = min(saddles.get(pair, np.inf), max(h[p], h[q]))
    whole, kept = ({p: p for p in h} for _ in range(2))

    def find(t, p):
        while t[p] != p:
            p = t[p]
        return p

    for (a, b), s in sorted(saddles.items(), key=lambda x: (x[1], number(x[0][0]), number(x[0][1]))):
        one, two = sorted((find(whole, a), find(whole, b)), key=key)
        if one == two:
            continue
        whole[two] = one
        if s - h[two] <= depth:
            c, d = sorted((find(kept, a), find(kept, b)), key=key)
            kept[d] = c
    return {p: find(kept, root[p]) for p in h}


def labels_of(df):
    unpack = lambda n: ((n & (1 << ws.BITS) - 1) - ws.OFFSET, (n >> ws.BITS & (1 << ws.BITS) - 1) - ws.OFFSET)
    return {(r["z"], r["x"], r["y"]): unpack(r["label"]) for r in df.collect()}


@pytest.mark.parametrize(("level", "threshold"), [(0.0, 0.0), (0.15, 0.0), (0.4, 0.2), (1.0, 0.0)])
def test_basins_equal_a_flood(spark, level, threshold):
    rng = np.random.default_rng(7)
    slices = {0: rng.random((14, 11)), 1: rng.integers(0, 4, (12, 12)) / 2, 2: np.ones((3, 4)), -3: np.add.outer(np.sin(np.arange(20)), np.cos(np.arange(9) * 1.3))}
    heights = {z: {(int(x) - 2, int(y)): float(v[x, y]) for x, y in np.ndindex(v.shape)} for z, v in slices.items()}
    heights[1] = {p: v for p, v in heights[1].items() if (p[0] * p[1]) % 7 != 3}  # with holes
    rows = [(z, *p, v) for z, h in heights.items() for p, v in h.items()]
    df = spark.createDataFrame(rows + rows[:5] + [(0, 50, 50, None)], "z int, x int, y int, value double").repartition(3)
    got = labels_of(ws.watershed(df, level, threshold))
    want = {(z, *p): q for z, h in heights.items() for p, q in flood(h, level, threshold).items()}
    assert got == want
    assert len({q for p, q in want.items() if p[0] == 2}) == 1  # a plateau is one basin
    if level == 1:
        assert len({q for p, q in want.items() if p[0] == 0}) == 1


def test_gradient_and_diffusion_have_their_closed_forms(spark):
    x, y = (a.ravel().tolist() for a in np.mgrid[0:7, 0:6])
    ramp = spark.createDataFrame([(0, a, b, 2.0 * a, 3.0 * b, 0.0) for a, b in zip(x, y, strict=True)], "z int, x int, y int, r double, g double, b double")
    inside = "x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 4"
    got = [{round(r["value"], 9) for r in ws.colour_gradient(ramp, ["r", "g", "b"], p).filter(inside).collect()} for p in (False, True)]
    assert got == [{round(np.sqrt(13.0), 9)}, {round(np.sqrt(5.0), 9)}]  # eigenvalues 4 and 9
    still = ws.vector_diffusion(ramp, ["r", "g", "b"], 1).filter("x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 3").collect()
    assert all(abs(r["r"] - 2 * r["x"]) < 1e-12 and abs(r["g"] - 3 * r["y"]) < 1e-12 for r in still)
    # One bright pixel: the slopes around it are half of it, so m^2 = 4 * (v / 2)^2 / n.
    spot = spark.createDataFrame([(0, a, b, 8.0 if (a, b) == (3, 3) else 0.0) for a, b in zip(x, y, strict=True)], "z int, x int, y int, r double")
    near = {(r["x"], r["y"]): r["r"] for r in ws.vector_diffusion(spot, ["r"], 1, 0.125, 2.0).collect()}
    moved = 0.125 * 8.0 * np.exp(-64 / (2 * 4 * (4 * 16 / 42)))
    assert near[3, 3] == pytest.approx(8 - 4 * moved) and near[2, 3] == pytest.approx(moved) and near[0, 0] == 0


def test_colour_patches_become_labels(spark):
    colour = {(0, 0): (9, 1, 1), (0, 1): (1, 9, 1), (1, 0): (1, 1, 9), (1, 1): (9, 9, 9)}
    rows = [(z, x, y, *(float(c) for c in colour[x // 8, y // 8])) for z, x, y in itertools.product(range(2), range(16), range(16))]
    df = spark.createDataFrame(rows, "z int, x int, y int, r double, g double, b double")
    got = labels_of(ws.watershed_labels(df, ["r", "g", "b"], level=0.2, principal=False))
    for z in range(2):
        inner = {(x // 8, y // 8): {got[z, x + i, y + j] for i in range(6) for j in range(6)} for x in (1, 9) for y in (1, 9)}
        assert all(len(v) == 1 for v in inner.values()) and len(set.union(*inner.values())) == 4
    assert ws.watershed_labels(df.limit(0), ["r", "g", "b"]).count() == 0
    assert df.select(F.max("z")).first()[0] == 1
