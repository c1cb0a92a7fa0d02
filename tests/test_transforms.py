"""Splines, their Jacobians and inverses, pyramids and tensor images in closed form."""

import math

import numpy as np
import pytest

from voxelweave.operators import filters, pyramid, tensors, transforms
from voxelweave.operators.transforms import Chain, Inverse, Spline

SPACING, ORIGIN = (2.0, 2.5, 3.0), (-3.0, -4.0, -5.0)


def cubic(t):
    t = abs(t)
    return (4 - 6 * t * t + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


@pytest.fixture(scope="module")
def numbers():
    return np.random.default_rng(3).normal(0, 0.25, (7, 7, 7, 3))


@pytest.fixture(scope="module")
def spline(spark, numbers):
    rows = [(i, j, k, *map(float, numbers[i, j, k])) for i, j, k in np.ndindex(7, 7, 7)]
    return Spline(spark.createDataFrame(rows, "i int, j int, k int, cx double, cy double, cz double"), SPACING, ORIGIN)


def at(numbers, p):
    place = [(x - o) / s for x, o, s in zip(p, ORIGIN, SPACING, strict=True)]
    w = [np.array([cubic(v - i) for i in range(7)]) for v in place]
    return np.asarray(p) + np.einsum("i,j,k,ijkc->c", *w, numbers)


def points(spark, rows):
    return spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(rows)], "n int, px double, py double, pz double")


def run(spark, rows, transform):
    got = transforms.moved(points(spark, rows), ["n"], transform).orderBy("n").collect()
    return np.array([[r["px"], r["py"], r["pz"]] for r in got]), np.array([r["jac"] for r in got]).reshape(-1, 3, 3)


INNER = [(0.0, 0.0, 0.0), (1.3, -0.4, 2.2), (4.9, 4.0, 5.5), (-0.9, -1.4, -1.9)]


def test_spline_and_its_jacobian(spark, spline, numbers):
    to, jac = run(spark, [*INNER, (50.0, 0.0, 0.0)], spline)
    assert np.allclose(to[:4], [at(numbers, p) for p in INNER]) and to[4].tolist() == [50, 0, 0] and np.array_equal(jac[4], np.eye(3))
    h = 1e-5
    for p, j in zip(INNER, jac, strict=False):
        want = np.stack([(at(numbers, np.add(p, h * e)) - at(numbers, np.subtract(p, h * e))) / (2 * h) for e in np.eye(3)], axis=1)
        assert np.allclose(j, want, atol=1e-8)


def test_inverse_chains_and_sums(spark, spline, numbers):
    turn = filters.Affine.similarity(1.1, (0, 0, 1), 0.3, (0.5, 0, 0))
    to, jac = run(spark, INNER[:2], spline)
    back, inverse = run(spark, to, Inverse(spline, 1e-10))
    assert np.allclose(back, INNER[:2], atol=1e-8) and np.allclose(inverse @ jac, np.eye(3), atol=1e-6)
    both, j = run(spark, INNER[:2], Chain([spline, turn]))
    assert np.allclose(both, to @ turn.matrix.T + turn.offset) and np.allclose(j, turn.matrix @ jac)
    total, j = run(spark, INNER[:2], Chain([spline, turn], add=True))
    assert np.allclose(total, to + np.array(INNER[:2]) @ (turn.matrix - np.eye(3)).T + turn.offset) and np.allclose(j, jac + turn.matrix - np.eye(3))
    undone, j = run(spark, INNER[:2], Chain([turn, Inverse(turn)]))
    assert np.allclose(undone, INNER[:2]) and np.allclose(j, np.eye(3))
    fold = Spline(spline.control.selectExpr("i", "j", "k", "cx * 60 AS cx", "cy", "cz"), SPACING, ORIGIN)
    with pytest.raises(ValueError):
        run(spark, INNER[:2], Inverse(fold, 1e-10, 3))


def test_parameter_files(spark, numbers):
    values = " ".join(str(numbers[i, j, k, c]) for c in range(3) for k in range(7) for j in range(7) for i in range(7))
    own = '(Transform "BSplineTransform")\n(GridSize 7 7 7)\n(GridSpacing 2 2.5 3)\n(GridOrigin -3 -4 -5)\n(GridIndex 0 0 0)\n(BSplineTransformSplineOrder 3)\n'
    files = {
        "first": '(Transform "AffineTransform")\n(TransformParameters 1 0 0 0 1 0 0 0 1 0.5 0 0)\n',
        "plain": f"{own}(TransformParameters {values})\n",
        "after": f'{own}(TransformParameters {values})\n(InitialTransformParametersFileName "first")\n(HowToCombineTransforms "Compose")\n',
    }
    read = lambda *names: run(spark, INNER[:1], transforms.read_transforms(spark, list(names), files.get))[0][0]
    assert np.allclose(read("plain"), at(numbers, INNER[0])) and np.allclose(read("after"), at(numbers, (0.5, 0, 0)))
    assert np.allclose(read("+s", "after"), at(numbers, INNER[0])) and np.allclose(read("first", "+i", "first"), INNER[0])
    assert np.allclose(read("plain", "+a", "first"), at(numbers, INNER[0]) + [0.5, 0, 0]) and np.allclose(read("plain", "first"), at(numbers, INNER[0]) + [0.5, 0, 0])


def grid(spark, v):
    rows = [(int(x), int(y), int(z), float(v[x, y, z])) for x, y, z in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, value double")


def test_deformation_and_resampling(spark, spline, numbers):
    g = grid(spark, np.zeros((3, 2, 2)))
    for r in transforms.deformation(g, spline).collect():
        p = (r["x"], r["y"], r["z"])
        assert np.allclose([r["mx"], r["my"], r["mz"]], at(numbers, p)) and np.allclose([r["dx"], r["dy"], r["dz"]], at(numbers, p) - p)
        step = np.stack([(at(numbers, np.add(p, 1e-5 * e)) - at(numbers, np.subtract(p, 1e-5 * e))) / 2e-5 for e in np.eye(3)], axis=1)
        assert r["jacobian"] == pytest.approx(np.linalg.det(step), abs=1e-7)
    x, y, z = np.mgrid[0:12, 0:12, 0:8]
    wave = lambda x, y, z: np.sin(0.5 * x) + np.cos(0.4 * y) * np.sin(0.6 * z + 1)
    image, shift = grid(spark, wave(x, y, z)), filters.Affine(np.eye(3), (0.3, 0.6, 0.45))
    some = grid(spark, np.zeros((7, 7, 4))).selectExpr("x + 3 AS x", "y + 3 AS y", "z + 2 AS z")
    linear = {(r["x"], r["y"], r["z"]): r["value"] for r in filters.resampled(image, some, shift).collect()}
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in transforms.resampled(image, some, shift).collect()} == {k: pytest.approx(v) for k, v in linear.items()}
    for kernel in transforms.WINDOWS:
        for r in transforms.resampled(image, some, shift, kernel=kernel).collect():
            assert abs(r["value"] - wave(r["x"] + 0.3, r["y"] + 0.6, r["z"] + 0.45)) < 0.05
    assert {r["value"] for r in transforms.resampled(image, some, filters.Affine(np.eye(3), (90, 0, 0)), kernel="nearest", outside=-1.0).collect()} == {-1.0}


def field(spark, d, shape=(6, 6, 6)):
    rows = [(x, y, z, *(float(d[i][j]) for i, j in tensors.SIX)) for x, y, z in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, " + ", ".join(f"{e} double" for e in tensors.ELEMENTS))


def element(r):
    return tensors.matrices(np.array([[r[e] for e in tensors.ELEMENTS]]))[0]


def test_tensors_under_a_shear(spark):
    a = 0.75
    shear = filters.Affine([[1, a, 0], [0, 1, 0], [0, 0, 1]])  # takes grid places to the image
    f = np.linalg.inv(shear.matrix)
    d = np.diag([1.0, 3.0, 2.0])  # the first direction is y, the second z
    inner = spark.createDataFrame([(1, 1, 1), (2, 2, 3)], "x int, y int, z int")
    one = f @ [0, 1, 0] / np.linalg.norm(f @ [0, 1, 0])
    two = np.array([0, 0, 1.0])
    want = 3 * np.outer(one, one) + 2 * np.outer(two, two) + np.outer(np.cross(one, two), np.cross(one, two))
    for kernel in ("linear", "nearest", "lanczos"):
        for r in tensors.warped(field(spark, d), inner, shear, kernel=kernel).collect():
            assert np.allclose(element(r), want)
    u, _, v = np.linalg.svd(f)
    for r in tensors.warped(field(spark, d), inner, shear, directions="fs").collect():
        assert np.allclose(element(r), u @ v @ d @ (u @ v).T)
    turn = filters.Affine.similarity(1.0, (1, 2, 3), 0.4)
    for method in ("ppd", "fs"):
        r = tensors.warped(field(spark, d), spark.createDataFrame([(2, 2, 2)], "x int, y int, z int"), turn, directions=method).first()
        assert np.allclose(element(r), turn.matrix.T @ d @ turn.matrix)
    out = tensors.warped(field(spark, d), spark.createDataFrame([(90, 0, 0)], "x int, y int, z int"), shear).first()
    assert out["dxx"] is None


def test_corrections_of_tensors():
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 3)))
    d = (q * [2.0, 1.0, -0.5]) @ q.T
    eig = lambda m: np.linalg.eigvalsh(tensors.corrected(d[None], m)[0]).tolist()
    assert eig("none") == pytest.approx([-0.5, 1, 2]) and eig("abs") == pytest.approx([0.5, 1, 2])
    assert eig("zero") == pytest.approx([0, 1, 2], abs=1e-12) == eig("nearest")


def test_halves_are_least_squares_splines(spark):
    rng = np.random.default_rng(2)
    for n in (17, 16, 5, 2):
        v = rng.normal(size=n)
        reps = 12 if n > 3 else 40
        full = np.tile(np.concatenate([v, v[-2:0:-1]]), reps)
        size, fine = len(full), 12
        around = lambda a, b: (a - b + size / 2) % size - size / 2  # noqa: E731, B023
        basis = np.vectorize(cubic)
        c = np.linalg.solve(basis(around(np.arange(size)[:, None], np.arange(size))), full)
        t = np.arange(size * fine) / fine
        dense = basis(around(t[:, None], np.arange(size))) @ c
        d = np.linalg.lstsq(basis(around(t[:, None], 2 * np.arange(size // 2)) / 2), dense, rcond=None)[0]
        want = [(4 * d[k] + d[k - 1] + d[(k + 1) % len(d)]) / 6 for k in range((n + 1) // 2)]
        assert np.allclose(pyramid.halved_lines(v[None])[0], want, atol=1e-6)
    x, y = np.mgrid[0:160, 0:3]
    u = (x - 80) / 30
    got = pyramid.halved(grid(spark, (u**3 - 2 * u**2 + y)[:, :, None]), "x").collect()
    assert len(got) == 240
    assert all(r["value"] == pytest.approx(((2 * r["x"] - 80) / 30) ** 3 - 2 * ((2 * r["x"] - 80) / 30) ** 2 + r["y"], abs=1e-6) for r in got if 25 <= r["x"] <= 55)
    flat = pyramid.halved(grid(spark, np.full((6, 5, 1), 2.0)).filter("x <> 2")).collect()
    assert len(flat) == 9 and all(r["value"] == pytest.approx(2) for r in flat) and pyramid.halved(grid(spark, np.ones((1, 1, 1))).limit(0)).count() == 0
    assert math.isclose(pyramid.SEVENTH_TAPS.sum(), 1) and pyramid.TWO_SCALE_TAPS.sum() == 2


def test_an_inverse_is_found_in_bricks_without_a_shuffle_a_round(spark, spline, numbers, monkeypatch):
    cuts, cut = [], transforms.cut
    monkeypatch.setattr(transforms, "cut", lambda df: cuts.append(1) or cut(df))
    to, jac = run(spark, INNER, Inverse(spline, 1e-10))
    assert len(cuts) <= 3  # a round each before
    monkeypatch.setattr(transforms, "SIDE", 2)
    monkeypatch.setattr(transforms, "POINTS", 1)
    for got, want in zip(run(spark, INNER, Inverse(spline, 1e-10)), (to, jac), strict=True):
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    there, j = run(spark, to.tolist(), spline)
    assert np.allclose(there, INNER, atol=1e-8) and all(np.allclose(a @ b, np.eye(3), atol=1e-8) for a, b in zip(j, jac, strict=True))
    monkeypatch.setattr(transforms, "CONTROLS", 0)  # by rounds, where control points move too far
    for got, want in zip(run(spark, INNER, Inverse(spline, 1e-10)), (to, jac), strict=True):
        assert np.allclose(got, want, rtol=0, atol=1e-12)
