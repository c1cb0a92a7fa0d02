"""Free-form transforms of space: cubic B-splines, their Jacobians and inverses, chains of
transforms, and images resampled by them.

Points are rows (keys, px, py, pz); a spline moves them in bricks of cells, each with its points and
the control points around it, and derivative weights give the Jacobian matrix.  A spline moves no point
by more than its largest control point, so with that much more around a brick a whole inverse is found in it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import XYZ, Affine, transform_of, transform_parameters
from .graph import cut

#: Cells to a side of a brick, points of a group at most on average, and control points of a group of an inverse.
SIDE, POINTS, CONTROLS = 16, 50_000, 1 << 18
#: Points whose 64 control points are held at once.
CHUNK = 4096

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


@dataclass
class Spline:
    """x -> x + the cubic spline of a grid of displacements (i, j, k, cx, cy, cz), whose control point
    i lies at origin + i * spacing.  Points without all 64 control points around them stay."""

    control: DataFrame
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass
class Chain:
    """All transforms in turn, or with ``add`` the sum of their displacements at a point."""

    parts: list
    add: bool = False


@dataclass
class Inverse:
    """Of any transform, by fixed-point rounds until no point moves by more than ``tolerance``."""

    of: Affine | Spline | Chain | Inverse = field(repr=False)
    tolerance: float = 1e-6
    rounds: int = 100


def weights(u: np.ndarray) -> np.ndarray:
    """Weights of the control points -1, 0, 1, 2 of a cubic spline at the share u of a cell, in a last axis."""
    v = 1 - u
    return np.stack([v * v * v / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (3 * v * v * v - 6 * v * v + 4) / 6, u * u * u / 6], axis=-1)


def slopes(u: np.ndarray) -> np.ndarray:
    v = 1 - u
    return np.stack([-v * v / 2, (3 * u * u - 4 * u) / 2, (4 * v - 3 * v * v) / 2, u * u / 2], axis=-1)


def product(a: str, b: list[Column]) -> Column:
    """Row-major 3 x 3 product of a matrix column and entries."""
    return F.array(*[sum((F.col(a)[3 * i + k] * b[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])


def determinant(m: str) -> Column:
    a = [F.col(m)[k] for k in range(9)]
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def inverted(m: str) -> Column:
    a, d = [F.col(m)[k] for k in range(9)], determinant(m)
    minor = lambda i, j: a[3 * ((j + 1) % 3) + (i + 1) % 3] * a[3 * ((j + 2) % 3) + (i + 2) % 3] - a[3 * ((j + 1) % 3) + (i + 2) % 3] * a[3 * ((j + 2) % 3) + (i + 1) % 3]
    return F.array(*[minor(i, j) / d for i in range(3) for j in range(3)])


def moved(points: DataFrame, keys: list[str], transform: Affine | Spline | Chain | Inverse) -> DataFrame:
    """(keys, px, py, pz, jac): where points go, and the Jacobian matrix there, row by row.

    Keys tell points apart.  Raises if an inverse does not settle.
    """
    at = points.select(*keys, "px", "py", "pz")
    if isinstance(transform, Affine):
        to = transform.columns(F.col("px"), F.col("py"), F.col("pz"))
        jac = F.array(*[F.lit(float(x)) for x in transform.matrix.ravel()])
        return at.select(*keys, *[t.alias(f"p{c}") for c, t in zip(XYZ, to, strict=True)], jac.alias("jac"))
    if isinstance(transform, Spline):
        return moved_by_spline(at, keys, transform)
    if isinstance(transform, Inverse):
        return moved_back(at, keys, transform)
    now = at.withColumn("jac", F.array(*[F.lit(x) for x in EYE]))
    for part in transform.parts:
        step = moved(at if transform.add else now, keys, part).withColumnsRenamed({"jac": "j", "px": "qx", "py": "qy", "pz": "qz"})
        both = now.join(step, keys)
        if transform.add:
            # Displacements add, and so do the differences of the Jacobians from the identity.
            base = at.withColumnsRenamed({f"p{c}": f"o{c}" for c in XYZ})
            both = both.join(base, keys)
            now = both.select(*keys, *[(F.col(f"p{c}") + F.col(f"q{c}") - F.col(f"o{c}")).alias(f"p{c}") for c in XYZ], F.array(*[F.col("jac")[k] + F.col("j")[k] - EYE[k] for k in range(9)]).alias("jac"))
        else:
            now = both.select(*keys, *[F.col(f"q{c}").alias(f"p{c}") for c in XYZ], product("j", [F.col("jac")[k] for k in range(9)]).alias("jac"))
    return now


class Brick:
    """The control points of a box of cells that begins at control point ``low``; null numbers count as 0,
    and a control point without cx as missing."""

    def __init__(self, spline: tuple[tuple, tuple], low: np.ndarray, size: list[int], control: pa.Table):
        self.spacing, self.origin = (np.array(x, float) for x in spline)
        self.low, self.size = low, np.array(size)
        at = np.stack([control[c].to_numpy() for c in "ijk"], axis=1).astype(np.int64) - low
        flat = np.ravel_multi_index(tuple(at.T), size)
        number = [control[f"c{c}"].combine_chunks() for c in XYZ]
        values = np.stack([x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float) for x in number], axis=1)
        self.known, self.control = np.zeros(math.prod(size), np.int64), np.zeros((math.prod(size), 3))
        np.add.at(self.known, flat, number[0].is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
        np.add.at(self.control, flat, values)
        self.corners = np.ravel_multi_index(tuple(np.array(list(itertools.product(range(4), repeat=3))).T), size)

    def moves(self, p: np.ndarray, jacobian: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Displacements of points, and if asked the Jacobian matrices there, row by row."""
        parts = [self._moves(p[a : a + CHUNK], jacobian) for a in range(0, max(1, len(p)), CHUNK)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]) if jacobian else None

    def _moves(self, p: np.ndarray, jacobian: bool) -> tuple[np.ndarray, np.ndarray | None]:
        with np.errstate(invalid="ignore"):
            place = (p - self.origin) / self.spacing
            cell = np.where(np.isfinite(place), np.floor(place), 0)
            u, at = place - np.floor(place), cell - 1 - self.low
        held = ((at >= 0) & (at + 3 < self.size)).all(axis=1)
        at = np.where(held[:, None], at, 0).astype(np.int64)
        near = np.ravel_multi_index(tuple(at.T), tuple(self.size))[:, None] + self.corners
        whole = held & (self.known[near].sum(axis=1) == 64)
        around, w = self.control[near], weights(u)
        of = lambda x, y, z: (np.einsum("ni,nj,nk->nijk", x, y, z).reshape(len(p), 1, 64) @ around)[:, 0]
        move = np.where(whole[:, None], of(w[:, 0], w[:, 1], w[:, 2]), 0.0)
        if not jacobian:
            return move, None
        s = slopes(u) / self.spacing[:, None]
        by = np.stack([of(*[(s if d == c else w)[:, c] for c in range(3)]) for d in range(3)], axis=2)  # (point, of, by)
        return move, np.where(whole[:, None, None], by, 0.0).reshape(-1, 9) + EYE


def in_bricks(at: DataFrame, keys: list[str], spline: Spline, halo: list[int], aim: Callable[[Brick, np.ndarray], dict[str, np.ndarray]], more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, px, py, pz, jac[, more]) of what ``aim`` finds for the points of a brick, whose cells and
    ``halo`` cells around them have their control points.  Points of a full brick are dealt to several groups."""
    spacing, origin, brick = spline.spacing, spline.origin, [f"_b{c}" for c in XYZ]
    cell = [F.coalesce(F.floor((F.col(f"p{c}") - o) / s), F.lit(0)) for c, o, s in zip(XYZ, origin, spacing, strict=True)]
    points = at.select("*", *[F.floor(v / SIDE).alias(b) for b, v in zip(brick, cell, strict=True)])
    parts = points.groupBy(*brick).agg(F.ceil(F.count("*") / POINTS).alias("_parts"))
    points = points.join(parts, brick).withColumn("_part", F.pmod(F.xxhash64(*keys), F.col("_parts"))).drop("_parts")
    control = spline.control.select(*[F.col(c).cast("long").alias(c) for c in "ijk"], *[F.col(f"c{c}").cast("double").alias(f"c{c}") for c in XYZ])
    for b, c, h in zip(brick, "ijk", halo, strict=True):
        control = control.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) - 2 - h) / SIDE), F.floor((F.col(c) + 1 + h) / SIDE))))
    control = control.join(parts, brick).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    size, numbers = [SIDE + 3 + 2 * h for h in halo], (tuple(spacing), tuple(origin))
    made = [F.col(f"p{c}").cast("double").alias(f"p{c}") for c in XYZ] + [F.lit(None).cast("array<double>").alias("jac")]
    types = at.select(*keys, *made, *[F.lit(0).alias(c) for c in more]).schema
    names = [f"p{c}" for c in XYZ]

    def run(key: tuple, own: pa.Table, around: pa.Table) -> pa.Table:
        low = np.array([k.as_py() * SIDE - 1 - h for k, h in zip(key[:3], halo, strict=True)])
        p = np.stack([own[n].combine_chunks().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for n in names], axis=1)
        found = aim(Brick(numbers, low, size, around), p)
        out = {k: own[k] for k in keys}
        for c, n in enumerate(names):  # a null stays
            out[n] = pa.array(np.ascontiguousarray(found["p"][:, c]), mask=own[n].combine_chunks().is_null().to_numpy(zero_copy_only=False))
        out["jac"] = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(p) + 1, 9, dtype=np.int32)), pa.array(found["jac"].ravel()))
        return pa.table(out | {k: pa.array(v) for k, v in found.items() if k not in ("p", "jac")})

    group = [*brick, "_part"]
    return points.groupBy(*group).cogroup(control.groupBy(*group)).applyInArrow(run, types)


def with_keys(at: DataFrame, keys: list[str]) -> DataFrame:
    return at.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def moved_by_spline(at: DataFrame, keys: list[str], spline: Spline) -> DataFrame:
    def aim(brick: Brick, p: np.ndarray) -> dict[str, np.ndarray]:
        move, jac = brick.moves(p, True)
        return {"p": p + move, "jac": jac}

    return in_bricks(with_keys(at, keys), keys, spline, [0, 0, 0], aim)


def halo_of(spline: Spline) -> list[int]:
    """Cells that a point can be moved by, and one for rounding."""
    size = [F.abs(f"c{c}") for c in XYZ]
    most = spline.control.agg(*[F.max(F.when(x < math.inf, x)) for x in size]).first()
    return [math.ceil((m or 0.0) / abs(s)) + 1 for m, s in zip(most, spline.spacing, strict=True)]


def spline_back(at: DataFrame, keys: list[str], inverse: Inverse, halo: list[int]) -> DataFrame:
    """The rounds of an inverse within bricks.  All points take as many as the slowest brick: the others go
    on in a second pass."""
    tolerance, most, least = inverse.tolerance, inverse.rounds, 0
    at = cut(with_keys(at, keys))
    while True:

        def aim(brick: Brick, p: np.ndarray, least: int = least) -> dict[str, np.ndarray]:
            now, n = p, 0
            while n < most:
                to = now + brick.moves(now)[0]
                # A coordinate that is null has no distance; NaN is never near.
                if n >= least and (np.abs(to - p) <= tolerance)[~np.isnan(p)].all():
                    break
                now, n = now - to + p, n + 1
            return {"p": now, "jac": brick.moves(now, True)[1], "rounds": np.full(len(p), n, np.int32)}

        found = cut(in_bricks(at, keys, inverse.of, halo, aim, ("rounds",)))
        top = found.agg(F.max("rounds")).first()[0] or 0
        if top >= most:
            raise ValueError("the inverse has not settled: the transform folds or stretches too much")
        if top == least or found.filter(F.col("rounds") < top).isEmpty():
            return found.select(*keys, "px", "py", "pz", inverted("jac").alias("jac"))
        least = top


def moved_back(at: DataFrame, keys: list[str], inverse: Inverse) -> DataFrame:
    if isinstance(inverse.of, Affine):
        return moved(at, keys, inverse.of.inverse())
    if isinstance(inverse.of, Spline):
        halo = halo_of(inverse.of)
        if math.prod(SIDE + 3 + 2 * h for h in halo) <= CONTROLS:
            return spline_back(at, keys, inverse, halo)
    aim = cut(at.withColumnsRenamed({f"p{c}": f"a{c}" for c in XYZ}))
    now = aim.select(*keys, *[F.col(f"a{c}").alias(f"p{c}") for c in XYZ])
    for _ in range(inverse.rounds):
        step = moved(now, keys, inverse.of).withColumnsRenamed({f"p{c}": f"t{c}" for c in XYZ})
        both = cut(now.join(step, keys).join(aim, keys))
        off = F.greatest(*[F.abs(F.col(f"t{c}") - F.col(f"a{c}")) for c in XYZ])
        if (both.agg(F.max(off)).first()[0] or 0.0) <= inverse.tolerance:
            return both.select(*keys, "px", "py", "pz", inverted("jac").alias("jac"))
        now = both.select(*keys, *[(F.col(f"p{c}") - F.col(f"t{c}") + F.col(f"a{c}")).alias(f"p{c}") for c in XYZ])
    raise ValueError("the inverse has not settled: the transform folds or stretches too much")


def grid_points(grid: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    return grid.select(*XYZ, *[(F.col(c) * s).cast("double").alias(f"p{c}") for c, s in zip(XYZ, spacing, strict=True)]).dropDuplicates(XYZ)


def deformation(grid: DataFrame, transform: Affine | Spline | Chain | Inverse, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Coordinates that grid voxels come from, displacements T(x) - x, and the Jacobian determinant."""
    to = moved(grid_points(grid, spacing), XYZ, transform)
    d = [(F.col(f"p{c}") - F.col(c) * s).alias(f"d{c}") for c, s in zip(XYZ, spacing, strict=True)]
    return to.select(*XYZ, *[F.col(f"p{c}").alias(f"m{c}") for c in XYZ], *d, determinant("jac").alias("jacobian"))


#: Windows of the sinc kernel over t in -1..1.
WINDOWS: dict[str, Callable[[Column], Column]] = {
    "hamming": lambda t: 0.54 + 0.46 * F.cos(math.pi * t),
    "cosine": lambda t: F.cos(math.pi / 2 * t),
    "welch": lambda t: 1 - t * t,
    "lanczos": lambda t: F.when(t == 0, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * t)),
    "blackman": lambda t: 0.42 + 0.5 * F.cos(math.pi * t) + 0.08 * F.cos(2 * math.pi * t),
}


def taps(kernel: str, radius: int) -> tuple[list[int], Callable[[Column], Column]]:
    """Offsets from the voxel below a point, and the weight of a voxel at a distance from it."""
    if kernel == "linear":
        return [0, 1], lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))
    if kernel == "nearest":
        return [0, 1], lambda t: F.when((t > -0.5) & (t <= 0.5), 1.0).otherwise(0.0)
    window = WINDOWS[kernel]
    inside = lambda t: F.when(t == 0, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * t)) * window(t / radius)
    return list(range(1 - radius, radius + 1)), lambda t: F.when(F.abs(t) < radius, inside(t)).otherwise(0.0)


def gathered(image: DataFrame, columns: list[str], points: DataFrame, keys: list[str], spacing: tuple[float, float, float], kernel: str = "linear", radius: int = 3) -> DataFrame:
    """(keys, columns): an image's values at points in millimetres, null where less than half of the
    kernel's weight lies on the image.  Kernels: linear, nearest, or a sinc with one of the WINDOWS."""
    offsets, weight = taps(kernel, radius)
    place = points.select(*keys, *[(F.col(f"p{c}") / s).alias(f"f{c}") for c, s in zip(XYZ, spacing, strict=True)])
    for c in XYZ:
        at, low = F.col(f"f{c}"), F.floor(f"f{c}").cast("int")
        each = F.array(*[F.struct((low + o).alias("p"), weight(low + o - at).alias("w")) for o in offsets])
        place = place.withColumn(f"t{c}", F.filter(each, lambda x: x["w"] != 0))
    for c in XYZ:
        place = place.select(*[x for x in place.columns if x != f"t{c}"], F.explode(f"t{c}").alias(f"e{c}"))
    each = place.select(*keys, *[F.col(f"e{c}.p").alias(f"v{c}") for c in XYZ], (F.col("ex.w") * F.col("ey.w") * F.col("ez.w")).alias("w"))
    known = image.select(*[F.col(c).alias(f"v{c}") for c in XYZ], *[F.col(c).cast("double").alias(f"in_{c}") for c in columns]).na.drop()
    met = each.join(known, [f"v{c}" for c in XYZ])
    sums = met.groupBy(*keys).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"in_{c}")).alias(f"in_{c}") for c in columns])
    got = [F.when(F.col("w") >= 0.5, F.col(f"in_{c}") / F.col("w")).alias(c) for c in columns]
    return points.select(*keys).join(sums.select(*keys, *got), keys, "left")


def resampled(image: DataFrame, grid: DataFrame, transform: Affine | Spline | Chain | Inverse, spacing=(1.0, 1.0, 1.0), grid_spacing=None, kernel: str = "linear", outside: float = 0.0) -> DataFrame:
    """Values of an image (x, y, z, value) at the places that a transform takes grid voxels to."""
    to = cut(moved(grid_points(grid, grid_spacing or spacing), XYZ, transform))
    return gathered(image, ["value"], to, XYZ, spacing, kernel).na.fill({"value": outside})


def transform_from(spark: SparkSession, text: str) -> Affine | Spline:
    """The transform of a parameter file: affine, similarity or cubic B-spline."""
    entries = transform_parameters(text)
    if entries["Transform"][0] != "BSplineTransform":
        return transform_of(entries)
    if entries.get("BSplineTransformSplineOrder", ["3"])[0] != "3":
        raise ValueError("only cubic splines are known")
    if [float(x) for x in entries.get("GridDirection", map(str, EYE))] != EYE:
        raise ValueError("a turned control grid is not known")
    size = [int(x) for x in entries["GridSize"]]
    numbers = np.array([float(x) for x in entries["TransformParameters"]]).reshape(3, *size[::-1])
    # The file's numbers are on the driver already; x runs fastest, and the first index may not be 0.
    start = [int(float(x)) for x in entries.get("GridIndex", ["0", "0", "0"])]
    rows = [(i + start[0], j + start[1], k + start[2], *map(float, numbers[:, k, j, i])) for k, j, i in np.ndindex(*size[::-1])]
    control = spark.createDataFrame(rows, "i int, j int, k int, cx double, cy double, cz double")
    numbers_of = lambda name: tuple(float(x) for x in entries[name])
    return Spline(control, numbers_of("GridSpacing"), numbers_of("GridOrigin"))


def read_transforms(spark: SparkSession, names: list[str], load: Callable[[str], str] | None = None) -> Affine | Spline | Chain | Inverse:
    """One transform of parameter files, applied in order.

    Before a file, '+i' inverts it, '+s' skips the initial transform that it names, and '+a' adds
    its displacement to what is before instead of composing.  ``load`` gives a file's text.
    """
    load = load or (lambda name: spark.read.text(name, wholetext=True).first()[0])
    out, tokens = None, set()
    for name in names:
        if name in ("+i", "+s", "+a"):
            tokens.add(name)
            continue
        text = load(name)
        entries = transform_parameters(text)
        own = transform_from(spark, text)
        initial = entries.get("InitialTransformParametersFileName", ["NoInitialTransform"])[0]
        if initial != "NoInitialTransform" and "+s" not in tokens:
            add = entries.get("HowToCombineTransforms", ["Compose"])[0] == "Add"
            own = Chain([read_transforms(spark, [initial], load), own], add)
        own = Inverse(own) if "+i" in tokens else own
        out = own if out is None else Chain([out, own], "+a" in tokens)
        tokens = set()
    if out is None or tokens:
        raise ValueError("a transform file is missing")
    return out
