"""Volume filters and resampling over voxel tables (x, y, z, value): neighbours meet by joins.

A filter explodes each voxel to the places that it contributes to and sums there, so its cost is the
number of voxels times the kernel's, in one shuffle, and no task holds a volume.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]
FACES = [(dx, dy, dz) for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]


def spread(voxels: DataFrame, offsets: list[tuple[int, int, int, float]]) -> DataFrame:
    """(x, y, z, total, weight): at each place the weighted sum of the voxels around it."""
    o = F.array(*[F.struct(*[F.lit(a).alias(n) for a, n in zip(row, ("dx", "dy", "dz", "w"), strict=True)]) for row in offsets])
    moved = voxels.select(*XYZ, "value", F.explode(o).alias("o"))
    at = [(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in XYZ]
    moved = moved.select(*at, (F.col("value") * F.col("o.w")).alias("v"), F.col("o.w").alias("w"))
    return moved.groupBy(*XYZ).agg(F.sum("v").alias("total"), F.sum("w").alias("weight"))


def gaussian(voxels: DataFrame, fwhm: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), in_plane: bool = False) -> DataFrame:
    """Smoothed by a Gaussian of a width at half height in millimetres, axis by axis, four deviations
    wide; at borders the weights of what is there sum to one."""
    sigma = fwhm / math.sqrt(8 * math.log(2))
    out = voxels.select(*XYZ, "value")
    for axis in range(2 if in_plane else 3):
        s = sigma / spacing[axis]
        reach = max(1, math.ceil(4 * s))
        taps = [(*[k if a == axis else 0 for a in range(3)], math.exp(-k * k / (2 * s * s))) for k in range(-reach, reach + 1)]
        summed = spread(out, taps)
        out = summed.join(voxels.select(*XYZ), XYZ, "left_semi").select(*XYZ, (F.col("total") / F.col("weight")).alias("value"))
    return out


def anisotropic(voxels: DataFrame, rounds: int = 5, step: float = 0.0625, conductance: float = 3.0) -> DataFrame:
    """Edge-preserving diffusion: each round adds step * sum of g(d) d over the six differences d, with
    g(d) = exp(-d^2 / (2 (conductance * mean |d|)^2))."""
    from .graph import cut

    out = cut(voxels.select(*XYZ, F.col("value").cast("double").alias("value")))
    turn = F.array(*[F.struct(*[F.lit(a).alias(n) for a, n in zip(row, ("dx", "dy", "dz"), strict=True)]) for row in FACES])
    for _ in range(rounds):
        sent = out.select(*XYZ, F.col("value").alias("near"), F.explode(turn).alias("o"))
        sent = sent.select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in XYZ], "near")
        pairs = sent.join(out, XYZ).select(*XYZ, "value", (F.col("near") - F.col("value")).alias("d"))
        scale = pairs.agg(F.avg(F.abs("d")).alias("m"))  # one row
        k = conductance * F.col("m")
        g = F.when(F.col("m") > 0, F.exp(-F.col("d") * F.col("d") / (2 * k * k)) * F.col("d")).otherwise(0.0)
        flow = pairs.crossJoin(F.broadcast(scale)).groupBy(*XYZ).agg(F.sum(g).alias("flow"))
        out = cut(out.join(flow, XYZ, "left").select(*XYZ, (F.col("value") + step * F.coalesce("flow", F.lit(0.0))).alias("value")))
    return out


def filled(voxels: DataFrame) -> DataFrame:
    """Grey-scale fill-hole: each voxel gets the least over its paths to the border of their largest value.

    Border voxels of the grid's box keep theirs; levels sink from infinity until none changes.
    """
    from .graph import cut

    box = voxels.agg(*[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    edge = F.lit(False)
    for c in XYZ:
        edge = edge | ((F.col(f"lo{c}") < F.col(f"hi{c}")) & ((F.col(c) == F.col(f"lo{c}")) | (F.col(c) == F.col(f"hi{c}"))))
    level = F.when(edge, F.col("value")).otherwise(F.lit(float("inf")))
    now = cut(voxels.crossJoin(F.broadcast(box)).select(*XYZ, "value", level.alias("level"), edge.alias("new")))
    turn = F.array(*[F.struct(*[F.lit(a).alias(n) for a, n in zip(row, ("dx", "dy", "dz"), strict=True)]) for row in FACES])
    while not now.filter("new").isEmpty():
        sent = now.filter("new").select(*XYZ, F.col("level").alias("near"), F.explode(turn).alias("o"))
        sent = sent.select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in XYZ], "near").groupBy(*XYZ).agg(F.min("near").alias("near"))
        lower = F.greatest("near", "value")
        sinks = F.col("near").isNotNull() & (lower < F.col("level"))
        now = cut(now.drop("new").join(sent, XYZ, "left").select(*XYZ, "value", F.when(sinks, lower).otherwise(F.col("level")).alias("level"), sinks.alias("new")))
    return now.select(*XYZ, F.col("level").alias("value"))


def distance_to_centre(mask: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Millimetres of each mask voxel from the mask's centre of gravity."""
    on = mask.filter("value <> 0")
    centre = on.agg(*[F.avg(F.col(c) * s).alias(f"c{c}") for c, s in zip(XYZ, spacing, strict=True)])  # one row
    d = sum((F.pow(F.col(c) * s - F.col(f"c{c}"), 2) for c, s in zip(XYZ, spacing, strict=True)), F.lit(0.0))
    return on.crossJoin(F.broadcast(centre)).select(*XYZ, F.sqrt(d).alias("distance"))


#: Lines up to this length meet all to all.
SHORT = 64


def lower_envelope(at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """At each place the least, over all places of the line, of the squared distance plus theirs.

    ``at`` is in order; a long line takes one pass over the parabolas that form the lower envelope.
    """
    if len(at) <= SHORT:
        return ((at[:, None] - at) ** 2 + d).min(axis=1)
    sites = np.flatnonzero(np.isfinite(d))
    if not len(sites):
        return d
    own, start = [], []
    for x, f in zip(at[sites].tolist(), d[sites].tolist(), strict=True):
        begin, lies_above = -math.inf, False
        while own:
            px, pf = own[-1]
            if px == x:
                begin, lies_above = start[-1], pf <= f
            else:
                begin = (f - pf + x * x - px * px) / (2 * (x - px))
            if lies_above or (px != x and begin > start[-1]):
                break
            own.pop(), start.pop()
            begin = -math.inf
        if not lies_above:
            own.append((x, f))
            start.append(begin)
    x, f = np.array(own).T
    k = np.maximum(np.searchsorted(np.array(start), at, side="right") - 1, 0)
    near = [np.clip(k + step, 0, len(x) - 1) for step in (-1, 0, 1)]  # neighbours too: starts are rounded
    return np.min([(at - x[j]) ** 2 + f[j] for j in near], axis=0)


def distance_map(mask: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Signed Euclidean distance to the border of an object: below 0 inside, above 0 outside.

    Three passes, one an axis: along a line, each voxel takes the least of (distance along the axis)^2
    plus what the passes before gave, so only voxels of one line meet, in time that follows its
    length.  A voxel's distance is that to the nearest voxel of the other kind; without any it is
    infinite.
    """
    kinds = dict(mask.dtypes)
    on = (F.col("value") != 0).cast("int")
    start = lambda target: F.when(on == target, 0.0).otherwise(float("inf"))
    now = mask.select(*XYZ, start(0).alias("i"), start(1).alias("o"))
    for axis, s in zip(XYZ, spacing, strict=True):
        rest = [c for c in XYZ if c != axis]
        lines = now.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(axis, "i", "o"))).alias("line"))  # a line of one axis

        def run(batches: Iterator[pa.RecordBatch], rest: list[str] = rest, axis: str = axis, s: float = s) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                line = batch.column("line")
                ends = line.offsets.to_numpy() - line.offsets[0].as_py()
                flat = line.flatten()
                at = flat.field(axis).to_numpy(zero_copy_only=False) * float(s)
                d = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in "io"}
                out = {c: np.concatenate([lower_envelope(at[a:b], v[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] or [v]) for c, v in d.items()}
                back = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
                of = {c: batch.column(c).take(back) for c in rest} | {axis: flat.field(axis)} | {c: pa.array(v) for c, v in out.items()}
                yield pa.RecordBatch.from_arrays([of[c] for c in (*XYZ, "i", "o")], [*XYZ, "i", "o"])

        now = lines.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in XYZ) + ", i double, o double")
    return now.select(*XYZ, (F.sqrt("o") - F.sqrt("i")).alias("distance"))


def border_distance(ref: DataFrame, probability: DataFrame, steps: int = 40, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """For thresholds 0, 1/steps, ...: mean distance of false positives and false negatives from the
    reference's border, and the larger of the two.

    One aggregation by the bin of the probability, then suffix sums over the bins.
    """
    from pyspark.sql import Window

    d = distance_map(ref, spacing).join(ref.select(*XYZ, (F.col("value") != 0).alias("is_ref")), XYZ).join(probability.select(*XYZ, F.col("value").alias("p")), XYZ)
    at = F.least(F.floor(F.col("p") * steps + 1e-9), F.lit(steps - 1)).cast("int")
    away = F.abs("distance")
    sums = d.groupBy(at.alias("bin")).agg(
        F.sum(F.when(~F.col("is_ref"), away)).alias("fs"), F.count_if(~F.col("is_ref")).alias("fn"),
        F.sum(F.when(F.col("is_ref"), away)).alias("rs"), F.count_if(F.col("is_ref")).alias("rn"),
    )
    every = ref.sparkSession.range(steps).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(sums), "bin", "left").na.fill(0)  # ``steps`` rows
    up = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    fp = F.coalesce(F.sum("fs").over(up) / F.nullif(F.sum("fn").over(up), F.lit(0)), F.lit(0.0))
    fn = F.coalesce(F.sum("rs").over(down) / F.nullif(F.sum("rn").over(down), F.lit(0)), F.lit(0.0))
    return every.select((F.col("bin") / steps).alias("threshold"), fp.alias("false_positive"), fn.alias("false_negative"), F.greatest(fp, fn).alias("hausdorff"))


class Affine:
    """x -> A x + b in millimetres."""

    def __init__(self, matrix, offset=(0.0, 0.0, 0.0)):
        self.matrix, self.offset = np.asarray(matrix, float), np.asarray(offset, float)

    @classmethod
    def similarity(cls, scale: float, axis: tuple[float, float, float], angle: float, offset=(0.0, 0.0, 0.0), centre=(0.0, 0.0, 0.0)) -> Affine:
        u = np.asarray(axis, float) / (np.linalg.norm(axis) or 1.0)
        k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
        m = scale * (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k)
        return cls(m, np.asarray(offset, float) + np.asarray(centre, float) - m @ np.asarray(centre, float))

    def inverse(self) -> Affine:
        m = np.linalg.inv(self.matrix)
        return Affine(m, -m @ self.offset)

    def after(self, first: Affine) -> Affine:
        """``first``, then this."""
        return Affine(self.matrix @ first.matrix, self.matrix @ first.offset + self.offset)

    def columns(self, x: Column, y: Column, z: Column) -> list[Column]:
        return [float(r[0]) * x + float(r[1]) * y + float(r[2]) * z + float(b) for r, b in zip(self.matrix, self.offset, strict=True)]

    def determinant(self) -> float:
        return float(np.linalg.det(self.matrix))


def composed(transforms: list[Affine], add: bool = False) -> Affine:
    """One transform that applies all in turn, or, with ``add``, the sum of their displacements."""
    out = Affine(np.eye(3))
    for t in transforms:
        out = Affine(out.matrix + t.matrix - np.eye(3), out.offset + t.offset) if add else t.after(out)
    return out


def deformation(grid: DataFrame, transform: Affine, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Coordinates that grid voxels come from, displacements T(x) - x, and the Jacobian determinant."""
    at = [F.col(c) * s for c, s in zip(XYZ, spacing, strict=True)]
    to = transform.columns(*at)
    return grid.select(*XYZ, *[t.alias(f"m{c}") for c, t in zip(XYZ, to, strict=True)], *[(t - a).alias(f"d{c}") for c, t, a in zip(XYZ, to, at, strict=True)], F.lit(transform.determinant()).alias("jacobian"))


def resampled(voxels: DataFrame, grid: DataFrame, transform: Affine | None = None, spacing=(1.0, 1.0, 1.0), grid_spacing=None, nearest: bool = False, outside: float = 0.0) -> DataFrame:
    """Values of an image at the places of a reference grid, linear or nearest.

    A grid voxel is moved by the transform and meets the one or eight image voxels around it; a place
    with no weight on the image gets ``outside``.
    """
    at = [F.col(c) * s for c, s in zip(XYZ, grid_spacing or spacing, strict=True)]
    to = (transform or Affine(np.eye(3))).columns(*at)
    index = [(t / s).alias(f"f{c}") for c, t, s in zip(XYZ, to, spacing, strict=True)]
    place = grid.select(*[F.col(c).alias(f"g{c}") for c in XYZ], *index)
    if nearest:
        corners = place.select("gx", "gy", "gz", *[F.floor(F.col(f"f{c}") + 0.5).cast("int").alias(c) for c in XYZ], F.lit(1.0).alias("w"))
    else:
        eight = F.array(*[F.struct(*[F.lit(a).alias(n) for n, a in zip(XYZ, (a, b, c), strict=True)]) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
        each = place.select("*", F.explode(eight).alias("o"))
        share = lambda c: F.col(f"f{c}") - F.floor(F.col(f"f{c}"))
        weight = lambda c: F.when(F.col(f"o.{c}") == 1, share(c)).otherwise(1 - share(c))
        corners = each.select("gx", "gy", "gz", *[(F.floor(F.col(f"f{c}")) + F.col(f"o.{c}")).cast("int").alias(c) for c in XYZ], (weight("x") * weight("y") * weight("z")).alias("w")).filter("w > 0")
    met = corners.join(voxels.select(*XYZ, "value"), XYZ, "left")
    sums = met.groupBy("gx", "gy", "gz").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("w"), F.sum(F.col("value") * F.col("w")).alias("v"))
    value = F.when(F.col("w") > 0.5, F.col("v") / F.col("w")).otherwise(F.lit(float(outside)))
    return sums.select(*[F.col(f"g{c}").alias(c) for c in XYZ], value.alias("value"))


def transform_parameters(text: str) -> dict[str, list[str]]:
    """Entries ``(Key value ...)`` of a parameter file; comments start with //, quotes hold spaces."""
    out = {}
    for line in text.splitlines():
        found = re.match(r"\s*\((\w+)\s*(.*)\)\s*$", line.split("//")[0])
        if found:
            out[found[1]] = [a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', found[2])]
    return out


def transform_of(entries: dict[str, list[str]]) -> Affine:
    """The affine or similarity transform that a parameter file describes, around its centre."""
    p = [float(x) for x in entries["TransformParameters"]]
    centre = np.array([float(x) for x in entries.get("CenterOfRotationPoint", ["0", "0", "0"])])
    kind = entries["Transform"][0]
    if kind == "AffineTransform":
        m, t = np.array(p[:9]).reshape(3, 3), np.array(p[9:])
        return Affine(m, t + centre - m @ centre)
    if kind == "SimilarityTransform":
        v, t, scale = np.array(p[:3]), np.array(p[3:6]), p[6]
        angle = 2 * math.asin(min(1.0, float(np.linalg.norm(v))))
        return Affine.similarity(scale, tuple(v) if v.any() else (0, 0, 1), angle, t, centre)
    raise ValueError(f"{kind} is neither affine nor a similarity; see ``transforms.transform_from``")
