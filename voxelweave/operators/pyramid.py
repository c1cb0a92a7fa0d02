"""Least-squares cubic spline pyramid: images of half the size that are the best splines of theirs.

Along an axis the samples of a line become spline coefficients by recursive filters, which a spline
of twice the knot spacing approximates in the least-squares sense; its samples are the result.  Only
the voxels of one line meet; lines of equal length are filtered together in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]
#: Samples beyond each end, after which a recursive filter has forgotten its start.
MARGIN = 64
#: Poles of the inverse filters of the cubic spline's samples and of its products with its own
#: shifts (the spline of degree seven), and the taps of both and of the two-scale relation.  Fixed values.
CUBIC_POLES = (3**0.5 - 2,)
SEVENTH_POLES = (-0.5352804307964382, -0.1225546151923274, -0.0091486948096082)
CUBIC_TAPS = np.array([1, 4, 1]) / 6
SEVENTH_TAPS = np.array([1, 120, 1191, 2416, 1191, 120, 1]) / 5040
TWO_SCALE_TAPS = np.array([1, 4, 6, 4, 1]) / 8


def recursive(lines: np.ndarray, poles: tuple[float, ...]) -> np.ndarray:
    """Inverse of a symmetric filter of unit sum with these poles, along the last axis."""
    out = lines.astype(float).copy()
    for z in poles:
        out *= (1 - z) * (1 - 1 / z)
        out[:, 0] /= 1 - z
        for k in range(1, out.shape[1]):
            out[:, k] += z * out[:, k - 1]
        out[:, -1] *= z / (z - 1)
        for k in range(out.shape[1] - 2, -1, -1):
            out[:, k] = z * (out[:, k + 1] - out[:, k])
    return out


def convolved(lines: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Along the last axis, only where all taps meet samples."""
    n = lines.shape[1] - len(taps) + 1
    return sum(t * lines[:, k : k + n] for k, t in enumerate(taps))


def halved_lines(lines: np.ndarray) -> np.ndarray:
    """Samples at 0, 2, 4... of the least-squares spline with knots there; ends are mirrored."""
    n = lines.shape[1]
    if n < 2:
        return lines.astype(float)
    pad = 4 * MARGIN + 2 * (len(CUBIC_TAPS) // 2)
    edge = len(SEVENTH_TAPS) // 2 + len(TWO_SCALE_TAPS) // 2
    place = np.arange(-pad - edge, n + pad + edge) % (2 * n - 2)
    inner = recursive(lines[:, np.minimum(place, 2 * n - 2 - place)], CUBIC_POLES)
    right = convolved(convolved(inner, SEVENTH_TAPS), TWO_SCALE_TAPS)[:, ::2] / 2
    out = convolved(recursive(right, SEVENTH_POLES), CUBIC_TAPS)
    first = pad // 2 - 1
    return out[:, first : first + (n + 1) // 2]


def halve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (first, values) of any lengths; holes in a line are filled in linearly before."""
    for batch in batches:
        first, places, values = (batch.column(c) for c in ("first", "places", "values"))
        own: list = [None] * batch.num_rows
        by: dict[int, list[int]] = {}
        whole = []
        for k, (f, p, v) in enumerate(zip(first.to_pylist(), places.to_pylist(), values.to_pylist(), strict=True)):
            whole.append(np.interp(np.arange(f, p[-1] + 1), p, v))
            by.setdefault(len(whole[-1]), []).append(k)
        for rows in by.values():
            for k, line in zip(rows, halved_lines(np.stack([whole[k] for k in rows])), strict=True):
                own[k] = line
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(own, pa.list_(pa.float64()))], ["a", "b", "values"])


def halved(voxels: DataFrame, axes: str = "xyz") -> DataFrame:
    """Half the size along some axes ('xy' for slices) of an image (x, y, z, value), rounded up.

    Places count from each line's first voxel, which should be the same for all lines.  Null values
    are holes, filled in from the line's neighbours; repeated voxels count with their mean.
    """
    out = voxels.select(*XYZ, F.col("value").cast("double").alias("value"))
    for axis in axes:
        a, b = (c for c in XYZ if c != axis)
        clean = out.filter("value IS NOT NULL").groupBy(*XYZ).agg(F.avg("value").alias("value"))
        start = clean.agg(F.min(axis).alias("first"))  # one row
        lines = clean.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("p"), "value"))).alias("line"))  # a line of one axis
        lines = lines.crossJoin(F.broadcast(start)).select(
            F.col("a").cast("long"), F.col("b").cast("long"), F.col("first").cast("long"), F.transform("line", lambda x: x["p"].cast("long")).alias("places"), F.transform("line", lambda x: x["value"]).alias("values")
        )
        done = lines.mapInArrow(halve_batches, "a long, b long, values array<double>")
        done = done.select("a", "b", F.posexplode("values").alias("p", "value"))
        names = {a: F.col("a"), b: F.col("b"), axis: F.col("p")}
        out = done.select(*[names[c].cast("int").alias(c) for c in XYZ], "value")
    return out
