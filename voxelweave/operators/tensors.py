"""Diffusion tensor images (x, y, z, dxx .. dxz) resampled under a transform, with their directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diffusion import ELEMENTS, SIX, matrices
from .filters import XYZ, Affine
from .graph import cut
from .transforms import Chain, Inverse, Spline, gathered, grid_points, inverted, moved

#: What a corrected eigenvalue of zero or less becomes.
LEAST = 1e-15


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def turned(d: np.ndarray, f: np.ndarray, method: str) -> np.ndarray:
    """Tensors n x 3 x 3 carried along by local linear maps f.

    'ppd' preserves principal directions: the first eigenvector goes where f takes it, the second
    into the plane that f takes both to, and the eigenvalues stay.  'fs' turns by the rotation of
    f's polar decomposition.
    """
    if method == "fs":
        u, _, v = np.linalg.svd(f)
        r = u @ v
        return r @ d @ np.swapaxes(r, 1, 2)
    if method != "ppd":
        raise ValueError("directions are carried by 'ppd' or 'fs'")
    values, vectors = np.linalg.eigh(d)
    carried = f @ vectors
    one = unit(carried[:, :, 2])
    two = carried[:, :, 1] - (carried[:, :, 1] * one).sum(axis=1, keepdims=True) * one
    two = unit(two)
    axes = np.stack([np.cross(one, two), two, one], axis=2)
    return (axes * values[:, None, :]) @ np.swapaxes(axes, 1, 2)


def corrected(d: np.ndarray, method: str) -> np.ndarray:
    """Tensors without negative eigenvalues: 'zero' lifts them to LEAST, 'abs' takes their size, and
    'nearest' is the nearest semi-definite tensor, (D + (D D)^1/2) / 2, lifted likewise."""
    if method == "none":
        return d
    values, vectors = np.linalg.eigh(d)
    if method == "abs":
        values = np.abs(values)
    elif method == "nearest":
        values = (values + np.abs(values)) / 2
    elif method != "zero":
        raise ValueError("corrections are 'none', 'zero', 'abs' and 'nearest'")
    values = np.where(values <= 0, LEAST, values)
    return (vectors * values[:, None, :]) @ np.swapaxes(vectors, 1, 2)


def warped(
    tensors: DataFrame, grid: DataFrame, transform: Affine | Spline | Chain | Inverse, spacing=(1.0, 1.0, 1.0), grid_spacing=None,
    directions: str = "ppd", kernel: str = "linear", radius: int = 3, correction: str = "none",
) -> DataFrame:
    """Tensors at the voxels of a grid, from where the transform takes these.

    Elements are gathered by a kernel of ``transforms.gathered``; each tensor is then carried along
    by the inverse of the transform's Jacobian at its voxel, and corrected.  Voxels with no tensor
    there, or where the transform folds flat, have null elements.
    """
    to = cut(moved(grid_points(grid, grid_spacing or spacing), XYZ, transform))
    values = gathered(tensors, ELEMENTS, to, XYZ, spacing, kernel, radius)
    local = to.select(*XYZ, inverted("jac").alias("f"))
    rows = values.join(local, XYZ).select(*XYZ, F.array(*ELEMENTS).alias("d"), "f")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = np.full((len(part), 6), np.nan)
            if len(part):
                d, f = (np.stack(part[c].to_list()).astype(float) for c in "df")
                good = np.isfinite(d).all(axis=1) & np.isfinite(f).all(axis=1)
                if good.any():
                    done = corrected(turned(matrices(d[good]), f[good].reshape(-1, 3, 3), directions), correction)
                    out[good] = np.stack([done[:, i, j] for i, j in SIX], axis=1)
            yield pd.concat([part[XYZ].reset_index(drop=True), pd.DataFrame(out, columns=ELEMENTS)], axis=1)

    done = rows.mapInPandas(run, "x int, y int, z int, " + ", ".join(f"{e} double" for e in ELEMENTS))
    return done.select(*XYZ, *[F.when(~F.isnan(e), F.col(e)).alias(e) for e in ELEMENTS])
