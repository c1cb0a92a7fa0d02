"""Posterior of diffusion and kurtosis: draws of the tensors, and the extremes of kurtosis of each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .diffusion import ENTRY, along, directions, kurtosis_design, kurtosis_maps, matrices
from .fits import named
from .signal import mapped

#: Half of these directions, those of z > 0, make the grid, for kurtosis is the same in n and -n.
GRID = directions(500)[:250]
#: Grid points that are the best within 20 degrees are starts; those of the best values are refined.
CLOSE = [np.flatnonzero(c) for c in np.abs(GRID @ GRID.T) > np.cos(np.radians(20))]
STARTS = 6
#: Rows of a task at most, and so many that a task of their own is worth its start.
ROWS, FEW = 5_000, 100


def kurtosis_along(d: np.ndarray, w: np.ndarray, n: np.ndarray, curved: bool = True) -> tuple[np.ndarray, ...]:
    """W(n) / D(n)^2 and, if asked, its gradient and Hessian in space; d (k, 3, 3), w (k, 3, 3, 3, 3), n (k, s, 3)."""
    pairs = (n[..., :, None] * n[..., None, :]).reshape(*n.shape[:2], 9)
    two = pairs @ w.reshape(-1, 9, 9)  # w is symmetric
    half = n @ d
    top, low = (two * pairs).sum(axis=-1), (half * n).sum(axis=-1)
    if not curved:
        return (top / low**2,)
    two = two.reshape(*n.shape, 3)
    one = (two @ n[..., None])[..., 0]
    t, u = top[..., None], low[..., None]
    slope = 4 * one / u**2 - 4 * t * half / u**3
    mixed = one[..., :, None] * half[..., None, :]
    t, u = t[..., None], u[..., None]
    bend = 12 * two / u**2 - 16 * (mixed + np.swapaxes(mixed, -1, -2)) / u**3 - 4 * t * d[:, None] / u**3 + 24 * t * half[..., :, None] * half[..., None, :] / u**4
    return top / low**2, slope, bend


def tangents(n: np.ndarray) -> np.ndarray:
    """Two unit vectors, as columns, at right angles to each n and to each other."""
    axis = np.eye(3)[np.abs(n).argmin(axis=-1)]
    one = np.cross(n, axis)
    one /= np.linalg.norm(one, axis=-1, keepdims=True)
    return np.stack([one, np.cross(n, one)], axis=-1)


def grid_starts(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, grid point) of each row's STARTS least local minima, of values (grid point, row), by row."""
    best = np.stack([f[p] <= f[close].min(axis=0) for p, close in enumerate(CLOSE)])
    row, point = np.nonzero(best.T)
    order = np.lexsort((f[point, row], row))
    row, point = row[order], point[order]
    first = np.searchsorted(row, row) + STARTS > np.arange(len(row))
    return row[first], point[first]


def against_slope(bend: np.ndarray, g: np.ndarray, least: np.ndarray) -> np.ndarray:
    """-H^-1 g for symmetric 2 x 2 matrices H, with eigenvalues taken as positive and at least ``least``."""
    half, off = (bend[:, 0, 0] - bend[:, 1, 1]) / 2, (bend[:, 0, 1] + bend[:, 1, 0]) / 2
    middle, apart = (bend[:, 0, 0] + bend[:, 1, 1]) / 2, np.hypot(half, off)
    high, low = (1 / np.maximum(np.abs(middle + s * apart), least) for s in (1, -1))
    even, odd = (high + low) / 2, (high - low) / 2 / np.where(apart == 0, 1, apart)
    return -np.stack([(even + odd * half) * g[:, 0] + odd * off * g[:, 1], odd * off * g[:, 0] + (even - odd * half) * g[:, 1]], axis=1)


def kurtosis_extremes(fit: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest kurtosis over the sphere of fits (six, fifteen), and whether both converged.

    Newton steps in the tangent plane from the best local extremes of a grid, with curvatures taken
    as positive and steps halved until the value gets better.  Where D is not positive definite
    kurtosis has no bounds: NaN, not converged.
    """
    out, sure = np.full((2, len(fit)), np.nan), np.zeros(len(fit), bool)
    d, w = matrices(fit[:, :6]), fit[:, 6:][:, ENTRY]
    good = np.isfinite(fit).all(axis=1)
    good[good] = np.linalg.eigvalsh(d[good])[:, 0] > 0
    if not good.any():
        return out[0], out[1], sure
    d, w, grid = d[good], w[good], np.ascontiguousarray(along(fit[good], GRID)[1].T)
    sure[good] = True
    for side, sign in ((0, 1.0), (1, -1.0)):
        f = sign * grid
        owner, point = grid_starts(f)
        n, value = GRID[point][:, None], f[point, owner]
        at = np.arange(len(owner))  # the starts still moving
        for _ in range(rounds):
            do, wo = d[owner[at]], w[owner[at]]
            v, slope, bend = kurtosis_along(do, wo, n[at])
            value[at], plane = sign * v[:, 0], tangents(n[at])[:, 0]
            turned = np.swapaxes(plane, 1, 2)
            g = sign * (turned @ slope[:, 0, :, None])[..., 0]
            size = 1e-9 + np.abs(value[at])
            open_ = np.linalg.norm(g, axis=1) > 1e-8 * size
            turn = against_slope(sign * (turned @ bend[:, 0] @ plane), g, 1e-6 * size)
            step = (plane @ turn[..., None])[..., 0]
            step *= np.minimum(1, 0.3 / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-300))
            left = np.flatnonzero(open_)
            moved = []
            for _ in range(20):
                tried = n[at[left]] + step[left, None]
                tried /= np.linalg.norm(tried, axis=-1, keepdims=True)
                better = sign * kurtosis_along(do[left], wo[left], tried, False)[0][:, 0] < value[at[left]]
                n[at[left[better]]] = tried[better]
                moved.append(left[better])
                left = left[~better]
                if not len(left):
                    break
                step[left] /= 2
            at = at[np.sort(np.concatenate(moved))]  # the others are at an extreme, to rounding
            if not len(at):
                break
        out[side, good] = sign * np.minimum.reduceat(value, np.searchsorted(owner, np.arange(len(d))))
        sure[np.flatnonzero(good)[owner[at]]] = False
    return out[0], out[1], sure


MEASURES = ("trace", "fa", "mean_k", "axial_k", "radial_k", "k_min", "k_max")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in as many partitions as milliseconds of work a row are worth, however few files hold them."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-n // ROWS), min(cores, n // FEW)), "voxel_id")


def bayesian_kurtosis(rows: DataFrame, gradients: list[tuple[float, float, float, float]], draws: int = 100, seed: int = 1) -> DataFrame:
    """Posterior mean and deviation of MEASURES under a flat prior, over positive definite draws.

    ln S has Gaussian noise around ln S0 and the kurtosis model; its variance is drawn from the inverse
    gamma distribution and the 22 unknowns from their Gaussian.  ``accepted`` is the share of draws with a
    positive definite D, ``converged`` that of them whose extremes converged; with none accepted the
    measures are NaN.  Samples that are not positive count as 1e-12.  Draws follow the voxel's values,
    so a repeated task gives the same, and an equal voxel the same but for rounding.
    """
    parts, b = kurtosis_design(gradients)
    if not (b > 0).any() or len(b) <= 22:
        raise ValueError("more than 22 volumes, some with b > 0, are needed")
    scale = np.concatenate([[1.0], np.full(6, 1 / b.max()), np.full(15, 6 / b.max() ** 2)])
    design = np.concatenate([np.ones((len(b), 1)), parts], axis=1) * scale
    if np.linalg.matrix_rank(design) < 22:
        raise ValueError("the gradients do not determine the kurtosis tensor")
    inverse = np.linalg.pinv(design)
    root = np.linalg.cholesky(inverse @ inverse.T)
    free = len(b) - 22
    chunk = max(1, 10_000 // draws)

    def posterior(s: np.ndarray) -> np.ndarray:
        y = np.log(np.maximum(s, 1e-12))
        beta = y @ inverse.T
        rest = ((y - beta @ design.T) ** 2).sum(axis=1)
        made = [np.random.default_rng([seed, *np.frombuffer(v.tobytes(), "uint32").tolist()]) for v in s]
        sigma = np.sqrt(rest[:, None] / 2 / np.stack([r.gamma(free / 2, size=draws) for r in made]))
        drawn = beta[:, None] + sigma[..., None] * (np.stack([r.normal(size=(draws, 22)) for r in made]) @ root.T)
        fit = (drawn * scale)[..., 1:].reshape(-1, 21)
        low, high, sure = kurtosis_extremes(fit)
        good = np.isfinite(low)
        values = np.full((len(fit), len(MEASURES)), np.nan)
        maps = kurtosis_maps(fit[good])
        values[good] = np.concatenate([maps[:, [1, 0, 4, 5, 6]], low[good, None], high[good, None]], axis=1)
        values, good = values.reshape(len(s), draws, -1), good.reshape(len(s), draws)
        n = good.sum(axis=1)[:, None]
        count = np.where(n == 0, np.nan, n)
        mean = np.where(good[..., None], values, 0).sum(axis=1) / count
        spread = np.sqrt((np.where(good[..., None], values - mean[:, None], 0) ** 2).sum(axis=1) / count)
        pairs = np.stack([mean, spread], axis=2).reshape(len(s), -1)
        return np.concatenate([pairs, n / draws, sure.reshape(len(s), draws).sum(axis=1)[:, None] / count], axis=1)

    def kernel(s: np.ndarray) -> np.ndarray:
        return np.concatenate([posterior(s[a : a + chunk]) for a in range(0, len(s), chunk)])

    return named(mapped(dealt(rows), kernel), [f"{m}_{of}" for m in MEASURES for of in ("mean", "sd")] + ["accepted", "converged"])
