"""Special functions over NumPy arrays, for the kernels of fits and maps."""

from __future__ import annotations

import numpy as np


def carlson_rf(x: np.ndarray, y: np.ndarray, z: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """Half the integral over t > 0 of ((t + x)(t + y)(t + z)) ** -1/2, by duplication.

    Arguments are not negative and at most one is zero; two zeros give infinity, others NaN.
    """
    x, y, z = (np.array(v, float) for v in np.broadcast_arrays(x, y, z))
    bad = np.minimum(np.minimum(x, y), z) < 0
    endless = (x == 0).astype(int) + (y == 0) + (z == 0) > 1
    for v in (x, y, z):
        v[bad | endless] = 1.0
    while True:
        mean = (x + y + z) / 3
        dx, dy, dz = 1 - x / mean, 1 - y / mean, 1 - z / mean
        if not len(mean.ravel()) or max(np.abs(d).max() for d in (dx, dy, dz)) < tolerance ** (1 / 2):
            break
        a, b, c = np.sqrt(x), np.sqrt(y), np.sqrt(z)
        step = a * b + b * c + c * a
        x, y, z = (x + step) / 4, (y + step) / 4, (z + step) / 4
    e2, e3 = dx * dy + dy * dz + dz * dx, dx * dy * dz
    series = 1 - e2 / 10 + e3 / 14 + e2 * e2 / 24 - 3 * e2 * e3 / 44 - 5 * e2**3 / 208 + 3 * e3 * e3 / 104 + e2 * e2 * e3 / 16
    return np.where(bad, np.nan, np.where(endless, np.inf, series / np.sqrt(mean)))


def carlson_rd(x: np.ndarray, y: np.ndarray, z: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """3/2 of the integral over t > 0 of ((t + x)(t + y)) ** -1/2 (t + z) ** -3/2, by duplication.

    z is positive and x and y are not negative; both zero, or z zero, give infinity, others NaN.
    """
    x, y, z = (np.array(v, float) for v in np.broadcast_arrays(x, y, z))
    bad = np.minimum(np.minimum(x, y), z) < 0
    endless = (z == 0) | ((x == 0) & (y == 0))
    for v in (x, y, z):
        v[bad | endless] = 1.0
    total, scale = np.zeros_like(x), np.ones_like(x)
    while True:
        mean = (x + y + 3 * z) / 5
        dx, dy, dz = 1 - x / mean, 1 - y / mean, 1 - z / mean
        if not len(mean.ravel()) or max(np.abs(d).max() for d in (dx, dy, dz)) < tolerance ** (1 / 2):
            break
        a, b, c = np.sqrt(x), np.sqrt(y), np.sqrt(z)
        step = a * b + b * c + c * a
        total = total + scale / (c * (z + step))
        scale = scale / 4
        x, y, z = (x + step) / 4, (y + step) / 4, (z + step) / 4
    e2 = dx * dy - 6 * dz * dz
    e3 = (3 * dx * dy - 8 * dz * dz) * dz
    e4 = 3 * (dx * dy - dz * dz) * dz * dz
    e5 = dx * dy * dz**3
    series = 1 - 3 * e2 / 14 + e3 / 6 + 9 * e2 * e2 / 88 - 3 * e4 / 22 - 9 * e2 * e3 / 52 + 3 * e5 / 26 - e2**3 / 16 + 3 * e3 * e3 / 40 + 3 * e2 * e4 / 20
    return np.where(bad, np.nan, np.where(endless, np.inf, 3 * total + scale * series / (mean * np.sqrt(mean))))


#: Coefficients of Lanczos' approximation of the gamma function for g = 7.  Fixed values.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(a: np.ndarray) -> np.ndarray:
    """ln of the gamma function for a > 0."""
    a = np.asarray(a, float)
    small = a < 0.5
    x = np.where(small, 1 - a, a) - 1
    t = x + 7.5
    series = LANCZOS[0] + sum(c / (x + k) for k, c in enumerate(LANCZOS[1:], 1))
    out = 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(series)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(small, np.log(np.pi / np.sin(np.pi * a)) - out, out)


def incomplete_gamma(a: np.ndarray, x: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma functions P(a, x) and Q(a, x) for a > 0, x >= 0.

    The power series serves x < a + 1 and the continued fraction the rest, each until no element
    changes; elements out of range, and any that do not settle, are NaN.
    """
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    shape = a.shape
    a, x = a.ravel(), x.ravel()
    p = np.full(a.shape, np.nan)
    fine = (a > 0) & (x >= 0) & np.isfinite(a)
    p[fine & (x == 0)] = 0.0
    p[fine & np.isinf(x)] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        head = np.exp(a * np.log(x) - x - log_gamma(np.where(fine, a, 1.0)))
    q = 1 - p
    low = np.flatnonzero(fine & (x > 0) & (x < a + 1))
    if len(low):
        term = 1 / a[low]
        total, n, live = term.copy(), a[low].copy(), np.ones(len(low), bool)
        for _ in range(rounds):
            n = n + 1
            term = term * x[low] / n
            total = total + term
            live = np.abs(term) > np.abs(total) * 1e-16
            if not live.any():
                break
        p[low] = np.where(live, np.nan, total * head[low])
        q[low] = 1 - p[low]
    high = np.flatnonzero(fine & (x >= a + 1) & np.isfinite(x))
    if len(high):
        tiny = 1e-300
        b = x[high] + 1 - a[high]
        c, d = np.full(len(high), 1 / tiny), 1 / b
        h, live = d.copy(), np.ones(len(high), bool)
        for k in range(1, rounds):
            step = -k * (k - a[high])
            b = b + 2
            d = step * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + step / np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            h = h * change
            live = np.abs(change - 1) > 1e-16
            if (np.abs(change - 1) < 3e-16).all():
                live = np.zeros(len(high), bool)
                break
        q[high] = np.where(live, np.nan, h * head[high])
        p[high] = 1 - q[high]
    return p.reshape(shape), q.reshape(shape)


def gamma_cdf(x: np.ndarray, shape: np.ndarray, scale: np.ndarray = 1.0) -> np.ndarray:
    """Share of a gamma distribution up to x."""
    return incomplete_gamma(shape, np.maximum(np.asarray(x, float) / scale, 0))[0]


def chi2_tail(x: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Share of a chi-square distribution beyond x."""
    return incomplete_gamma(np.asarray(freedom, float) / 2, np.maximum(np.asarray(x, float) / 2, 0))[1]
