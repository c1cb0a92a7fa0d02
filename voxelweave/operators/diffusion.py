"""Diffusion tensors and kurtosis: one small solver per voxel, batches of voxels at a time."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import carlson_rd
from .fits import named
from .signal import mapped

#: Places of the six tensor elements, in the order of the columns: xx, yy, zz, xy, yz, xz.
SIX = ((0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2))
#: The fifteen elements of the kurtosis tensor as powers of x, y, z.
FIFTEEN = tuple((i, j, 4 - i - j) for i in range(4, -1, -1) for j in range(4 - i, -1, -1))


def gradient_table(shots: list[tuple[float, float, float]], strength: float, duration: float, separation: float, mirrored: bool = False) -> list[tuple[float, float, float, float]]:
    """(b, gx, gy, gz) from scanner parameters (dpe, dro, dsl), with each direction's mirror if asked.

    b = (2 / pi)^2 d^2 G^2 (D - d / 4) gamma^2 0.01 for sine-shaped gradients.
    """
    gamma = 26751.98775
    out = []
    for shot in shots:
        for sign in (1, -1) if mirrored else (1,):
            g = np.array(shot, float) * sign
            size = float(np.linalg.norm(g))
            b = (2 / math.pi) ** 2 * duration**2 * (size * strength) ** 2 * (separation - duration / 4) * gamma**2 * 0.01
            unit = g / size if size else g
            out.append((b, *unit.tolist()))
    return out


def quadratic_program(g: np.ndarray, a: np.ndarray, equal: tuple | None = None, at_least: tuple | None = None, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Least 1/2 x'Gx + a'x with Cx = c and Ax >= b, G positive definite, by the dual active-set method.

    Starts at the free minimum and adds the most violated constraint; on the way to it, those whose
    multiplier reaches zero leave.  Raises if no point satisfies all.
    """
    rows = [np.asarray(m, float) for m in (*(equal[0] if equal else ()), *(at_least[0] if at_least else ()))]
    bounds = [float(v) for v in (*(equal[1] if equal else ()), *(at_least[1] if at_least else ()))]
    fixed = len(equal[1]) if equal else 0
    inverse = np.linalg.inv(g)
    x = -inverse @ a
    active: list[int] = []
    u = np.zeros(0)
    waiting = list(range(fixed))
    for _ in range(rounds):
        if waiting:
            new = waiting.pop(0)
        else:
            slack = {i: rows[i] @ x - bounds[i] for i in range(fixed, len(rows)) if i not in active}
            new = min(slack, key=slack.get, default=None)
            if new is None or slack[new] >= -1e-10 * (1 + abs(bounds[new])):
                return x, float(0.5 * x @ g @ x + a @ x)
        sign = -1.0 if new < fixed and rows[new] @ x > bounds[new] else 1.0
        normal, own = sign * rows[new], 0.0
        while True:
            n = np.array([rows[i] for i in active]).T if active else np.zeros((len(a), 0))
            dual = np.linalg.solve(n.T @ inverse @ n, n.T @ inverse) if active else np.zeros((0, len(a)))
            z = inverse @ (normal - n @ (dual @ normal))
            r = dual @ normal
            gain = z @ normal
            full = (sign * bounds[new] - normal @ x) / gain if gain > 1e-12 * (normal @ inverse @ normal) else np.inf
            leave = [(u[k] / r[k], k) for k, i in enumerate(active) if i >= fixed and r[k] > 1e-12]
            part, k = min(leave, default=(np.inf, -1))
            t = min(full, part)
            if t == np.inf:
                if abs(normal @ x - sign * bounds[new]) <= 1e-9 * (1 + abs(bounds[new])):
                    break
                raise ValueError("no point satisfies the constraints")
            u, own = u - t * r, own + t
            if full < np.inf:
                x = x + t * z
            if t == full:
                active, u = [*active, new], np.append(u, own)
                break
            active, u = active[:k] + active[k + 1 :], np.delete(u, k)
    raise ValueError("the active sets did not settle")


def interior_point(q: np.ndarray, c: np.ndarray, at_least: tuple, equal: tuple | None = None, rounds: int = 100) -> tuple[np.ndarray, float]:
    """The same problem by Mehrotra's predictor-corrector steps from inside the constraints."""
    a, b = np.atleast_2d(np.asarray(at_least[0], float)), np.atleast_1d(np.asarray(at_least[1], float))
    e = np.atleast_2d(np.asarray(equal[0], float)) if equal else np.zeros((0, len(c)))
    f = np.atleast_1d(np.asarray(equal[1], float)) if equal else np.zeros(0)
    n, m, k = len(c), len(b), len(f)
    x, s, z, y = np.zeros(n), np.ones(m), np.ones(m), np.zeros(k)
    for _ in range(rounds):
        rd, rp, re = q @ x + c - a.T @ z - e.T @ y, a @ x - s - b, e @ x - f
        mu = s @ z / m
        if max(np.abs(rd).max(initial=0), np.abs(rp).max(initial=0), np.abs(re).max(initial=0), mu) < 1e-11:
            break

        def step(comp: np.ndarray, rd=rd, rp=rp, re=re, s=s, z=z):
            d = z / s
            kkt = np.block([[q + a.T @ (d[:, None] * a), -e.T], [e, np.zeros((k, k))]])
            right = np.concatenate([-rd - a.T @ (d * rp + comp / s), -re])
            out = np.linalg.lstsq(kkt, right, rcond=None)[0]
            ds = a @ out[:n] + rp
            return out[:n], out[n:], ds, (-comp - z * ds) / s

        def far(v: np.ndarray, d: np.ndarray) -> float:
            down = d < 0
            return min(1.0, float((-v[down] / d[down]).min(initial=1.0)))

        _, _, ds, dz = step(s * z)
        near = ((s + far(s, ds) * ds) @ (z + far(z, dz) * dz)) / m
        dx, dy, ds, dz = step(s * z + ds * dz - (near / mu) ** 3 * mu)
        t = 0.99 * min(far(s, ds), far(z, dz)) if mu > 1e-12 else 1.0
        x, y, s, z = x + t * dx, y + t * dy, s + t * ds, z + t * dz
    return x, float(0.5 * x @ q @ x + c @ x)


def tensor_design(gradients) -> np.ndarray:
    b, x, y, z = np.asarray(gradients, float).T
    return np.stack([np.ones_like(b), -b * x * x, -b * y * y, -b * z * z, -2 * b * x * y, -2 * b * y * z, -2 * b * x * z], axis=1)


def matrices(beta: np.ndarray) -> np.ndarray:
    d = np.zeros((len(beta), 3, 3))
    for k, (i, j) in enumerate(SIX):
        d[:, i, j] = d[:, j, i] = beta[:, k]
    return d


def tensor_maps(d: np.ndarray) -> np.ndarray:
    """Eigenvalues descending, FA, RA, trace, first to third eigenvector, and colour |v1| FA."""
    values, vectors = np.linalg.eigh(d)
    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
    mean = values.mean(axis=1, keepdims=True)
    spread = ((values - mean) ** 2).sum(axis=1)
    fa = np.sqrt(1.5 * spread / np.maximum((values**2).sum(axis=1), 1e-300))
    ra = np.sqrt(spread / 3) / np.maximum(np.abs(mean[:, 0]), 1e-300)
    v = np.swapaxes(vectors, 1, 2).reshape(len(d), 9)
    return np.concatenate([values, fa[:, None], ra[:, None], values.sum(axis=1)[:, None], v, np.abs(v[:, :3]) * fa[:, None]], axis=1)


MAPS = ["l1", "l2", "l3", "fa", "ra", "trace", *(f"v{i}{c}" for i in (1, 2, 3) for c in "xyz"), "red", "green", "blue"]
ELEMENTS = ["dxx", "dyy", "dzz", "dxy", "dyz", "dxz"]


def weighted_fit(s: np.ndarray, design: np.ndarray) -> np.ndarray:
    w = np.maximum(s, 1e-12)
    xw = w[:, :, None] * design
    xt = np.swapaxes(xw, 1, 2)
    return np.linalg.solve(xt @ xw, xt @ (w * np.log(w))[:, :, None])[:, :, 0]


def constrained_tensor(rows: DataFrame, gradients: list[tuple[float, float, float, float]], nonlinear: bool = False) -> DataFrame:
    """Elements and maps of the tensor D = U'U, which has no negative eigenvalue.

    The weighted linear fit starts it, with its eigenvalues raised to a small positive one; then
    damped Gauss-Newton steps on U minimise the weighted squares of ln S, or of S if ``nonlinear``.
    Where the linear fit is positive already, the linear form returns it.
    """
    design = tensor_design(gradients)
    upper = ((0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2))

    def expanded(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln S0 and tensor elements of (ln S0, U), with their derivatives."""
        u = np.zeros((len(p), 3, 3))
        for k, (i, j) in enumerate(upper):
            u[:, i, j] = p[:, k + 1]
        d = np.swapaxes(u, 1, 2) @ u
        beta = np.concatenate([p[:, :1], np.stack([d[:, i, j] for i, j in SIX], axis=1)], axis=1)
        slope = np.zeros((len(p), 7, 7))
        slope[:, 0, 0] = 1
        for k, (r, c) in enumerate(upper):
            for m, (i, j) in enumerate(SIX):
                slope[:, m + 1, k + 1] = (c == i) * u[:, r, j] + (c == j) * u[:, r, i]
        return beta, slope

    def kernel(s: np.ndarray) -> np.ndarray:
        s = np.maximum(s, 1e-12)
        linear = weighted_fit(s, design)
        values, vectors = np.linalg.eigh(matrices(linear[:, 1:]))
        floor = 1e-3 * np.maximum(np.abs(values).max(axis=1, keepdims=True), 1e-12)
        d = (vectors * np.maximum(values, floor)[:, None, :]) @ np.swapaxes(vectors, 1, 2)
        u = np.swapaxes(np.linalg.cholesky(d), 1, 2)
        p = np.concatenate([linear[:, :1], np.stack([u[:, i, j] for i, j in upper], axis=1)], axis=1)
        scale = np.maximum(np.abs(p), 1e-6)

        def residual(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            beta, slope = expanded(p)
            log = beta @ design.T
            if nonlinear:
                value = np.exp(np.clip(log, -50, 50))
                return s - value, (value[:, :, None] * design) @ slope
            return s * (np.log(s) - log), (s[:, :, None] * design) @ slope

        damp = np.full(len(p), 1e-3)
        r, j = residual(p)
        cost = (r * r).sum(axis=1)
        for _ in range(100):
            j = j * scale[:, None, :]
            jt = np.swapaxes(j, 1, 2)
            h = jt @ j
            h = h + damp[:, None, None] * np.einsum("bii->bi", h)[:, :, None] * np.eye(7) + 1e-12 * np.eye(7)
            step = np.linalg.solve(h, (jt @ r[:, :, None]))[:, :, 0] * scale
            new_r, new_j = residual(p + step)
            new = (new_r * new_r).sum(axis=1)
            good = new < cost
            small = (cost - new <= 1e-12 * cost).all()
            p, cost = np.where(good[:, None], p + step, p), np.where(good, new, cost)
            r, j = residual(p)
            damp = np.where(good, damp / 5, np.minimum(damp * 5, 1e10))
            if small and (damp >= 1e9).all() or (small and good.all()):
                break
        beta = expanded(p)[0]
        if not nonlinear:
            beta = np.where((values > 0).all(axis=1)[:, None], linear, beta)
        return np.concatenate([beta[:, 1:], np.exp(np.clip(beta[:, :1], -50, 50)), tensor_maps(matrices(beta[:, 1:]))], axis=1)

    return named(mapped(rows, kernel), [*ELEMENTS, "s0", *MAPS])


def kurtosis_design(gradients) -> tuple[np.ndarray, np.ndarray]:
    """Columns for ln(S / S0): six of D and fifteen of the mean squared diffusivity times W."""
    b, x, y, z = np.asarray(gradients, float).T
    six = np.stack([-b * x * x, -b * y * y, -b * z * z, -2 * b * x * y, -2 * b * y * z, -2 * b * x * z], axis=1)
    times = [math.factorial(4) / (math.factorial(i) * math.factorial(j) * math.factorial(k)) for i, j, k in FIFTEEN]
    fifteen = np.stack([m * b * b / 6 * x**i * y**j * z**k for m, (i, j, k) in zip(times, FIFTEEN, strict=True)], axis=1)
    return np.concatenate([six, fifteen], axis=1), b


def directions(n: int) -> np.ndarray:
    """Points spread evenly over the sphere, by the golden angle."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    return np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)


def along(fit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apparent diffusivity and kurtosis of fits (six, fifteen) in the directions ``at``."""
    x, y, z = at.T
    six = np.stack([x * x, y * y, z * z, 2 * x * y, 2 * y * z, 2 * x * z], axis=1)
    times = [math.factorial(4) / (math.factorial(i) * math.factorial(j) * math.factorial(k)) for i, j, k in FIFTEEN]
    fifteen = np.stack([m * x**i * y**j * z**k for m, (i, j, k) in zip(times, FIFTEEN, strict=True)], axis=1)
    d = fit[:, :6] @ six.T
    return d, (fit[:, 6:] @ fifteen.T) / np.where(d == 0, np.inf, d * d)


#: Place of each entry of a symmetric 3 x 3 x 3 x 3 tensor among the fifteen.
ENTRY = np.array([FIFTEEN.index(tuple(q.count(axis) for axis in range(3))) for q in itertools.product(range(3), repeat=4)]).reshape(3, 3, 3, 3)


def sphere_means(values: np.ndarray) -> np.ndarray:
    """Means over the sphere of n_i^2 n_j^2 / D(n)^2, D(n) = sum of values_i n_i^2; values are positive.

    The means g_i of n_i^2 / D are Carlson's RD of the inverse values.  For i <> j the mean is
    (g_i - g_j) / (2 (value_j - value_i)), and those of a row, times the values, sum to g_i.  As it is
    even in the difference of the two values, one too small to divide by may be widened.
    """
    g = np.stack(
        [carlson_rd(1 / values[:, (i + 1) % 3], 1 / values[:, (i + 2) % 3], 1 / values[:, i]) / (3 * values[:, i] * np.sqrt(values.prod(axis=1))) for i in range(3)], axis=1
    )
    out = np.zeros((len(values), 3, 3))
    for i, j in ((0, 1), (1, 2), (0, 2)):
        k = 3 - i - j
        middle, apart = (values[:, i] + values[:, j]) / 2, (values[:, i] - values[:, j]) / 2
        apart = np.where(np.abs(apart) < 3e-4 * middle, 3e-4 * middle, apart)
        high, low, rest = middle + apart, middle - apart, values[:, k]
        at = lambda one, two: carlson_rd(1 / two, 1 / rest, 1 / one) / (3 * one * np.sqrt(one * two * rest))  # noqa: B023, E731
        out[:, i, j] = out[:, j, i] = (at(high, low) - at(low, high)) / (2 * (low - high))
    for i in range(3):
        out[:, i, i] = (g[:, i] - sum(values[:, j] * out[:, i, j] for j in range(3) if j != i)) / values[:, i]
    return out


def kurtosis_maps(fit: np.ndarray, n: int = 120) -> np.ndarray:
    """FA, trace, axial and radial diffusivity, mean, axial and radial kurtosis.

    Mean kurtosis is that over the sphere, by Carlson's integrals, and radial kurtosis that over the
    circle around the first eigenvector, in closed form.  Where an eigenvalue is not positive the
    diffusivity vanishes somewhere: means over ``n`` directions, and 36 of the circle, stand in.
    """
    maps = tensor_maps(matrices(fit[:, :6]))
    values, axes = maps[:, :3], maps[:, 6:15].reshape(-1, 3, 3)
    w = fit[:, 6:][:, ENTRY]
    turned = np.einsum("nabcd,nia,nib,njc,njd->nij", w, axes, axes, axes, axes, optimize=True)
    out = np.zeros((len(fit), 3))
    out[:, 1] = turned[:, 0, 0] / np.where(values[:, 0] == 0, np.inf, values[:, 0] ** 2)
    good = values[:, 2] > 1e-9 * np.abs(values[:, 0])
    if good.any():
        v, t = values[good], turned[good]
        means = sphere_means(v)
        out[good, 0] = (means * t).sum(axis=(1, 2)) * 3 - 2 * sum(means[:, i, i] * t[:, i, i] for i in range(3))
        a, b = np.sqrt(v[:, 1]), np.sqrt(v[:, 2])
        cross = 1 / (2 * a * b * (a + b) ** 2)
        two, three = (1 / (a * (a + b)) - v[:, 2] * cross) / v[:, 1], (1 / (b * (a + b)) - v[:, 1] * cross) / v[:, 2]
        out[good, 2] = t[:, 1, 1] * two + t[:, 2, 2] * three + 6 * t[:, 1, 2] * cross
    if not good.all():
        rest = fit[~good]
        out[~good, 0] = along(rest, directions(n))[1].mean(axis=1)
        turn = 2 * np.pi * np.arange(36) / 36
        around = np.cos(turn)[:, None, None] * axes[~good, 1] + np.sin(turn)[:, None, None] * axes[~good, 2]
        d = np.einsum("pna,nab,pnb->pn", around, matrices(rest[:, :6]), around)
        k = np.einsum("nabcd,pna,pnb,pnc,pnd->pn", w[~good], around, around, around, around, optimize=True)
        out[~good, 2] = (k / np.where(d == 0, np.inf, d * d)).mean(axis=0)
    return np.stack([maps[:, 3], maps[:, 5], values[:, 0], (values[:, 1] + values[:, 2]) / 2, out[:, 0], out[:, 1], out[:, 2]], axis=1)


KURTOSIS = ["fa", "trace", "axial_d", "radial_d", "mean_k", "axial_k", "radial_k"]


def kurtosis_fit(rows: DataFrame, gradients: list[tuple[float, float, float, float]], method: str = "linear", k_max: float = 3.0) -> DataFrame:
    """Diffusion and kurtosis tensor (d0 .. d5, k0 .. k14) and their maps, S0 from the volumes of b = 0.

    ``linear`` solves ln(S / S0) by least squares with the pseudo-inverse; ``constrained`` adds
    D >= 0 and 0 <= K <= ``k_max`` / (b D) in the directions measured, by quadratic programming;
    ``restore`` reweights by Geman-McClure, drops samples over three robust deviations off, and fits
    the rest again.
    """
    design, b = kurtosis_design(gradients)
    zero, used = b == 0, b > 0
    if not zero.any():
        raise ValueError("a volume of b = 0 is needed")
    x = design[used]
    inverse = np.linalg.pinv(x)
    at = np.asarray(gradients, float)[used][:, 1:]
    top = b[used].max()
    scale = np.concatenate([np.full(6, 1 / top), np.full(15, 6 / top**2)])

    def fit_one(y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]

    def restored(y: np.ndarray) -> np.ndarray:
        beta = inverse @ y
        for _ in range(20):
            r = y - x @ beta
            c = 1.4826 * np.median(np.abs(r - np.median(r)))
            if c <= 1e-12:
                return beta
            new = fit_one(y, c / (r * r + c * c) ** 0.5)
            if np.abs(new - beta).max() <= 1e-8 * np.abs(beta).max():
                break
            beta = new
        r = y - x @ beta
        keep = np.abs(r) <= 3 * 1.4826 * np.median(np.abs(r - np.median(r)))
        return fit_one(y, keep.astype(float)) if keep.sum() > x.shape[1] else beta

    def constrained(y: np.ndarray) -> np.ndarray:
        xs = x * scale
        six = x[:, :6] / -b[used][:, None]
        fifteen = x[:, 6:] / (b[used] ** 2 / 6)[:, None]
        none = np.zeros_like(fifteen)
        # D >= 0, W >= 0 and W <= k_max D / b, all linear in the unknowns.
        rules = np.concatenate([np.concatenate([six, np.zeros_like(fifteen)], 1), np.concatenate([np.zeros_like(six), fifteen], 1), np.concatenate([six * k_max / top, none - fifteen], 1)]) * scale
        rules = rules / np.maximum(np.linalg.norm(rules, axis=1, keepdims=True), 1e-300)
        ridge = 1e-9 * np.trace(xs.T @ xs) / 21
        return quadratic_program(xs.T @ xs + ridge * np.eye(21), -xs.T @ y, None, (rules, np.zeros(len(rules))), 500)[0] * scale

    def kernel(s: np.ndarray) -> np.ndarray:
        s = np.maximum(s, 1e-12)
        y = np.log(s[:, used] / s[:, zero].mean(axis=1, keepdims=True))
        if method == "linear":
            fit = y @ inverse.T
        else:
            fit = np.stack([{"constrained": constrained, "restore": restored}[method](v) for v in y])
        return np.concatenate([fit, kurtosis_maps(fit)], axis=1)

    return named(mapped(rows, kernel), [*(f"d{i}" for i in range(6)), *(f"k{i}" for i in range(15)), *KURTOSIS])


def bayesian_tensor(rows: DataFrame, gradients: list[tuple[float, float, float, float]], draws: int = 200, seed: int = 1) -> DataFrame:
    """Posterior mean and deviation of trace and FA under a flat prior, over positive definite draws.

    ln S has Gaussian noise; its variance is drawn from the inverse gamma distribution and the
    tensor from its Gaussian.  Draws follow the voxel's values, so a repeated task gives the same.
    """
    design = tensor_design(gradients)
    gram = np.linalg.pinv(design.T @ design)
    root = np.linalg.cholesky(gram + 1e-18 * np.eye(7) * np.trace(gram))
    free = max(1, len(design) - 7)

    def kernel(s: np.ndarray) -> np.ndarray:
        y = np.log(np.maximum(s, 1e-12))
        beta = y @ design @ gram
        rest = ((y - beta @ design.T) ** 2).sum(axis=1)
        out = []
        for k in range(len(s)):
            rng = np.random.default_rng([seed, int(np.abs(s[k]).sum() * 1e6) & 0x7FFFFFFF])
            sigma = np.sqrt(rest[k] / 2 / rng.gamma(free / 2, size=draws))
            drawn = beta[k] + sigma[:, None] * (rng.normal(size=(draws, 7)) @ root.T)
            maps = tensor_maps(matrices(drawn[:, 1:]))
            good = maps[:, 2] > 0
            use = maps[good] if good.any() else maps
            out.append([use[:, 5].mean(), use[:, 5].std(), use[:, 3].mean(), use[:, 3].std(), good.mean()])
        return np.array(out)

    return named(mapped(rows, kernel), ["trace_mean", "trace_sd", "fa_mean", "fa_sd", "accepted"])


def resampled_tensors(tensors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """Tensor elements after a rotation of space: R D R'."""
    r = np.asarray(rotation, float)
    place = {(i, j): e for e, (i, j) in zip(ELEMENTS, SIX, strict=True)} | {(j, i): e for e, (i, j) in zip(ELEMENTS, SIX, strict=True)}
    new = {e: sum((F.col(place[k, m]) * float(r[i, k] * r[j, m]) for k in range(3) for m in range(3)), F.lit(0.0)) for e, (i, j) in zip(ELEMENTS, SIX, strict=True)}
    return tensors.withColumns(new)
