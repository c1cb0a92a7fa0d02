"""Model fits: linear ones as aggregations, others as batched NumPy solvers over packed series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import mapped


def t2_linear(decay: DataFrame, max_t2: float) -> DataFrame:
    """ln S = ln A - t / T2 by least squares; T2 is cut at ``max_t2``, and all is 0 if S grows.

    Samples from the first one that is not positive on are left out; a voxel with fewer than two
    before it has zeros.
    """
    stop = decay.filter("value <= 0").groupBy("voxel_id").agg(F.min("t").alias("stop"))
    line = decay.join(stop, "voxel_id", "left").groupBy("voxel_id")
    used = F.col("stop").isNull() | (F.col("t") < F.col("stop"))
    y, t = F.when(used, F.log("value")), F.when(used, F.col("t"))
    line = line.agg(F.regr_slope(y, t).alias("s"), F.regr_intercept(y, t).alias("i"), F.regr_r2(y, t).alias("r2"))
    pick = lambda x: F.when(F.col("s") < 0, x).otherwise(F.lit(0.0))
    return line.select("voxel_id", pick(F.exp("i")).alias("a"), pick(F.least(-1 / F.col("s"), F.lit(float(max_t2)))).alias("t2"), pick(F.col("r2")).alias("r2"))


def used_samples(y: np.ndarray, positive: bool = False) -> np.ndarray:
    """1 for samples before the first zero (or the first that is not positive), 0 from it on."""
    return np.cumprod(y > 0 if positive else y != 0, axis=1).astype(float)


def levenberg(model, start: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for many series at once; model(p) returns values and derivatives.

    Returns the parameters and whether each series converged: its last step changed the cost by
    less than one part in 1e12, or no step lowers it any more.
    """
    p, damp = start.copy(), np.full(len(y), 1e-3)
    value, slope = model(p)
    cost = (weight * (y - value) ** 2).sum(axis=1)
    done = np.zeros(len(y), dtype=bool)
    for _ in range(rounds):
        jt = np.swapaxes(slope * weight[:, :, None], 1, 2)
        h = jt @ slope
        d = np.einsum("bii->bi", h)
        g = (jt @ (y - value)[:, :, None])[:, :, 0]
        step = np.linalg.solve(h + np.einsum("bi,ij->bij", damp[:, None] * d + 1e-12, np.eye(h.shape[1])), g[:, :, None])[:, :, 0]
        tried = p + step
        new_value, new_slope = model(tried)
        new_cost = (weight * (y - new_value) ** 2).sum(axis=1)
        good = np.isfinite(new_cost) & (new_cost < cost) & ~done
        done |= (good & (cost - new_cost <= 1e-12 * cost)) | (~good & (damp >= 1e12)) | (cost <= 1e-24 * (weight * y * y).sum(axis=1))
        p = np.where(good[:, None], tried, p)
        value, cost = np.where(good[:, None], new_value, value), np.where(good, new_cost, cost)
        slope = np.where(good[:, None, None], new_slope, slope)
        damp = np.clip(np.where(good, damp / 5, damp * 5), 1e-12, 1e12)
        if done.all():
            break
    return p, done


def centred_r2(y: np.ndarray, fit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    n = np.maximum(weight.sum(axis=1, keepdims=True), 1)
    spread = (weight * (y - (weight * y).sum(axis=1, keepdims=True) / n) ** 2).sum(axis=1)
    return 1 - (weight * (y - fit) ** 2).sum(axis=1) / np.where(spread == 0, np.inf, spread)


def t2_nonlinear(rows: DataFrame, times: list[float], constant: bool = False) -> DataFrame:
    """A exp(-t / T2) (+ C) by Levenberg-Marquardt from the linear fit; series are packed.

    Samples from the first one that is not positive on are left out; fewer than two give zeros.
    """
    t = np.asarray(times, float)

    def kernel(y: np.ndarray) -> np.ndarray:
        w = used_samples(y, positive=True)
        n = np.maximum(w.sum(axis=1), 1)
        logs = np.log(np.where(w > 0, y, 1.0))
        mean_t, mean_l = (w @ t) / n, (w * logs).sum(axis=1) / n
        u = w * (t - mean_t[:, None])
        slope = (u * logs).sum(axis=1) / np.maximum((u * u).sum(axis=1), 1e-300)
        rate = np.maximum(-slope, 1e-6)
        a = np.exp(np.clip(mean_l + rate * mean_t, -100, 100))
        start = np.stack([a, rate] + [np.zeros_like(a)] * constant, axis=1)

        def model(p: np.ndarray):
            e = np.exp(-np.clip(p[:, 1:2] * t, -50, 50))
            parts = [e, -p[:, :1] * t * e] + [np.ones_like(e)] * constant
            return p[:, :1] * e + (p[:, 2:3] if constant else 0), np.stack(parts, axis=2)

        p, done = levenberg(model, start, y, w)
        enough = w.sum(axis=1) >= 2
        out = np.stack([p[:, 0], 1 / np.where(p[:, 1] == 0, np.inf, p[:, 1]), p[:, 2] if constant else np.zeros(len(p)), centred_r2(y, model(p)[0], w)], axis=1)
        return np.concatenate([np.where(enough[:, None], out, 0.0), (done & enough)[:, None]], axis=1)

    return named(mapped(rows, kernel), ["a", "t2", "c", "r2", "converged"])


#: The models of T1 recovery: whether magnitudes are given, whether B is fitted, B if not, and the form.
T1_MODELS = {
    "ideal_steady_state": (False, False, 1.0, "recovery"),
    "inversion_recovery": (False, False, 2.0, "recovery"),
    "absolute_inversion_recovery": (True, False, 2.0, "recovery"),
    "look_locker": (False, True, 2.0, "look_locker"),
    "absolute_look_locker": (True, True, 2.0, "look_locker"),
    "hybrid_steady_state_3": (False, True, 1.0, "hybrid"),
    "inversion_recovery_3": (False, True, 2.0, "recovery"),
    "absolute_inversion_recovery_3": (True, True, 2.0, "recovery"),
    "absolute_look_locker_3": (True, True, 2.0, "apparent"),
}


def t1_fit(rows: DataFrame, times: list[float] | None, model: str = "inversion_recovery") -> DataFrame:
    """a, t1, b, r2 and whether the fit converged, for one of T1_MODELS.

    ``times`` are those of all series; if None, each row has its own in a column ``times``.

    recovery A (1 - B exp(-t / T1)); hybrid A (B - exp(-t / T1)); look_locker fits the first and
    gives T1 (B - 1); apparent A - B exp(-(B / A - 1) t / T1).  Absolute models restore the sign of
    the samples before the smallest.  Samples from the first zero on are left out; fewer than two
    give zeros.
    """
    absolute, free, b0, form = T1_MODELS[model]

    def kernel(y: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        t = np.broadcast_to(np.asarray(times, float), y.shape) if own is None else own
        w = used_samples(y)
        if absolute:
            low = np.where(w > 0, y, np.inf).argmin(axis=1)
            y = np.where(np.arange(y.shape[1]) < low[:, None], -y, y)
        last = np.maximum(w.sum(axis=1).astype(int) - 1, 0)
        near = np.where(w > 0, np.abs(y), np.inf).argmin(axis=1)
        r0 = np.log(max(b0, 1.2)) / np.maximum(t[np.arange(len(y)), near], np.where(t > 0, t, np.inf).min(axis=1))
        a0 = np.maximum(np.abs(y[np.arange(len(y)), last]), 1e-6)
        start = np.stack([a0, r0] + [np.full(len(y), b0) * (a0 if form == "apparent" else 1.0)] * free, axis=1)

        def curve(p: np.ndarray):
            a, r = p[:, :1], p[:, 1:2]
            b = p[:, 2:3] if free else b0
            if form == "apparent":
                k = b / np.where(a == 0, 1e-12, a) - 1
                e = np.exp(-np.clip(k * r * t, -50, 50))
                parts = [1 - b * e * b / np.where(a == 0, 1e-12, a * a) * r * t, b * e * k * t, -e + b * e * r * t / np.where(a == 0, 1e-12, a)]
                return a - b * e, np.stack(parts, axis=2)
            e = np.exp(-np.clip(r * t, -50, 50))
            if form == "hybrid":
                return a * (b - e), np.stack([b - e, a * t * e, np.broadcast_to(a, e.shape)], axis=2)
            parts = [1 - b * e, a * b * t * e] + [-a * e] * free
            return a * (1 - b * e), np.stack(parts, axis=2)

        p, done = levenberg(curve, start, y, w)
        b = p[:, 2] if free else np.full(len(p), b0)
        t1 = 1 / np.where(p[:, 1] == 0, np.inf, p[:, 1]) * (b - 1 if form == "look_locker" else 1.0)
        enough = w.sum(axis=1) >= 2
        out = np.stack([p[:, 0], t1, b, centred_r2(y, curve(p)[0], w)], axis=1)
        return np.concatenate([np.where(enough[:, None], out, 0.0), (done & enough)[:, None]], axis=1)

    return named(mapped(rows, kernel, *["times"] * (times is None)), ["a", "t1", "b", "r2", "converged"])


def t1_inversion(rows: DataFrame, times: list[float], factor: float | None = 2.0, absolute: bool = False) -> DataFrame:
    """A (1 - B exp(-t / T1)) with B 2 (inversion), 1 (saturation) or fitted (None)."""
    names = {(1.0, False): "ideal_steady_state", (2.0, False): "inversion_recovery", (2.0, True): "absolute_inversion_recovery", (None, False): "inversion_recovery_3", (None, True): "absolute_inversion_recovery_3"}
    return t1_fit(rows, times, names[factor, absolute])


def look_locker_times(spark, first: float, step: float, slices: int, samples: int, order: list[int]) -> DataFrame:
    """(slice, k, t): first + (place of the slice in the order + k * slices) * step."""
    place = {s: i for i, s in enumerate(order)}
    grid = spark.createDataFrame([(s, place[s]) for s in range(slices)], "slice int, place int")
    k = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return k.select("slice", "k", (first + (F.col("place") + F.col("k") * slices) * step).alias("t"))


def look_locker_maps(images: DataFrame, slices: int, first: float, step: float, model: str = "absolute_inversion_recovery", max_t1: float = 10.0) -> DataFrame:
    """T1 maps (scan, x, y, z, a, t1, b, r2, converged) of images of ``kspace.look_locker``.

    Sample k of the slice that is acquired s-th is at first + (s + k * slices) * step, so every slice is
    fitted on times of its own.  T1 is at most ``max_t1``.  Places are packed into the voxel's number:
    images have at most 16,384 pixels a side and 4,096 slices.
    """
    at = F.transform("v", lambda r: first + (F.col("image") % slices + r["part"] * slices) * step)
    voxel = images.groupBy("image", "x", "y", "z").agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("v"))  # a value a sample
    number, bits = F.col("image").cast("long"), (("z", 12), ("y", 14), ("x", 14))
    for c, n in bits:
        number = F.shiftleft(number, n) + F.col(c)
    fit = t1_fit(voxel.select(number.alias("voxel_id"), at.alias("times"), F.transform("v", lambda r: r["value"]).alias("series")), None, model)
    out, number = {}, F.col("voxel_id")
    for c, n in reversed(bits):
        out[c], number = number.bitwiseAND((1 << n) - 1), F.shiftright(number, n)
    t1 = F.least(F.col("t1"), F.lit(float(max_t1))).alias("t1")
    return fit.select(F.floor(number / slices).cast("int").alias("scan"), *[out[c].cast("int").alias(c) for c in "xyz"], "a", t1, "b", "r2", "converged")


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("voxel_id", *[F.col("series")[i].alias(n) for i, n in enumerate(names)])


def tensor_fit(rows: DataFrame, gradients: list[tuple[float, float, float, float]], weighted: bool = True) -> DataFrame:
    """Diffusion tensor, FA, trace and eigenvalues; gradients are (b, gx, gy, gz) per volume.

    ln S is fitted by least squares, then, if ``weighted``, again with the signal as weight.
    """
    g = np.asarray(gradients, float)
    b, x, y, z = g.T
    design = np.stack([np.ones_like(b), -b * x * x, -b * y * y, -b * z * z, -2 * b * x * y, -2 * b * y * z, -2 * b * x * z], axis=1)

    def kernel(s: np.ndarray) -> np.ndarray:
        s = np.maximum(s, 1e-12)
        w = s if weighted else np.ones_like(s)
        xw = w[:, :, None] * design
        beta = np.linalg.solve(np.swapaxes(xw, 1, 2) @ xw, np.swapaxes(xw, 1, 2) @ (w * np.log(s))[:, :, None])[:, :, 0]
        d = np.zeros((len(s), 3, 3))
        for k, (i, j) in enumerate(((0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2))):
            d[:, i, j] = d[:, j, i] = beta[:, k + 1]
        values = np.linalg.eigvalsh(d)[:, ::-1]
        mean = values.mean(axis=1, keepdims=True)
        fa = np.sqrt(1.5 * ((values - mean) ** 2).sum(axis=1) / np.maximum((values**2).sum(axis=1), 1e-300))
        return np.concatenate([beta[:, 1:], values, fa[:, None], values.sum(axis=1)[:, None]], axis=1)

    return named(mapped(rows, kernel), ["dxx", "dyy", "dzz", "dxy", "dyz", "dxz", "l1", "l2", "l3", "fa", "trace"])


def deconvolution(rows: DataFrame, aif: list[float], dt: float, tol: float = 0.1, circulant: bool = False) -> DataFrame:
    """Flow, volume and transit time by singular-value deconvolution with an input function."""
    a = np.asarray(aif, float)
    n = len(a)
    size = 2 * n if circulant else n
    padded = np.concatenate([a, np.zeros(size - n)])
    i, j = np.indices((size, size))
    matrix = dt * (padded[(i - j) % size] if circulant else np.where(i >= j, padded[np.abs(i - j)], 0))
    u, w, vt = np.linalg.svd(matrix)
    inverse = (vt.T * np.where(w > tol * w.max(), 1 / np.maximum(w, 1e-300), 0)) @ u.T

    def kernel(c: np.ndarray) -> np.ndarray:
        residue = np.concatenate([c, np.zeros((len(c), size - n))], axis=1) @ inverse.T
        cbf = residue.max(axis=1)
        cbv = c.sum(axis=1) / max(a.sum(), 1e-300)
        return np.stack([cbf, cbv, cbv / np.where(cbf == 0, np.inf, cbf)], axis=1)

    return named(mapped(rows, kernel), ["cbf", "cbv", "mtt"])


def patlak(series: DataFrame, inputs: DataFrame, tr: float) -> DataFrame:
    """Slope and intercept of C / Cp on the integral of Cp over Cp; inputs has t and cp."""
    from pyspark.sql import Window

    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    cp = inputs.select("t", "cp", (F.coalesce(F.sum("cp").over(before), F.lit(0.0)) * tr).alias("integral"))  # a row a time point
    joined = series.join(F.broadcast(cp), "t").filter("cp > 0")
    y, x = F.col("value") / F.col("cp"), F.col("integral") / F.col("cp")
    return joined.groupBy("voxel_id").agg(F.regr_slope(y, x).alias("k"), F.regr_intercept(y, x).alias("v"))


def logistic_glm(df: DataFrame, features: list[str], response: str, rounds: int = 25) -> DataFrame:
    """Logistic regression by reweighted least squares; each round sums one small matrix over all rows.

    Rows with a null are left out.  The columns are checkpointed once, so rounds don't read the source
    again.  p is two-sided from the normal distribution.
    """
    from .graph import cut
    names, k = ["intercept", *features], len(features) + 1
    beta = np.zeros(k)
    rows = cut(df.select(*[F.col(c).cast("double") for c in features], F.col(response).cast("double").alias("y")).dropna())

    def sums(b: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            h, g = np.zeros((k, k)), np.zeros(k)
            for part in batches:
                x = np.column_stack([np.ones(len(part)), part[features].to_numpy()])
                p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
                h += (x * (p * (1 - p))[:, None]).T @ x
                g += x.T @ (part["y"].to_numpy() - p)
            yield pd.DataFrame({"i": range(k * k + k), "v": np.concatenate([h.ravel(), g])})

        out = np.zeros(k * k + k)
        for i, v in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # k * k + k rows
            out[i] = v
        return out[: k * k].reshape(k, k), out[k * k :]

    for _ in range(rounds):
        h, g = sums(beta)
        if abs(np.linalg.det(h)) <= 1e-8:
            h = h + 0.1 * np.eye(k)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if (step**2).sum() < 1e-12:
            break
    se = np.sqrt(np.diag(np.linalg.inv(sums(beta)[0] + 1e-12 * np.eye(k))))
    table = [(n, float(b), float(s), float(b / s), math.erfc(abs(b / s) / math.sqrt(2))) for n, b, s in zip(names, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(table, "term string, beta double, se double, z double, p double")


def prewhitened_glm(rows: DataFrame, design: list[list[float]], taper: int | None = None) -> DataFrame:
    """(voxel_id, beta, se) of packed series on a design, with noise correlated in time.

    Residuals of least squares give autocorrelations up to ``taper`` lags (2 sqrt(T) if not given),
    tapered by a cosine; the covariance V that they form whitens series and design for a second fit.
    """
    x = np.asarray(design, float)
    t, k = x.shape
    m = min(t - 1, taper or int(2 * np.sqrt(t)))
    inverse = np.linalg.pinv(x)
    lag = np.abs(np.subtract.outer(np.arange(t), np.arange(t)))

    def kernel(y: np.ndarray) -> np.ndarray:
        r = y - y @ inverse.T @ x.T
        out = []
        for own, rest in zip(y, r, strict=True):
            c = np.array([rest[: t - i] @ rest[i:] for i in range(m + 1)])
            rho = c / c[0] * (1 + np.cos(np.pi * np.arange(m + 1) / m)) / 2 if c[0] > 1e-300 and m else np.eye(1, m + 1)[0]
            v = np.where(lag <= m, rho[np.minimum(lag, m)], 0.0)
            values, vectors = np.linalg.eigh(v)
            w = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
            wx, wy = w @ x, w @ own
            gram = np.linalg.pinv(wx.T @ wx)
            beta = gram @ wx.T @ wy
            s2 = ((wy - wx @ beta) ** 2).sum() / max(1, t - k)
            out.append(np.concatenate([beta, np.sqrt(np.maximum(np.diag(gram) * s2, 0))]))
        return np.array(out)

    return mapped(rows, kernel).select("voxel_id", F.slice("series", 1, k).alias("beta"), F.slice("series", k + 1, k).alias("se"))
