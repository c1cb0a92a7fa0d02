"""Per-series signal processing: regressions as aggregations, transforms as Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(series: DataFrame) -> DataFrame:
    """voxel_id with its values in time order; a series is one row, of bounded length."""
    return series.groupBy("voxel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("series"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("voxel_id", F.posexplode("series").alias("t", "value"))


def detrend(series: DataFrame, add_mean: bool = False, ignore: int = 0) -> DataFrame:
    """y - a t - b with the least-squares line of each series; ``ignore`` samples at both ends don't fit."""
    last = series.agg(F.max("t").alias("last"))
    fit = series.crossJoin(F.broadcast(last)).filter((F.col("t") >= ignore) & (F.col("t") <= F.col("last") - ignore)) if ignore else series
    lines = fit.groupBy("voxel_id").agg(F.regr_slope("value", "t").alias("a"), F.regr_intercept("value", "t").alias("b"), F.avg("value").alias("m"))
    back = F.col("m") if add_mean else F.lit(0.0)
    return series.join(lines, "voxel_id").select("voxel_id", "t", (F.col("value") - F.col("a") * F.col("t") - F.col("b") + back).alias("value"))


def remove_global_mean(series: DataFrame) -> DataFrame:
    g = series.groupBy("t").agg(F.avg("value").alias("g"))
    return series.join(g, "t").select("voxel_id", "t", (F.col("value") - F.col("g")).alias("value"))


def global_regress(series: DataFrame) -> DataFrame:
    """B - g (g'g)^-1 g'B for the mean signal g over all voxels."""
    g = series.groupBy("t").agg(F.avg("value").alias("g"))
    joined = series.join(g, "t")
    beta = joined.groupBy("voxel_id").agg((F.sum(F.col("g") * F.col("value")) / F.sum(F.col("g") * F.col("g"))).alias("beta"))
    return joined.join(beta, "voxel_id").select("voxel_id", "t", (F.col("value") - F.col("beta") * F.col("g")).alias("value"))


def cumulative_sum(series: DataFrame, suffix: bool = False) -> DataFrame:
    w = Window.partitionBy("voxel_id").orderBy("t")
    w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if suffix else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.select("voxel_id", "t", F.sum("value").over(w).alias("value"))


def riemann_integral(series: DataFrame, tr: float) -> DataFrame:
    """Sum of earlier samples times tr; 0 at the first."""
    w = Window.partitionBy("voxel_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return series.select("voxel_id", "t", (F.coalesce(F.sum("value").over(w), F.lit(0.0)) * tr).alias("value"))


def smooth3(series: DataFrame) -> DataFrame:
    """(1, 4, 1) / 6 over neighbours in time; the ends stay."""
    w = Window.partitionBy("voxel_id").orderBy("t")
    a, b = F.lag("value").over(w), F.lead("value").over(w)
    return series.select("voxel_id", "t", F.coalesce((a + 4 * F.col("value") + b) / 6, F.col("value")).alias("value"))


def onsets(design: DataFrame) -> DataFrame:
    """Samples at which a design becomes positive after none, with the number of the block."""
    w = Window.partitionBy("voxel_id").orderBy("t")
    start = (F.col("value") > 0) & (F.coalesce(F.lag("value").over(w), F.lit(0.0)) <= 0)
    return design.withColumn("start", start).filter("start").select("voxel_id", "t", F.row_number().over(w).alias("block"))


def phase_unwrapped(phase: DataFrame) -> DataFrame:
    """Phases with each step replaced by its shortest equivalent, summed up."""
    w = Window.partitionBy("voxel_id").orderBy("t")
    d = F.col("value") - F.lag("value").over(w)
    step = F.coalesce(F.atan2(F.sin(d), F.cos(d)), F.col("value"))
    return phase.withColumn("step", step).select("voxel_id", "t", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("value"))


def mapped(rows: DataFrame, kernel: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """Applies a kernel on matrices (series by time) to packed series of one length per batch group.

    Arrays ``more``, as long as the series, are given to the kernel as further matrices.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["series"].map(len)):
                out = kernel(*[np.stack([np.asarray(s, float) for s in part[c]]) for c in ("series", *more)])
                yield pd.DataFrame({"voxel_id": part["voxel_id"].to_numpy(), "series": list(out)})

    return rows.select("voxel_id", "series", *more).mapInPandas(run, "voxel_id long, series array<double>")


def bandpass(rows: DataFrame, low_hz: float, high_hz: float, dt: float, retrend: bool = False) -> DataFrame:
    """Keeps the frequencies from low to high, after zero padding to a power of two.

    ``retrend`` takes the line of each series out before and puts it back after.
    """

    def kernel(x: np.ndarray) -> np.ndarray:
        n = 1 << max(1, (x.shape[1] - 1).bit_length())
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        line = x.mean(axis=1, keepdims=True) + (x @ t / max(t @ t, 1e-300))[:, None] * t if retrend else 0.0
        f = np.fft.rfft(x - line, n)
        first, last = int(np.ceil(low_hz * n * dt)), int(np.floor(high_hz * n * dt))
        keep = np.zeros(f.shape[1], dtype=bool)
        keep[first : last + 1] = True
        return np.fft.irfft(f * keep, n)[:, : x.shape[1]] + line

    return mapped(rows, kernel)


def spectrum(rows: DataFrame) -> DataFrame:
    """Magnitudes of the real Fourier transform."""
    return mapped(rows, lambda x: np.abs(np.fft.rfft(x)))


def analytic_phase(rows: DataFrame) -> DataFrame:
    """Instantaneous phase of the analytic signal."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        return np.angle(np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1))

    return mapped(rows, kernel)


def lagged_correlation(rows: DataFrame, other: list[float]) -> DataFrame:
    """Lag and value of the largest normalised cross-correlation with one given series."""
    ref = np.asarray(other, float)
    ref = (ref - ref.mean()) / (np.linalg.norm(ref - ref.mean()) or 1.0)

    def kernel(x: np.ndarray) -> np.ndarray:
        n = 1 << (x.shape[1] + len(ref) - 1).bit_length()
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        c = np.fft.irfft(np.fft.rfft(x / np.where(norm == 0, 1, norm), n) * np.conj(np.fft.rfft(ref, n)), n)
        lags = np.where(np.arange(n) < n // 2, np.arange(n), np.arange(n) - n)
        best = c.argmax(axis=1)
        return np.stack([lags[best], c[np.arange(len(c)), best]], axis=1)

    return mapped(rows, kernel).select("voxel_id", F.col("series")[0].alias("lag"), F.col("series")[1].alias("correlation"))


def dfa(rows: DataFrame) -> DataFrame:
    """Detrended fluctuation exponent: slope of log F against log n for boxes from 4 to a quarter."""

    return fluctuations(rows).groupBy("voxel_id").agg(F.regr_slope("f", "n").alias("alpha"))


def exact_bandpass(rows: DataFrame, low_hz: float, high_hz: float, dt: float) -> DataFrame:
    """Keeps the frequencies from low to high and the mean, without padding."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        f = np.fft.rfft(x, axis=1)
        k = np.arange(f.shape[1])
        keep = (k >= np.ceil(low_hz * n * dt)) & (k <= np.floor(high_hz * n * dt)) | (k == 0)
        return np.fft.irfft(f * keep, n, axis=1)

    return mapped(rows, kernel)


def regressed(rows: DataFrame, regressors: list[list[float]]) -> DataFrame:
    """(voxel_id, series, beta): what linear regression on several regressors leaves, and its weights.

    The regressors are a bounded table, a row a time point; their pseudo-inverse goes to the tasks.
    """
    x = np.asarray(regressors, float)
    x = x if x.shape[0] >= x.shape[1] else x.T
    inverse, k = np.linalg.pinv(x), x.shape[1]

    def kernel(b: np.ndarray) -> np.ndarray:
        beta = b @ inverse.T
        return np.concatenate([beta, b - beta @ x.T], axis=1)

    out = mapped(rows, kernel)
    return out.select("voxel_id", F.slice("series", k + 1, x.shape[0]).alias("series"), F.slice("series", 1, k).alias("beta"))


def resting_state(series: DataFrame, target: float = 1000.0, band: tuple[float, float] | None = (0.01, 0.1), dt: float = 1.0, smooth=None, regress: bool = True) -> DataFrame:
    """Resting-state preparation of (voxel_id, t, value): intensity normalisation, detrending with the
    mean kept, smoothing by a function on series, band-pass and global regression, each if asked for."""
    from .aggregate import median_normalised

    out = detrend(median_normalised(series, target), add_mean=True)
    if smooth is not None:
        out = smooth(out)
    if band is not None:
        out = unpacked(bandpass(packed(out), *band, dt))
    return global_regress(out) if regress else out


def cross_correlation(rows: DataFrame, other: list[float], normalised: bool = True, means: bool = True) -> DataFrame:
    """Sum of products with one given series over n - 1, with or without means, or the correlation."""
    ref = np.asarray(other, float)

    def kernel(x: np.ndarray) -> np.ndarray:
        a, b = (x - x.mean(axis=1, keepdims=True), ref - ref.mean()) if means else (x, ref)
        c = a @ b / max(1, len(ref) - 1)
        if normalised:
            c = c * max(1, len(ref) - 1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b), 1e-300)
        return c[:, None]

    return mapped(rows, kernel).select("voxel_id", F.col("series")[0].alias("r"))


def circular_correlation(rows: DataFrame, other: list[float]) -> DataFrame:
    """Sums of products with one given series at every circular lag, by transforms."""
    ref = np.conj(np.fft.rfft(np.asarray(other, float)))
    return mapped(rows, lambda x: np.fft.irfft(np.fft.rfft(x, axis=1) * ref, x.shape[1], axis=1))


def tapered(rows: DataFrame, window: str = "welch") -> DataFrame:
    """Series times a taper: 'constant' or 'welch', 1 - (2 j / (n - 1) - 1)^2."""
    j = lambda i: 2 * i / F.nullif(F.size("series") - 1, F.lit(0)) - 1
    weight = (lambda i: F.lit(1.0)) if window == "constant" else (lambda i: 1 - j(i) * j(i))
    return rows.select("voxel_id", F.transform("series", lambda x, i: x * weight(i)).alias("series"))


def fluctuations(rows: DataFrame) -> DataFrame:
    """(voxel_id, n, f): log10 of each box size and of the detrended fluctuation."""

    def kernel(x: np.ndarray) -> np.ndarray:
        y = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
        out = []
        for n in box_sizes(y.shape[1]):
            boxes = y[:, : y.shape[1] // n * n].reshape(len(y), -1, n)
            t = np.arange(n) - (n - 1) / 2
            rest = boxes - boxes.mean(axis=2, keepdims=True) - (boxes @ t / (t @ t))[:, :, None] * t
            out += [np.full(len(y), np.log10(n)), 0.5 * np.log10((rest**2).mean(axis=(1, 2)) + 1e-300)]
        return np.stack(out, axis=1)

    each = mapped(rows, kernel).select("voxel_id", "series", F.explode(F.sequence(F.lit(0), (F.size("series") / 2).cast("int") - 1)).alias("k"))
    return each.select("voxel_id", F.element_at("series", 2 * F.col("k") + 1).alias("n"), F.element_at("series", 2 * F.col("k") + 2).alias("f"))


def box_sizes(total: int) -> np.ndarray:
    sizes = np.unique(np.floor(4 * 2 ** (np.arange(0, 200) / 8)).astype(int))
    return sizes[sizes <= max(4, total // 4)]


def gamma_response(rows: DataFrame, dt: float, baseline: int = 1) -> DataFrame:
    """Amplitude, time to peak and largest value of k * gamma density(alpha, beta) over a baseline.

    The fit is by Levenberg-Marquardt on (k, ln(alpha - 1), ln beta) from a few starting shapes, of
    which each series keeps the best; ``ssd`` is what it leaves and ``converged`` says whether it
    settled.  ``chi2`` sums the squared differences over the fitted values where those are positive,
    and ``p`` is the chi-square share beyond it, with a degree of freedom a sample.  ``area`` is that
    under the response up to the last sample, and ``relative_top`` its top in baselines.
    """
    from ..functions.special import chi2_tail, gamma_cdf, log_gamma
    from .fits import levenberg

    def kernel(x: np.ndarray) -> np.ndarray:
        base = x[:, :baseline].mean(axis=1, keepdims=True)
        y = x - base
        t = (np.arange(x.shape[1]) + 1e-3) * dt

        def density(p: np.ndarray) -> np.ndarray:
            a, b = 1 + np.exp(np.clip(p[:, 1:2], -5, 5)), np.exp(np.clip(p[:, 2:3], -6, 6))
            return np.exp(np.clip((a - 1) * np.log(t) - t / b - a * np.log(b) - log_gamma(a), -700, 50))

        def model(p: np.ndarray):
            value = p[:, :1] * density(p)
            slope = [density(p)]
            for i in (1, 2):
                up = p.copy()
                up[:, i] += 1e-5
                slope.append((p[:, :1] * density(up) - value) / 1e-5)
            return value, np.stack(slope, axis=2)

        best, least, settled = None, np.full(len(y), np.inf), np.zeros(len(y), bool)
        for peak in (0.1, 0.25, 0.5):
            at = np.tile([0.0, np.log(4.0), np.log(max(peak * t[-1] / 4, 1e-2))], (len(y), 1))
            d = density(at)
            at[:, 0] = (d * y).sum(axis=1) / (d * d).sum(axis=1)
            p, done = levenberg(model, at, y, np.ones_like(y))
            ssd = ((y - model(p)[0]) ** 2).sum(axis=1)
            settled = np.where(ssd < least, done, settled)
            best = p if best is None else np.where((ssd < least)[:, None], p, best)
            least = np.minimum(least, ssd)
        a, b = 1 + np.exp(np.clip(best[:, 1], -5, 5)), np.exp(np.clip(best[:, 2], -6, 6))
        value = model(best)[0]
        fitted = value + base
        chi2 = np.where(fitted > 0, (x - fitted) ** 2 / np.where(fitted > 0, fitted, 1), 0).sum(axis=1)
        top, area = value.max(axis=1), best[:, 0] * gamma_cdf(t[-1], a, b)
        relative = top / np.where(base[:, 0] == 0, np.nan, base[:, 0])
        return np.stack([best[:, 0], a, b, (a - 1) * b, top, least, chi2, chi2_tail(chi2, x.shape[1]), area, relative, settled.astype(float)], axis=1)

    out = mapped(rows, kernel)
    names = ("k", "alpha", "beta", "time_to_peak", "top", "ssd", "chi2", "p", "area", "relative_top")
    return out.select("voxel_id", *[F.col("series")[i].alias(n) for i, n in enumerate(names)], (F.col("series")[len(names)] > 0).alias("converged"))
