"""Pair matrices over series: blocks of standardised series meet once and multiply.

A cell holds two blocks of series and gives its pairs in tiles, so a row is sent as often as there
are blocks, and a task holds two blocks and one tile, not the pairs of a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block, rows in it at most, and rows of a tile.
NUMBERS, BLOCK, TILE = 1 << 20, 1 << 14, 512
#: Cells that a matrix is dealt into at least, if it has the rows, so that all cores have work.
CELLS = 36


def pair_matrix(rows: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float | None = None) -> DataFrame:
    """(i, j, value) for i < j of a matrix function over packed series.

    ``least`` keeps only values of at least that size, which bounds the output of sparse results.
    """
    n, longest = rows.agg(F.count("*"), F.max(F.size("series"))).first()  # one row
    per = max(1, min(BLOCK, NUMBERS // max(1, longest or 1)))
    few = int(((8 * CELLS + 1) ** 0.5 - 1) / 2)  # blocks that make CELLS cells
    n_blocks = max(1, -(-n // per), min(few, n // TILE))
    block = F.pmod(F.xxhash64("voxel_id"), F.lit(n_blocks)).cast("int")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"))))
    dealt = rows.select(F.col("voxel_id").cast("long").alias("voxel_id"), F.col("series").cast("array<double>").alias("series")).withColumn("block", block)
    dealt = dealt.select("voxel_id", "series", "block", meet.alias("m")).select("voxel_id", "series", "block", "m.*")

    def multiply(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts)).sort_by("voxel_id")
        ids, of = table.column("voxel_id").to_numpy(), table.column("block").to_numpy()
        x = table.column("series").combine_chunks()
        x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
        p, q = (k.as_py() for k in key)
        (ia, a), (ib, b) = ((ids[of == k], x[of == k]) for k in (p, q))
        b = [prepare(b[t : t + TILE]) for t in range(0, len(b), TILE)]
        for s in range(0, len(a), TILE):
            one, left = prepare(a[s : s + TILE]), ia[s : s + TILE]
            for t, two in enumerate(b):
                right = ib[t * TILE : (t + 1) * TILE]
                if p == q and right[-1] < left[0]:
                    continue
                value = combine(one, two)
                keep = left[:, None] != right[None, :] if p != q else left[:, None] < right[None, :]
                if least is not None:
                    keep &= np.abs(value) >= least
                i, j = np.nonzero(keep)
                arrays = [np.minimum(left[i], right[j]), np.maximum(left[i], right[j]), np.asarray(value[i, j], float)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["i", "j", "value"])

    cells = n_blocks * (n_blocks + 1) // 2
    return dealt.repartition(min(2000, 2 * cells), "p", "q").groupBy("p", "q").applyInArrow(multiply, "i long, j long, value double")


def standardised(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, np.nan, norm)


def correlation_matrix(rows: DataFrame, least: float | None = None) -> DataFrame:
    """Pearson correlation of every pair; NaN where a series is constant."""
    return pair_matrix(rows, standardised, lambda a, b: np.clip(a @ b.T, -1, 1), least)


def distance_matrix(rows: DataFrame, sigma: float | None = None) -> DataFrame:
    """Euclidean distance of every pair, or exp(-(d / sigma)^2)."""

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
        return np.sqrt(d2) if sigma is None else np.exp(-d2 / sigma**2)

    return pair_matrix(rows, lambda x: x, combine)


def phase_coherence(phases: DataFrame) -> DataFrame:
    """abs(mean of exp(i (phase_i - phase_j))) of every pair."""
    return pair_matrix(phases, lambda x: np.exp(1j * x), lambda a, b: np.abs(a @ b.conj().T) / a.shape[1])


def phase_lag_index(phases: DataFrame) -> DataFrame:
    """2 * abs(0.5 - share of positive wrapped phase differences among the non-zero ones)."""

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for k in range(len(a)):
            s = np.sin(a[k][None, :] - b)
            pos, any_ = (s > 1e-12).sum(axis=1), (np.abs(s) > 1e-12).sum(axis=1)
            out[k] = np.where(any_ > 0, 2 * np.abs(0.5 - pos / np.maximum(any_, 1)), 0)
        return out

    return pair_matrix(phases, lambda x: x, combine)


def seed_map(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Correlation of each label's mean series with every voxel's."""
    seeds = series.join(labels.filter("label >= 1"), "voxel_id").groupBy("label", "t").agg(F.avg("value").alias("seed"))
    return series.join(seeds, "t").groupBy("label", "voxel_id").agg(F.corr("seed", "value").alias("r"))


def seed_maps(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same for packed series and packed seeds (label, series): series stay whole, so no time point
    is a key; seeds are a row a label and go to every task."""
    names, table = zip(*[(r["label"], r["series"]) for r in seeds.collect()], strict=True)  # a row a label
    s = standardised(np.asarray(table, float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r = standardised(np.stack(batch["series"].to_list())) @ s.T
            yield pd.DataFrame({"label": np.tile(names, len(batch)), "voxel_id": np.repeat(batch["voxel_id"].to_numpy(), len(names)), "r": r.ravel()})

    return rows.select("voxel_id", "series").mapInPandas(run, "label int, voxel_id long, r double").filter(~F.isnan("r"))


def inverse_correlation(rows: DataFrame, least: float | None = None) -> DataFrame:
    """1 - r where r is not negative, else 1; ``least`` keeps pairs of at least that value."""
    return pair_matrix(rows, standardised, lambda a, b: np.where((r := np.clip(a @ b.T, -1, 1)) >= 0, 1 - r, 1.0), least)


def label_agreement(rows: DataFrame, least: float | None = None) -> DataFrame:
    """Share of places at which two labelled series (voxel_id, series) agree."""

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(((a == v) * 1.0) @ ((b == v) * 1.0).T for v in np.union1d(a, b)) / a.shape[1]

    return pair_matrix(rows, lambda x: x, combine, least)


def similarity_matrix(rows: DataFrame, sigma: float | None = None, least: float | None = None) -> DataFrame:
    """exp(-(d / sigma)^2) of the Euclidean distance; sigma is the median distance if not given."""
    if sigma is None:
        d = distance_matrix(rows)
        sigma = d.agg(F.percentile_approx("value", 0.5, 10_000)).first()[0] or 1.0  # one number

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
        return np.exp(-d2 / sigma**2)

    return pair_matrix(rows, lambda x: x, combine, least)


def coherency(rows: DataFrame, imaginary: bool = False, least: float | None = None) -> DataFrame:
    """Absolute or imaginary coherency of every pair: the normalised mean of a times conjugate b over
    the analytic signals."""

    def prepare(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)

    return pair_matrix(rows, prepare, lambda a, b: (a @ b.conj().T).imag if imaginary else np.abs(a @ b.conj().T), least)


def principal_signal(series: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, t, value): first principal component of each label's series, over voxels.

    The time-by-time products of a label are summed over its voxels in parallel, so only a small
    matrix a label reaches the solver, whatever the voxels.  The sign is that of the label's mean.
    """
    from .signal import packed

    rows = packed(series).join(labels.filter("label >= 1"), "voxel_id")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            for label, part in batch.groupby("label"):
                x = np.stack(part["series"].to_list()).astype(float)
                own = total.setdefault(label, [0.0, 0.0, 0])
                own[0], own[1], own[2] = own[0] + x.T @ x, own[1] + x.sum(axis=0), own[2] + len(x)
        yield pd.DataFrame([(k, np.asarray(g).ravel(), m, n) for k, (g, m, n) in total.items()], columns=["label", "g", "m", "n"])

    sums = rows.select("label", "series").mapInPandas(products, "label int, g array<double>, m array<double>, n long")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n, mean = part["n"].sum(), sum(np.asarray(m) for m in part["m"])
        t = len(mean)
        gram = sum(np.asarray(g) for g in part["g"]).reshape(t, t)
        mean = mean / n
        values, vectors = np.linalg.eigh(gram / n - np.outer(mean, mean))
        first = vectors[:, -1] * (1 if vectors[:, -1] @ mean >= 0 else -1)
        return pd.DataFrame({"label": part["label"].iloc[0], "t": range(t), "value": first})

    return sums.groupBy("label").applyInPandas(solve, "label int, t int, value double")  # a row a task and label


def series_components(rows: DataFrame, share: float | None = None, count: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PCA over time of packed series: (eigenvalues, components by time, voxel maps of correlation).

    The mean over voxels is taken out at each time; the T x T products are summed over tasks, and
    the components, by number or by share of the variance, go back to the series.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, m, n = 0.0, 0.0, 0
        for batch in batches:
            x = np.stack(batch["series"].to_list()).astype(float)
            g, m, n = g + x.T @ x, m + x.sum(axis=0), n + len(x)
        if n:
            yield pd.DataFrame({"i": [0], "g": [np.asarray(g).ravel()], "m": [m], "n": [n]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [sum(np.asarray(x) for x in part["g"])], "m": [sum(np.asarray(x) for x in part["m"])], "n": [part["n"].sum()]})

    one = rows.select("series").mapInPandas(products, "i int, g array<double>, m array<double>, n long")
    total = one.groupBy("i").applyInPandas(summed, "g array<double>, m array<double>, n long").first()  # a T x T matrix
    m, n = np.array(total["m"]) / total["n"], total["n"]
    t = len(m)
    values, vectors = np.linalg.eigh(np.array(total["g"]).reshape(t, t) / n - np.outer(m, m))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if count is None:
        count = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share if share is not None else 1.0) + 1)
    kept = vectors[:, : min(count, t)]
    kept = kept * np.where(kept[np.abs(kept).argmax(axis=0), range(kept.shape[1])] < 0, -1, 1)
    spark = rows.sparkSession
    eigen = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, eigenvalue double")
    parts = spark.createDataFrame([(c, i, float(kept[i, c])) for c in range(kept.shape[1]) for i in range(t)], "component int, t int, value double")
    seeds = spark.createDataFrame([(c, kept[:, c].tolist()) for c in range(kept.shape[1])], "label int, series array<double>")
    return eigen, parts, seed_maps(rows, seeds).withColumnRenamed("label", "component")


def roi_correlation(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Correlation of the mean series of every pair of labels."""
    means = series.join(labels.filter("label >= 1"), "voxel_id").groupBy("label", "t").agg(F.avg("value").alias("value"))
    other = means.select(F.col("label").alias("j"), "t", F.col("value").alias("w"))
    pairs = means.withColumnRenamed("label", "i").join(other, "t").filter("i < j")
    return pairs.groupBy("i", "j").agg(F.corr("value", "w").alias("r"))


def visibility_graph(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """Edges between samples that see each other over all samples between them; weight 1 if not weighted.

    A sample is compared with all later ones of all series of a batch at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["series"].map(len)):
                ids, y = part["voxel_id"].to_numpy(), np.stack(part["series"].to_list()).astype(float)
                for i in range(y.shape[1] - 1):
                    slope = (y[:, i + 1 :] - y[:, i : i + 1]) / np.arange(1, y.shape[1] - i)
                    best = np.maximum.accumulate(slope, axis=1)
                    seen = np.ones_like(slope, dtype=bool)
                    seen[:, 1:] = slope[:, 1:] > best[:, :-1]
                    v, k = np.nonzero(seen)
                    yield pd.DataFrame({"voxel_id": ids[v], "i": i, "j": i + 1 + k, "weight": np.abs(slope[v, k]) if weighted else 1.0})

    return rows.select("voxel_id", "series").mapInPandas(run, "voxel_id long, i int, j int, weight double")


def visibility_by_label(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Visibility graphs of the mean series of every label."""
    from .signal import packed

    means = series.join(labels.filter("label >= 1"), "voxel_id").groupBy("label", "t").agg(F.avg("value").alias("value"))
    return visibility_graph(packed(means.withColumnRenamed("label", "voxel_id"))).withColumnRenamed("voxel_id", "label")
